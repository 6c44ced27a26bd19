"""SentencePiece encoding by suffix-array matching, and decoding."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.text import table
from tabulon.session import ship_code

SPACE = "▁"

#: Distinct units kept per worker process, and the longest one kept; the memory is emptied when full.
MAX_UNITS, MAX_UNIT_CHARS = 400_000, 64

#: Characters of new units matched at once; bounds the arrays of edges.
MAX_MATCHED = 300_000

#: Longer units are relaxed by themselves, position by position; the others together, as many steps as the longest has characters.
LONG_UNIT = 512

_NONE, _START = -1, -2


class PieceModel:
    """A BPE model file with byte fallback, identity normalisation and a dummy prefix; others are refused.

    The text, its spaces written as ``SPACE``, falls into units: a run of spaces and what follows up to the next. No piece
    reaches over the start of a unit, so units are encoded alone, each distinct one once.

    A batch's new units are concatenated; the suffix array of that text, sorted by as many characters as the longest piece
    has, is searched for every piece of the vocabulary, and each occurrence is an edge between two positions. Edges are
    relaxed in the order of their start. A path to a position ends in one piece only, that in which the merges of the
    text up to there end, and an edge continues it just if its piece and the last one would not have merged across
    their border. So what is left is the very segmentation that merging pairs by rank gives, not merely one of
    best total score.
    """

    _open: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.normalize(" a  b ") != f"{SPACE * 2}a{SPACE * 2}b{SPACE}":
            raise ValueError(f"{path}: only identity normalisation with a dummy prefix is supported")
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.byte_ids = {int(self.text[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(self.byte_ids) != 256:
            raise ValueError(f"{path}: only models with byte fallback are supported")
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in plain):
            raise ValueError(f"{path}: a piece has a space after another character")
        self.unknown = size  # stands for a character outside the vocabulary until it is spelled in bytes
        self.id_of = {self.text[i]: i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.rank = np.full(size + 1, -1, np.int64)
        for r, i in enumerate(sorted((i for i in plain if len(self.text[i]) > 1), key=lambda i: (-self.score[i], i))):
            self.rank[i] = r
        self.length = np.array([len(t) for t in self.text] + [1], np.int64)
        if any(self.score[i] <= self.score[self.id_of[SPACE * 2]] for i in plain if set(self.text[i]) != {SPACE}):
            raise ValueError(f"{path}: runs of spaces do not rank last")
        self._split(plain)
        self._index(plain)
        self.raw = [bytes([int(self.text[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else b" \xe2\x81\x87 " if model.is_unknown(i) else self.text[i].replace(SPACE, " ").encode() for i in range(size)]
        self.run_ids = {len(t): i for t, i in self.id_of.items() if set(t) == {SPACE}}
        self.units: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    @classmethod
    def at(cls, path: str) -> PieceModel:
        """This process's copy of a model file, which must exist on every machine."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit by merging the best pair again and again; the slow way, for irregular units and for checks."""
        parts = list(unit)
        while True:
            best, at = None, 0
            for k in range(len(parts) - 1):
                i = self.id_of.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if best is None:
                return [self.id_of.get(p, self.unknown) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _split(self, plain: list[int]) -> None:
        """The two pieces that merge last in each piece. Pieces that merging never reaches get no edges."""
        size = len(self.text)
        self.left, self.right = np.arange(size + 1), np.arange(size + 1)
        self.reached = np.zeros(size + 1, bool)
        for i in plain:
            if len(self.text[i]) == 1:
                self.reached[i] = True
                continue
            text, parts = self.text[i], list(self.text[i])
            while len(parts) > 2:
                scores = [(-self.score[j], k) for k in range(len(parts) - 1) if (j := self.id_of.get(parts[k] + parts[k + 1])) is not None]
                if not scores:
                    break
                k = min(scores)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2 and set(text) != {SPACE} and all(p in self.id_of for p in parts):
                a, b = self.id_of[parts[0]], self.id_of[parts[1]]
                if max(self.rank[a], self.rank[b]) < self.rank[i]:
                    self.left[i], self.right[i], self.reached[i] = a, b, True
        merged = np.flatnonzero(self.reached & (self.rank >= 0))
        keys = self.left[merged] * (size + 1) + self.right[merged]
        order = np.argsort(keys)
        self.pair_keys, self.pair_rank = keys[order], self.rank[merged][order]

    def _index(self, plain: list[int]) -> None:
        """Pieces as rows of packed character codes, padded low and high for the two ends of their range."""
        self.matched = np.array([i for i in plain if self.reached[i]], np.int64)
        self.chars = np.array(sorted({ord(c) for i in self.matched for c in self.text[i]}), np.uint32)
        if len(self.chars) > 65000:
            raise ValueError("too many different characters in the vocabulary")
        self.words = -(-int(self.length[self.matched].max()) // 4)
        low, high = np.zeros((len(self.matched), 4 * self.words), np.uint64), np.full((len(self.matched), 4 * self.words), 65535, np.uint64)
        for n, i in enumerate(self.matched):
            codes = self._codes(self.text[i])
            low[n, : len(codes)] = high[n, : len(codes)] = codes
        self.low, self.high = self._packed(low), self._packed(high)

    def _codes(self, text: str) -> np.ndarray:
        """2 on for characters of the vocabulary in their order, 1 for all others."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        return np.where(self.chars[at] == points, at + 2, 1).astype(np.uint64)

    @staticmethod
    def _packed(rows: np.ndarray) -> list[np.ndarray]:
        return [rows[:, k] << np.uint64(48) | rows[:, k + 1] << np.uint64(32) | rows[:, k + 2] << np.uint64(16) | rows[:, k + 3] for k in range(0, rows.shape[1], 4)]

    def _bound(self, sorted_: list[np.ndarray], wanted: list[np.ndarray], after: bool) -> np.ndarray:
        """For every wanted key the number of sorted keys below it, or with ``after`` not above it."""
        lo, hi = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), len(sorted_[0]), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            safe = np.minimum(mid, len(sorted_[0]) - 1)
            less, equal = np.zeros(len(lo), bool), np.ones(len(lo), bool)
            for s, w in zip(sorted_, wanted, strict=True):
                less |= equal & (s[safe] < w)
                equal &= s[safe] == w
            go = (less | (equal if after else False)) & (lo < hi)
            lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
        return lo

    def _suffixes(self, four: np.ndarray) -> np.ndarray:
        """Places sorted by as many characters as the longest piece has, from their first four, by prefix doubling."""
        order, size = np.argsort(four), 4
        while size < 4 * self.words:
            sorted_ = four[order]
            rank = np.empty(len(four), np.uint64)
            rank[order] = np.cumsum(np.r_[True, sorted_[1:] != sorted_[:-1]]).astype(np.uint64)
            behind = np.zeros(len(four), np.uint64)
            behind[:-size] = rank[size:]
            four = rank << np.uint64(32) | behind
            order, size = np.argsort(four), 2 * size
        return order

    def edges(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start position and piece of every occurrence in the concatenated units, and the units' own starts and ends.

        A separator that no piece has follows each unit; a character outside the vocabulary has one edge of its own.
        """
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.zeros(int(sizes.sum()) + len(units), np.uint64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        codes[np.arange(len(codes) - len(units)) + np.repeat(np.arange(len(units)), sizes)] = self._codes("".join(units))
        padded = np.r_[codes, np.zeros(4 * self.words, np.uint64)]
        four = padded[:-3] << np.uint64(48) | padded[1:-2] << np.uint64(32) | padded[2:-1] << np.uint64(16) | padded[3:]
        keys = [four[4 * k : 4 * k + len(codes)] for k in range(self.words)]
        suffixes = self._suffixes(four[: len(codes)])
        ordered = [k[suffixes] for k in keys]
        first, last = self._bound(ordered, self.low, False), self._bound(ordered, self.high, True)
        count = last - first
        at = np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(int(count.sum()))
        odd = np.flatnonzero(codes == 1)
        return np.r_[suffixes[at], odd], np.r_[np.repeat(self.matched, count), np.full(len(odd), self.unknown)], starts, starts + sizes

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether two pieces side by side stay two pieces.

        Merges are undone from the last to the first. At each state the pieces that meet at the border must have no merge
        that would have come before the one undone last; among equal ranks the left one comes first.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            key = x * (len(self.text) + 1) + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            clash = (self.pair_keys[at] == key) & (self.pair_rank[at] < limit[open_])
            good[open_[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_left = rx > ry
            limit[open_] = np.where(undo_left, rx, ry + 1)
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
            open_ = open_[~clash & (np.maximum(rx, ry) >= 0)]
        return good

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each unit, none of which is empty or begins with two spaces."""
        position, piece, starts, ends = self.edges(units)
        base = np.repeat(starts, ends - starts + 1)
        order = np.argsort(position - base[position], kind="stable")
        position, piece = position[order], piece[order]
        stop = position + self.length[piece]
        last = np.full(len(base) + 1, _NONE, np.int64)
        last[starts] = _START
        depth = position - base[position]
        levels = np.flatnonzero(np.r_[True, depth[1:] != depth[:-1], True]) if len(depth) else [0]
        for lo, hi in zip(levels, levels[1:], strict=False):
            before = last[position[lo:hi]]
            at = np.flatnonzero(before != _NONE) + lo
            before, now = last[position[at]], piece[at]
            fine = (before == _START) | (before == self.unknown) | (now == self.unknown)
            asked = np.flatnonzero(~fine)
            if len(asked):
                pairs, back = np.unique(before[asked] << 32 | now[asked], return_inverse=True)
                fine[asked] = self.apart(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            last[stop[at[fine]]] = now[fine]
        on_path, here = np.zeros(len(last), bool), ends
        while len(here):
            on_path[here] = True
            here = here - self.length[last[here]]
            here = here[last[here] != _START]
        path = np.flatnonzero(on_path)
        ids, bounds = last[path], np.searchsorted(path, np.r_[starts, len(base)], side="right")
        blob, odd = ids.astype("<u4").tobytes(), np.add.reduceat(np.r_[ids == self.unknown, False], bounds[:-1])
        out = [blob[4 * lo : 4 * hi] for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
        for n in np.flatnonzero(odd):
            spelled: list[int] = []
            for i, end in zip(ids[bounds[n] : bounds[n + 1]], path[bounds[n] : bounds[n + 1]], strict=True):
                spelled += [self.byte_ids[x] for x in units[n][end - starts[n] - 1].encode("utf-8", "surrogatepass")] if i == self.unknown else [i]
            out[n] = np.array(spelled, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text. An empty text has none."""
        split = re.compile(f"{SPACE}+[^{SPACE}]*").findall
        every = []
        for text in texts:
            units = [SPACE + u for u in text.split(" ")] if "  " not in text and text[:1] != " " and SPACE not in text and text[-1:] != " " else split(SPACE + text.replace(" ", SPACE))
            every.append(units if text else [])
        if len(self.units) > MAX_UNITS:
            self.units.clear()
        known = self.units
        new = {u: None for units in every for u in units if u not in known}
        odd = [u for u in new if u[:2] == SPACE * 2]
        plain = [u for u in new if u[:2] != SPACE * 2]
        plain += {SPACE + u.lstrip(SPACE) for u in odd} - {SPACE} - new.keys()
        new |= {u: self.encode_long(u) for u in plain if len(u) > LONG_UNIT}
        plain, at = [u for u in plain if len(u) <= LONG_UNIT], 0
        while at < len(plain):
            end, size = at, 0
            while end < len(plain) and (end == at or size + len(plain[end]) <= MAX_MATCHED):
                size, end = size + len(plain[end]), end + 1
            new |= zip(plain[at:end], self.encode_units(plain[at:end]), strict=True)
            at = end
        for u in odd:
            new[u] = self._after_spaces(u, new)
        known.update((u, v) for u, v in new.items() if len(u) <= MAX_UNIT_CHARS)
        return [b"".join([known[u] if u in known else new[u] for u in units]) for units in every]

    def _spaces(self, count: int) -> list[int]:
        """A run of spaces: its merges all rank the same and after all others, so the leftmost possible one is always next."""
        parts = [1]
        for _ in range(count - 1):
            if parts[-1] + 1 in self.run_ids:
                parts[-1] += 1
                while len(parts) > 1 and parts[-2] + parts[-1] in self.run_ids:
                    top = parts.pop()
                    parts[-1] += top
            else:
                parts.append(1)
        return [self.run_ids[n] for n in parts]

    def encode_long(self, unit: str) -> bytes:
        """The ids of one unit of any length, its edges matched ``MAX_MATCHED`` positions at a time and relaxed one by one."""
        reach, n = int(self.length.max()), len(unit)
        last, lengths = [_NONE] * (n + 1), self.length.tolist()
        last[0] = _START
        for at in range(0, n, MAX_MATCHED):
            position, piece, _, _ = self.edges([unit[at : at + MAX_MATCHED + reach]])
            inside = np.flatnonzero(position < MAX_MATCHED)
            inside = inside[np.argsort(position[inside], kind="stable")]
            for lo in range(0, len(inside), 100_000):
                part = inside[lo : lo + 100_000]
                for start, now in zip((position[part] + at).tolist(), piece[part].tolist(), strict=True):
                    before = last[start]
                    if before != _NONE and (before == _START or self._stay_apart(before, now)):
                        last[start + lengths[now]] = now
        ids, here = [], n
        while here:
            now = last[here]
            here -= lengths[now]
            ids += [self.byte_ids[x] for x in reversed(unit[here].encode("utf-8", "surrogatepass"))] if now == self.unknown else [now]
        return np.array(ids[::-1], "<u4").tobytes()

    def _stay_apart(self, a: int, b: int) -> bool:
        """``apart`` for one pair of pieces, remembered."""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) > MAX_UNITS:
                self.pairs.clear()
            self.pairs[key] = self.unknown in (a, b) or bool(self.apart(np.array([a]), np.array([b]))[0])
        return self.pairs[key]

    def _after_spaces(self, unit: str, known: dict[str, bytes]) -> bytes:
        """A unit of several spaces and a word: the last space goes with the word unless it stays a piece of its own."""
        word = unit.lstrip(SPACE)
        count, ids = len(unit) - len(word), np.frombuffer(known[SPACE + word], "<u4") if word else np.zeros(0, "<u4")
        if not word or ids[0] == self.id_of[SPACE]:
            return np.r_[np.array(self._spaces(count), "<u4"), ids[1:]].astype("<u4").tobytes()
        return np.r_[np.array(self._spaces(count - 1), "<u4"), ids].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes that are no UTF-8 become replacement characters, the dummy prefix goes."""
        raw = b"".join([self.raw[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def _with(df: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *more])


def encode(docs: DataFrame, model: str, text_col: str = "text", batch_rows: int = 1000) -> DataFrame:
    """``docs`` with ``ids``, the pieces of ``text_col`` as an int array; null and empty texts have an empty array.

    Any other columns, repeated rows and null ids pass through; a column named ``ids`` must be renamed first. Rows are
    encoded ``batch_rows`` at a time; the text is matched per batch and nothing is shuffled.
    """
    if "ids" in docs.columns:
        raise ValueError("rename the column ids first")
    ship_code(docs.sparkSession)
    k = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.at(model)
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                part = batch.slice(start, batch_rows)
                raw = pieces.encode([t or "" for t in part.column(k).to_pylist()])
                offsets = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.record_batch([*part.columns, ids], names=[*part.schema.names, "ids"])

    return docs.mapInArrow(run, _with(docs, T.StructField("ids", T.ArrayType(T.IntegerType()))))


def decode(coded: DataFrame, model: str, ids_col: str = "ids", checksums: bool = False) -> DataFrame:
    """``coded`` with ``decoded``, the text of ``ids_col``; null arrays give the empty text.

    With ``checksums`` the ids give way to ``n_ids`` and ``ids_crc32``, of the little-endian unsigned 32-bit ids.
    """
    added = ["decoded", "n_ids", "ids_crc32"] if checksums else ["decoded"]
    if set(added) & set(coded.columns):
        raise ValueError(f"rename the columns {sorted(set(added) & set(coded.columns))} first")
    ship_code(coded.sparkSession)
    k, kept = coded.columns.index(ids_col), [c for c in coded.columns if not checksums or c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.at(model)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                rows = [np.zeros(0, "<u4") if x.values is None else x.values.to_numpy(zero_copy_only=False).astype("<u4") for x in part.column(k)]
                new = [pa.array([pieces.decode(r) for r in rows], pa.string())]
                if checksums:
                    new += [pa.array([len(r) for r in rows], pa.int64()), pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())]
                yield pa.record_batch([*(part.column(c) for c in kept), *new], names=[*kept, *added])

    kinds = [T.StringType(), T.LongType(), T.LongType()]
    return coded.mapInArrow(run, _with(coded.select(*kept), *[T.StructField(n, t) for n, t in zip(added, kinds, strict=False)]))


def op5_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """Every row of ``documents`` encoded and decoded again: number and checksum of its ids, checksum of the decoded text."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = decode(encode(docs, model), model, checksums=True)
    return out.select("doc_id", "n_ids", "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"), (F.col("decoded") == F.col("text")).alias("round_trip"))
