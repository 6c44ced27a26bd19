"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

import tiktoken

#: The split that the byte-level vocabulary was built for (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space as the split sees it, in a run too long for its look-ahead.
_LONG_RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{4096,}")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: visible Latin-1 characters stand for themselves, the
    remaining bytes, in order, for the characters from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encodes as ``tokenizers`` does with the same vocabulary file; special tokens in a text are ordinary text."""

    _open: dict[str, ByteBPE] = {}

    def __init__(self, vocabulary: str):
        stand = _byte_of_char()
        model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
        ranks = {}
        for piece, rank in model["vocab"].items():
            if all(c in stand for c in piece):
                ranks[bytes(stand[c] for c in piece)] = rank
        ranks.pop(b"<|endoftext|>", None)
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def at(cls, vocabulary: str) -> ByteBPE:
        """The encoder of this process for a vocabulary file, which must exist on every machine."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers.

        In a long run of white space all but the last character, which goes with what follows, are one word.
        """
        ids, at = array("I"), 0
        if len(text) >= 4096:
            for run in _LONG_RUN.finditer(text):
                ids.extend(self.encoding.encode_ordinary(text[at : run.start()]))
                at = run.end() - (run.end() < len(text))
                ids.extend(self.encoding._encode_single_piece(text[run.start() : at]))
        ids.extend(self.encoding.encode_ordinary(text[at:]))
        return ids.tobytes()


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


__all__ = ["PATTERN", "ByteBPE", "default_vocabulary"]
