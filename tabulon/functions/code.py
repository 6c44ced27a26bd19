"""Scalar functions on source code and labels, as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tabulon.session import ship_code

# The reserved words of either language, which are never renamed, in natural order.
PYTHON_RESERVED = """
False None True and as assert async await break class continue def del elif else except finally for from global if import in
is lambda nonlocal not or pass raise return try while with yield
self cls super object type print input range len open repr format int float str bool list dict set tuple bytes bytearray
memoryview complex abs all any bin chr dir divmod enumerate eval exec filter getattr globals hasattr hash hex id isinstance
issubclass iter locals map max min next oct ord pow reversed round setattr slice sorted sum vars zip
Exception ValueError TypeError KeyError IndexError AttributeError RuntimeError StopIteration NotImplementedError
__init__ __main__ __name__ __str__ __repr__ __len__ __iter__ __next__ __class__ __dict__
""".split()
JAVA_RESERVED = """
abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally
float for goto if implements import instanceof int interface long native new package private protected public return short
static strictfp super switch synchronized this throw throws transient try void volatile while true false null
String Integer Boolean Double Float Long Short Byte Character Object Number Math System StringBuilder StringBuffer List
ArrayList LinkedList Map HashMap TreeMap Set HashSet TreeSet Iterator Optional Exception RuntimeException
NullPointerException IllegalArgumentException Override Deprecated SuppressWarnings
out err in println print printf format main args length size toString equals hashCode compareTo getValue setValue get set
add remove contains isEmpty clear
""".split()
# Offset and prime of the 32-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
# File suffix by language; anything else is taken for Python.
SUFFIXES = {"python": ".py", "cpp": ".cpp", "java": ".java"}

RESERVED = {"python": PYTHON_RESERVED, "java": JAVA_RESERVED}


def fnv1a(name: Column) -> Column:
    """``h`` and eight hex digits of the 32-bit FNV-1a hash of the UTF-8 bytes; null stays null."""
    digits = F.hex(F.encode(name, "utf-8"))
    # Taken apart in one pass: a substring for each byte would look through the name from its beginning each time.
    octets = F.transform(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    mixed = F.aggregate(octets, F.lit(FNV_OFFSET), lambda h, b: ((h.bitwiseXOR(b)) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(name.isNotNull(), F.concat(F.lit("h"), F.lower(F.lpad(F.hex(mixed), 8, "0"))))


#: What Python's regular expressions take for a word's character: letters, all kinds of numbers and the underscore, but no combining marks.
WORD_CLASS = r"\p{L}\p{N}_"


def identifiers(code: Column, language: str) -> Column:
    """Distinct identifiers of a code text but for the reserved ones, in order of appearance.

    An identifier has ASCII characters only and stands between others than those of ``WORD_CLASS``; a combining mark ends it.
    """
    found = F.regexp_extract_all(code, F.lit(rf"(?<![{WORD_CLASS}])([a-zA-Z_][a-zA-Z0-9_]*+)(?![{WORD_CLASS}])"), F.lit(1))
    return F.array_except(found, F.array(*map(F.lit, RESERVED[language])))


#: Hashes of names that a worker keeps at most; most texts repeat the same ones.
NAMES_KEPT = 1 << 18

_WORD = re.compile(r"\w+")
_NAME = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


@lru_cache(NAMES_KEPT)
def _hidden(word: str, language: str) -> str:
    """What ``fnv1a`` gives for an ASCII name that is not reserved; any other word as it is."""
    if not _NAME.fullmatch(word) or word in RESERVED[language]:
        return word
    h = FNV_OFFSET
    for byte in word.encode():
        h = ((h ^ byte) * FNV_PRIME) & 0xFFFFFFFF
    return f"h{h:08x}"


def _obfuscator(language: str) -> Callable[[pa.Array], pa.Array]:
    def run(texts: pa.Array) -> pa.Array:
        rename = lambda found: _hidden(found[0], language)
        return pa.array([None if t is None else _WORD.sub(rename, t.decode("utf-8", "replace")) for t in texts.cast(pa.binary()).to_pylist()], pa.string())

    return run


def obfuscate(code: Column, language: str) -> Column:
    """Every identifier that is not reserved, also in comments and strings, replaced by its hash in a single pass.

    In Python on Arrow batches, which remembers the hashes of names; a built-in expression would hash every occurrence, a byte at a time.
    """
    ship_code(SparkSession.active())
    return F.arrow_udf(_obfuscator(language), "string")(code)


def symbol_map(code: Column, language: str) -> Column:
    """Original name to hash, sorted by name."""
    return F.map_from_entries(F.transform(F.array_sort(identifiers(code, language)), lambda n: F.struct(n, fnv1a(n))))


def obfuscate_by_language(code: Column, cleaned: Column, language: Column) -> Column:
    """The obfuscated cleaned code where the language is supported, the cleaned code where not."""
    return F.when(language == "python", obfuscate(F.when(language == "python", cleaned), "python")).when(language == "java", obfuscate(F.when(language == "java", cleaned), "java")).otherwise(F.coalesce(cleaned, code))


def escape(value: Column) -> Column:
    """Line breaks and single quotes escaped; backslashes are left as they are."""
    return F.replace(F.replace(value, F.lit("\n"), F.lit("\\n")), F.lit("'"), F.lit("\\'"))


def shorten(value: Column, length: int = 20) -> Column:
    """Values over ``length`` characters cut there, with three dots."""
    return F.when(F.length(value) > length, F.concat(F.substring(value, 1, length), F.lit("..."))).otherwise(value)


def suffix(language: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, language), F.lit(".py"))


def attributes(pairs: Column, label_key: str) -> Column:
    """``k='v', ...`` sorted by key from an array of (key, value), without the label's key and without empty values."""
    kept = F.filter(pairs, lambda p: (p["key"] != label_key) & (F.coalesce(p["value"], F.lit("")) != ""))
    ordered = F.array_sort(kept, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    return F.array_join(F.transform(ordered, lambda p: F.concat(p["key"], F.lit("='"), escape(p["value"]), F.lit("'"))), ", ")


def labelled(label: Column, attribute_text: Column) -> Column:
    """``[LABEL] attributes``, or the label alone."""
    return F.concat(F.lit("["), F.coalesce(label, F.lit("None")), F.lit("]"), F.when(attribute_text != "", F.concat(F.lit(" "), attribute_text)).otherwise(""))
