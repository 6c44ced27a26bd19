import re

from pyspark.sql import functions as F

from tabulon.functions import code, effects


def fnv(text):
    h = code.FNV_OFFSET
    for b in text.encode():
        h = ((h ^ b) * code.FNV_PRIME) % 2**32
    return f"h{h:08x}"


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_fnv_equals_the_definition(spark):
    for text in ("", "a", "foo_bar", "naïve", "変数"):
        assert one(spark, text, code.fnv1a) == fnv(text)
    assert one(spark, None, code.fnv1a) is None


def test_identifiers_leave_out_reserved_words(spark):
    text = "def f(x): return x + value1 # naïve 9lives"
    want = [w for w in dict.fromkeys(re.findall(r"\b([a-zA-Z_][a-zA-Z0-9_]*)\b", text)) if w not in code.PYTHON_RESERVED]
    assert one(spark, text, lambda c: code.identifiers(c, "python")) == want


def test_obfuscation_renames_whole_words_once(spark):
    text = "for item in items: print(item, 'item')"
    got = one(spark, text, lambda c: code.obfuscate(c, "python"))
    assert got == f"for {fnv('item')} in {fnv('items')}: print({fnv('item')}, '{fnv('item')}')"


def test_language_dispatch_falls_back(spark):
    rows = [("c", "x = 1", "python"), ("c", "x = 1", "cpp"), ("raw", None, None)]
    df = spark.createDataFrame(rows, "code string, cleaned string, language string")
    got = [r[0] for r in df.select(code.obfuscate_by_language(F.col("code"), F.col("cleaned"), F.col("language"))).collect()]
    assert got == [f"{fnv('x')} = 1", "x = 1", "raw"]


def test_escape_shorten_suffix(spark):
    assert one(spark, "it's\nso \\", code.escape) == "it\\'s\\nso \\"
    assert one(spark, "x" * 20, code.shorten) == "x" * 20
    assert one(spark, "x" * 21, code.shorten) == "x" * 20 + "..."
    assert [one(spark, v, code.suffix) for v in ("java", "cpp", "go", None)] == [".java", ".cpp", ".py", ".py"]


def test_effect_bounds(spark):
    values = [(-0.474,), (0.33,), (0.147,), (0.1,)]
    assert [r[0] for r in spark.createDataFrame(values, "d double").select(effects.cliff_effect(F.col("d"))).collect()] == ["Large", "Medium", "Small", "Negligible"]
    values = [(0.061,), (0.06,), (0.01,), (0.001,), (0.0,)]
    assert [r[0] for r in spark.createDataFrame(values, "d double").select(effects.eta_effect(F.col("d"))).collect()] == ["Large", "Medium", "Medium", "Small", "Negligible"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (9.0,), (1.0,)], "v double")
    assert [r[0] for r in df.select(effects.clip_above(F.col("v"), F.lit(5.0))).collect()] == [None, 5.0, 1.0]
