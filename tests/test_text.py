import pytest
from pyspark.sql import functions as F

from notewright.functions import text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


def sections(spark, note):
    df = spark.createDataFrame([(1, note)], "id long, note string")
    r = T.with_sections(df, "note").first()["sections"]
    return r["subjective"], r["objective"], r["assessment"], r["plan"]


def test_white_space_tokens_and_normal_forms(spark):
    assert one(spark, " Chest Pain\t now ", T.tokens_ws) == ["chest", "pain", "now"]
    assert one(spark, "", T.tokens_ws) == []
    assert one(spark, None, T.tokens_ws) == []
    assert one(spark, "  A \n b  ", T.normalize_text) == "a b"
    assert one(spark, "Dr. Smith's -- note!", T.normalize_entity_text) == "dr smiths note"
    assert one(spark, "Émile's café 2x", T.tokens_alnum) == ["mile", "s", "caf", "2x"]
    assert one(spark, "abcdef", lambda c: T.truncate_chars(c, 3)) == "abc"


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [
        ("Hello, world.", ["Hello", ",", "world", "."]),
        ("3.5 mg (twice)", ["3.5", "mg", "(", "twice", ")"]),
        ("well-known 10-20", ["well-known", "10", "-", "20"]),
        ("a &amp; b &lt;c&gt;", ["a", "&", "b", "<", "c", ">"]),
        ("broken-\nword\nnext", ["brokenword", "next"]),
    ],
)
def test_tokens_13a(spark, raw, tokens):
    assert one(spark, raw, T.tokens_13a) == tokens


def test_sections_strict(spark):
    note = "**1. Subjective:** a\n**2. Objective:**\nb\n\n**3. Assessment:** c **4. Plan:** d\ne "
    assert sections(spark, note) == ("a", "b", "c", "d\ne")


@pytest.mark.parametrize(
    ("note", "expected"),
    [
        ("Subjective:\ncough\nObjective:\nBP\nAssessment:\ncold\nPlan:\nrest", ("cough", "BP", "cold", "rest")),
        ("Subjective: x Objective: y", ("x", "y", "", "")),
        ("Subjective: x\nPlan: z", ("x", "", "", "z")),
        ("Plan: z\nSubjective: x", ("x", "", "", "z")),
        ("We are planning ahead", ("", "", "", "ning ahead")),
        ("", ("", "", "", "")),
        (None, ("", "", "", "")),
        ("nothing here", ("", "", "", "")),
    ],
)
def test_sections_loose(spark, note, expected):
    assert sections(spark, note) == expected


def test_compose_then_split_is_identity(spark):
    bodies = [("a\nb", "", "c: d", "last"), ("", "", "", ""), ("plan", "x", "y", "z")]
    df = spark.createDataFrame(bodies, "a string, b string, c string, d string")
    note = df.select("*", T.compose_note([F.col(c) for c in "abcd"]).alias("note"))
    got = T.with_sections(note, "note").select("a", "b", "c", "d", "sections.*").collect()
    assert all(tuple(r)[:4] == tuple(r)[4:] for r in got)


def test_section_flags_have_no_word_boundary(spark):
    r = one(spark, "planning; SUBJECTIVE", T.section_flags)
    assert (r["subjective"], r["objective"], r["plan"], r["all_headers"]) == (True, False, True, False)


@pytest.mark.parametrize(
    ("note", "expected"),
    [
        ("short", "short"),
        ("x" * 12 + "#####" + "y" * 10, "x" * 12),
        ("x" * 4 + "#####" + "y" * 20, "x" * 4 + "#####" + "y" * 11),
        ("x" * 15 + "\n\n" + "y" * 20, "x" * 15),
        ("x" * 8 + "\n\n" + "y" * 30, "x" * 8 + "\n\n" + "y" * 10),
        ("x" * 15 + ". " + "y" * 20, "x" * 15 + "."),
        ("x" * 15 + ".\n" + "y" * 20, "x" * 15 + "."),
        ("x" * 18 + "  " + "y" * 20, "x" * 18),
        (None, ""),
    ],
)
def test_smart_truncate(spark, note, expected):
    df = spark.createDataFrame([(note,)], "note string")
    assert T.smart_truncate(df, "note", F.lit(20)).first()["note"] == expected


def test_every_white_space_character_cuts_words_and_no_other(spark):
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    near = "\x08\x0e\x1b!\x84\x86\x9f\xa1\u167f\u1681\u180e\u1fff\u200b\u2027\u202a\u205e\u2060\u2fff\u3001\ufeff"
    df = spark.createDataFrame([(f"{c}a{c}{c}b{c}",) for c in space + near] + [("",), (None,)], "t string")
    found = [r.w for r in df.select(T.words(F.col("t")).alias("w")).collect()]
    assert found == [["a", "b"]] * len(space) + [[f"{c}a{c}{c}b{c}"] for c in near] + [[], []]


def test_few_words_without_cutting(spark):
    texts = ["", "a", "a b", "a b c", "  a  b  ", "abcdefgh", "abc def ghi", "a\u2003b\xa0c", "long words only", "      ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    both = df.select(T.has_few_words(F.col("t"), 2).alias("few"), (T.word_count(F.col("t")) <= 2).alias("counted")).collect()
    assert [r.few for r in both] == [r.counted for r in both] == [True, True, True, False, True, True, False, False, False, True, True]
