"""Words and their places against a plain search."""

import re

import pyarrow as pa
from conftest import rows

from notewright.functions import places
from notewright.operators import entities as E

TEXTS = ["", None, "abc", "def Ghi", "  a1-é😀x ", "K9", "…", "no\nYES", "é", "A" * 40, "a b" * 30]


def plain(text):
    return [(m.group().lower(), m.start()) for m in re.finditer("[A-Za-z0-9]+", text or "")]


def test_words_equal_a_plain_search_in_any_stretch(monkeypatch):
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(places, "STRETCH", size)
        for begin in (0, 3):
            got = places.find_words(pa.array(TEXTS).slice(begin)).to_pylist()
            assert [[(w["word"], w["start"]) for w in ws] for ws in got] == [plain(t) for t in TEXTS[begin:]]
    assert places.find_words(pa.array([], pa.string())).to_pylist() == []


def test_a_letter_behind_a_word_that_falls_to_ascii_is_no_part_of_it(spark):
    df = spark.createDataFrame([(1, "abK cd")], "id long, text string")  # the Kelvin sign has a lower-case k
    assert rows(E.word_pieces(df)) == [(1, 0, "ab", 0, 2), (1, 1, "cd", 4, 6)]


def test_tagging_moves_texts_once(spark):
    df = spark.createDataFrame([(1, "knee pain")], "id long, text string")
    lexicon = spark.createDataFrame([("knee", "symptom", 0.5)], "phrase string, label string, score double")
    plan = E.tag_lexicon(df, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count(" Window") == 1
