"""Which short texts stand in which longer ones, as an equality join on anchors.

Every needle is keyed by one of its character grams, the rarest in the texts to be searched. A text lists each of its grams once. Where a gram
is a needle's anchor, the needle is looked for in the text itself, so the result is exact and the rows made are at most as many as the text has places,
whatever the lengths of the needles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright import parallel
from notewright.session import stage

# Characters of a gram. Shorter needles are their own anchors.
GRAM = 4
# Long texts are searched in stretches of this many characters, which overlap by the longest needle.
STRETCH = 1024


def grams(col: Column, sizes: Sequence[int]) -> Column:
    """The different substrings of ``sizes`` characters of a text, in time linear in its length."""
    # A look-ahead matches at every place without using it up; the first character is not the second half of one.
    lists = [F.regexp_extract_all(col, F.lit(rf"(?s)(?=([^\x{{DC00}}-\x{{DFFF}}].{{{n - 1}}}))"), 1) for n in sizes]
    return F.array_distinct(F.concat(*lists))


def _stretches(texts: DataFrame, longest: int) -> DataFrame:
    step = max(STRETCH, longest)
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("low") - 1, F.lit(0)) / step).cast("int"))
    cut = F.substring("low", F.col("i") * step + 1, F.lit(step + longest - 1))
    return texts.withColumn("i", F.explode(starts)).withColumn("cut", cut).drop("i")


def anchors(words: DataFrame, texts: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """``word, anchor`` for the distinct ``words``: the gram that the fewest of the distinct texts (``low``, ``n``) have.

    A word with a gram that no text has stands nowhere and gives no row.
    """
    counts = texts.select("n", F.explode(grams(F.col("low"), sizes)).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n"))
    own = [F.when(F.length("word") == n, F.array(F.col("word"))) for n in sizes if n < GRAM]
    listed = words.select("word", F.explode(F.coalesce(*own, grams(F.col("word"), [GRAM]))).alias("gram"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")
    return listed.join(counts.hint("merge"), "gram", "left").groupBy("word").agg(rarest).filter("rarest.n > 0").select("word", F.col("rarest.gram").alias("anchor"))


def occurrences(
    texts: DataFrame, needles: DataFrame, on: Sequence[str] = (), keep: Sequence[str] = (), longer: bool = False
) -> DataFrame:
    """Distinct ``keep`` columns of ``texts`` and ``word`` of ``needles``, where the word stands in the text and ``on`` agrees.

    ``texts`` has the text in ``low``, ``needles`` theirs in ``word``; both are read several times. Empty and null texts and words
    take no part. With ``longer`` a text that equals the word does not count. The needles with their anchors are written once, so that their true
    size says whether they are sent to the texts; the texts, of which a copy goes with each gram, never are sent.
    """
    texts, needles = texts.filter("low <> ''"), needles.filter("word <> ''")
    words = needles.select("word").distinct()
    sizes, longest = words.agg(F.sort_array(F.collect_set(F.least(F.length("word"), F.lit(GRAM)))), F.max(F.length("word"))).first()
    sizes, longest = sizes or [GRAM], longest or 1
    cuts = _stretches(texts, longest)
    counted = cuts.select(F.col("cut").alias("low"), F.lit(1).alias("n"))
    keyed = stage(needles.join(anchors(words, counted, sizes).hint("merge"), "word").select(*on, "anchor", "word"), "keyed")
    columns = list(dict.fromkeys([*on, *keep]))
    found = (
        cuts.select(*columns, "cut", F.length("low").alias("size"), F.explode(grams(F.col("cut"), sizes)).alias("anchor"))
        .join(parallel.sent_if_small(keyed), [*on, "anchor"])
        .filter(F.contains("cut", F.col("word")))
    )
    if longer:
        found = found.filter(F.col("size") > F.length("word"))
    return found.select(*keep, "word").distinct()


def held_words(texts: DataFrame, needles: DataFrame, longer: bool = False) -> DataFrame:
    """Distinct ``low, word``: which different words stand in which different texts, whatever rows they come from.

    For tables that repeat their texts in many rows: each different text is searched once, and a row then looks up its own text. A text
    meets at most as many words as it has substrings. Written once.
    """
    lows = stage(texts.select("low").distinct(), "lows")
    words = stage(needles.select("word").distinct(), "needles")
    return stage(occurrences(lows, words, keep=["low"], longer=longer), "held-words")
