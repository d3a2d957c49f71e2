"""Spelling variants by permuterm rotations.

A word marked with a terminator has one rotation for each place in it: what follows the place, the terminator, what comes before. Two words a·c·b and a·d·b that differ in one
character have rotations b$a·c and b$a·d, which differ in their last character alone, and a·b, which lacks it, has the rotation b$a itself. So in the sorted list of all rotations the words
near to each other lie in one prefix range: the range of b$a holds that rotation, if it is a word's, and all one character longer. Each rotation is therefore written twice, once under
itself and once, where it doesn't end in the terminator, under itself without its last character. Rows are shuffled and sorted by this prefix and every group is scanned once: each member gets the
number of its neighbours there and the best of them, never the pairs. A character equal to the one before it could be deleted in several places with the same result; only the first of such a run meets the shorter word,
so no neighbour counts twice.

A group has at most one word for each character of the alphabet, and one more. Words are numbered in code-point order, so a row carries a number and not a word. Prefixes of
more than ``LONG`` characters are represented by their first ``LONG`` characters and a 128-bit hash of all, which bounds a row whatever a word's length; work on such a word is quadratic in its length.

``variants`` of an empty table is empty. Null texts have no words. A null id counts as the text "null" where occurrences are changed. Repeated rows count again. Words that occur once or are short are no words here. Ties
between neighbours go to the smaller word in code-point order. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from notewright.llm.common import task_count, text_of
from notewright.llm.sharding import _offsets, _with_task
from notewright.session import stage

RUN = r"[A-Za-zÀ-ÿ]"
# Written $ above; no word may hold it.
END = "\0"
LONG = 64
ROWS_PER_TASK = 200_000


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_table(
    docs: DataFrame, least: int = 7, occurrences: int = 2, damage: int | None = None, id_col: str = "doc_id", text_col: str = "text", run: str = RUN
) -> DataFrame:
    """Rows (word, n): the runs of whole texts in ASCII lower case, of at least ``least`` code points, that occur at least ``occurrences`` times.

    With ``damage`` an occurrence whose CRC-32 of "<id>:<run>" it divides loses the code point at that number modulo the run's length, as a test of spelling errors.
    """
    # Shorter runs can only get shorter, so they are not even listed.
    runs = F.regexp_extract_all(lower_ascii(text_of(text_col)), F.lit(f"{run}{{{least},}}"), 0)
    words = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), F.explode(runs).alias("word"))
    if damage:
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
        words = (
            words.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word")))
            .select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("word")).alias("word"))
            .filter(F.length("word") >= least)
        )
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


def numbered(words: DataFrame) -> DataFrame:
    """Words with ``id``: their place in code-point order, from 0; written to the shared folder."""
    words = stage(words, "words")
    tasks = task_count(words.sparkSession, words.count(), ROWS_PER_TASK)
    placed = _with_task(words, tasks, "word", name="words-in-order")
    own = F.row_number().over(Window.partitionBy("task").orderBy("word")) - 1
    return stage(placed.withColumn("own", own).join(_offsets(placed, F.count("*")), "task").select((F.col("own") + F.col("before")).cast("long").alias("id"), "word", "n"), "numbered-words")


def rotations(words: DataFrame) -> DataFrame:
    """Rows (prefix, id, n, whole, meets): every rotation under itself (``whole``) and under itself without its last character.

    ``meets``: the word that lacks the character is a neighbour by way of this row.
    """
    word, at = F.col("word"), F.col("at")
    length = F.length(word)
    turned = words.select("id", "n", "word", F.explode(F.sequence(F.lit(0), length)).alias("at")).select(
        "id",
        "n",
        F.concat(F.substring(word, at + 1, length), F.lit(END), F.substring(word, F.lit(1), at)).alias("rotation"),
        (at > 0).alias("longer"),
        ((at == 1) | (F.substring(word, at, F.lit(1)) != F.substring(word, at - 1, F.lit(1)))).alias("meets"),
    )
    size = F.length("rotation")
    forms = F.array(
        F.struct(F.col("rotation").alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("meets")),
        F.when(F.col("longer"), F.struct(F.substring("rotation", F.lit(1), size - 1).alias("prefix"), F.lit(False).alias("whole"), F.col("meets").alias("meets"))),
    )
    long = F.concat_ws(" ", F.substring("prefix", 1, LONG), F.hex(F.xxhash64("prefix")), F.hex(F.xxhash64(F.lit(END), "prefix")))
    return (
        turned.select("id", "n", F.explode(F.array_compact(forms)).alias("f"))
        .select("id", "n", "f.*")
        .withColumn("prefix", F.when(F.length("prefix") > LONG, long).otherwise(F.col("prefix")))
    )


def neighbours(words: DataFrame) -> DataFrame:
    """Numbered words -> rows (id, n_near, best_n, best_id) for those with a word at one insertion, deletion or replacement.

    The best neighbour has the largest n, then the smallest id.
    """
    rank = [F.col("n").desc(), F.col("id")]
    group = Window.partitionBy("prefix")
    # Whole rotations (at most one of a prefix) are linked with the longer ones that meet them; longer ones with each other.
    scanned = rotations(words).select(
        "*",
        F.count("*").over(group).alias("members"),
        F.count_if("meets").over(group).alias("n_meet"),
        F.count_if("whole").over(group).alias("n_whole"),
        F.max(F.when(F.col("whole"), F.struct("n", (-F.col("id")).alias("i")))).over(group).alias("shorter"),
        F.max(F.when(F.col("meets"), F.struct("n", (-F.col("id")).alias("i")))).over(group).alias("met"),
        F.max(F.when(~F.col("whole"), F.struct("n", (-F.col("id")).alias("i")))).over(group).alias("first"),
    )
    own = F.struct("n", (-F.col("id")).alias("i"))
    # The runner-up of the longer ones is needed by the first of them only: the next below it in rank.
    second = F.max(F.when(~F.col("whole"), own)).over(group.orderBy(F.col("whole"), *rank).rowsBetween(1, Window.unboundedFollowing))
    best = F.greatest(
        F.when(F.col("meets"), F.col("shorter")), F.when(own == F.col("first"), F.col("second")).otherwise(F.col("first"))
    )
    linked = (
        scanned.filter("members > 1")
        .withColumn("second", second)
        .select(
            "id",
            F.when(F.col("whole"), F.col("n_meet")).otherwise(F.col("members") - F.col("n_whole") - 1 + F.when(F.col("meets"), F.col("n_whole")).otherwise(0)).alias("n_near"),
            F.when(F.col("whole"), F.col("met")).otherwise(best).alias("best"),
        )
        .filter("n_near > 0")
    )
    return linked.groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best")).select(
        "id", "n_near", F.col("best.n").alias("best_n"), (-F.col("best.i")).alias("best_id")
    )


def roots(forms: DataFrame) -> DataFrame:
    """Rows (id, form_id) -> (id, root), the end of each chain of forms; every round doubles the steps taken.

    Counts grow along a chain, so it has an end. A form has at most as many words as there are ways to change one character.
    """
    links = stage(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        onward = links.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = stage(links.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = stepped.select("id", "root")
        if not stepped.agg(F.count_if("moved")).first()[0]:
            return links


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """Distinct words (word, n) -> rows (word, form, root, n, n_near, form_n).

    ``form``: the near word with the largest n, if that is at least ``times`` the word's own; ``root``: the end of the chain of forms, the word itself without one.
    """
    words = numbered(words)
    near = words.join(neighbours(words), "id", "left")
    is_form = F.col("best_n") >= F.col("n") * times
    found = stage(
        near.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"), F.when(is_form, F.col("best_id")).alias("form_id")),
        "forms",
    )
    names = words.select(F.col("id").alias("to"), F.col("word").alias("name"))
    formed = found.filter("form_id is not null")
    ends = (
        formed.select("id", "form_id").join(roots(formed), "id")
        .join(names.select(F.col("to").alias("form_id"), F.col("name").alias("form")), "form_id")
        .join(names.select(F.col("to").alias("root"), F.col("name").alias("last")), "root")
        .select("id", "form", "last")
    )
    return found.join(ends, "id", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
