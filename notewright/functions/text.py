"""Column expressions over text. Nothing here leaves the JVM."""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.schema import SECTIONS

# Unicode white space, so that no-break spaces separate words too. Written out, as single characters below 256 are one look-up
# and all others lie in one range that is asked first; a class of many ranges asks them one by one for each character.
WS = r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
_STRIP_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def text_or_empty(c: Column) -> Column:
    """Null text counts as empty text everywhere."""
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_STRIP_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_STRIP_CHARS))


def is_blank(c: Column) -> Column:
    return strip(text_or_empty(c)) == ""


def words(c: Column) -> Column:
    return F.array_remove(F.split(text_or_empty(c), WS), "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def has_few_words(c: Column, n: int) -> Column:
    """At most ``n`` words. The text is only cut where neither its length nor its number of white-space characters says so."""
    text = text_or_empty(c)
    spaces = F.length(text) - F.length(F.translate(text, _STRIP_CHARS, ""))
    return F.when(F.length(text) <= 2 * n, True).when(spaces < n, True).otherwise(word_count(text) <= n)


def tokens_ws(c: Column) -> Column:
    """Lower-cased white-space tokens."""
    return words(F.lower(c))


def tokens_alnum(c: Column) -> Column:
    """ROUGE tokens: runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9]+"), 0)


# The steps of the "13a" tokeniser, in order: (pattern, replacement).
_TOKENS_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)


def tokens_13a(c: Column) -> Column:
    """BLEU tokens, as the "13a" scheme of machine-translation scoring cuts them."""
    out = text_or_empty(c)
    for old, new in (
        ("<skipped>", ""),
        ("-\n", ""),
        ("\n", " "),
        ("&quot;", '"'),
        ("&amp;", "&"),
        ("&lt;", "<"),
        ("&gt;", ">"),
    ):
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, replacement in _TOKENS_13A:
        out = F.regexp_replace(out, pattern, replacement)
    return words(out)


def substrings(col: Column, longest: Column | None = None) -> Column:
    """The different non-empty substrings of a short text, those up to ``longest`` characters; null if there are none."""
    size = F.length(col)
    top = size if longest is None else F.least(size, longest)
    parts = F.transform(
        F.sequence(F.lit(1), top),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda b: F.substring(col, b, n)),
    )
    return F.when(top > 0, F.array_distinct(F.flatten(parts)))


def truncate_chars(c: Column, n: int) -> Column:
    return F.substring(text_or_empty(c), 1, n)


def normalize_text(c: Column) -> Column:
    """Lower case, white space collapsed, ends trimmed."""
    return strip(F.regexp_replace(F.lower(text_or_empty(c)), WS, " "))


def normalize_entity_text(c: Column) -> Column:
    """As :func:`normalize_text`, with ASCII punctuation deleted first."""
    return normalize_text(F.translate(F.lower(text_or_empty(c)), string.punctuation, ""))


# ------------------------------------------------------------------ sections


def loose_header(number: int, name: str) -> str:
    """A header with optional number, colon and asterisks, in any case.

    There is no word boundary: "planning" counts as a "Plan" header.
    """
    return rf"(?i)\*{{0,2}}\s*(?:{number}[.\):]?\s*)?{re.escape(name)}\s*:?\s*\*{{0,2}}"


def strict_headers(names: Sequence[str]) -> str:
    parts = [rf"\*\*{i}\.\s*{re.escape(n)}:\*\*(.*?)" for i, n in enumerate(names, 1)]
    return "(?s)" + "".join(parts)[: -len("(.*?)")] + "(.*)"


def section_flags(note: Column, names: Sequence[str] = SECTIONS) -> Column:
    """Struct of booleans, one per header in lower case, and ``all_headers``."""
    note = text_or_empty(note)
    flags = {n.lower(): note.rlike(loose_header(i, n)) for i, n in enumerate(names, 1)}
    every = reduce(lambda a, b: a & b, flags.values())
    return F.struct(*[v.alias(k) for k, v in flags.items()], every.alias("all_headers"))


def with_sections(
    df: DataFrame, col: str, names: Sequence[str] = SECTIONS, out: str = "sections"
) -> DataFrame:
    """Add ``out``: a struct of section bodies, one field per header in lower case.

    A body is ``''`` where absent. A note in the strict numbered bold layout is cut by
    that layout. Otherwise the first hit of each header counts, and a body runs from the
    end of its header to the start of the next one. ``{out}_begin`` has the place where
    each header starts, null where it is missing.

    Each header is looked for once per note: the steps are projections of their own.
    """
    pattern = strict_headers(names)
    note, hits = F.col("_note"), F.col("_hits")
    headers = [loose_header(i, n) for i, n in enumerate(names, 1)]

    def hit(around: Column) -> Column:
        begin = F.length(F.get(around, F.lit(0)))
        end = F.length(note) - F.length(F.get(around, F.lit(1)))
        return F.when(F.size(around) == 2, F.struct(end.alias("e"), begin.alias("b")))

    def body(k: int) -> Column:
        own = hits[k]
        later = F.array_min(F.filter(hits, lambda h: h["e"] > own["e"]))
        end = F.coalesce(later["b"], F.length(note))
        return F.coalesce(
            F.substring(note, own["e"] + 1, F.greatest(end - own["e"], F.lit(0))), F.lit("")
        )

    def cut(k: int) -> Column:
        return strip(F.when(F.col("_strict"), F.regexp_extract(note, pattern, k + 1)).otherwise(body(k)))

    return (
        df.withColumn("_note", text_or_empty(F.col(col)))
        .withColumns({f"_around_{k}": F.split(note, h, 2) for k, h in enumerate(headers)})
        .withColumns(
            {
                "_strict": note.rlike(pattern),
                "_hits": F.array(*[hit(F.col(f"_around_{k}")) for k in range(len(names))]),
            }
        )
        .withColumn(out, F.struct(*[cut(k).alias(n.lower()) for k, n in enumerate(names)]))
        .withColumn(f"{out}_begin", F.transform(hits, lambda h: h["b"]))
        .select(*[c for c in df.columns if c != out], out, f"{out}_begin")
    )


def compose_note(bodies: Sequence[Column], names: Sequence[str] = SECTIONS) -> Column:
    """The strict layout; inverse of :func:`with_sections`."""
    return F.concat_ws(
        "\n\n",
        *[
            F.concat(F.lit(f"**{i}. {n}:**\n"), text_or_empty(b))
            for i, (n, b) in enumerate(zip(names, bodies), 1)
        ],
    )


# ---------------------------------------------------------------- truncation


def last_index(c: Column, needle: str) -> Column:
    """0-based position of the last ``needle``; negative where there is none."""
    return F.when(
        F.contains(c, F.lit(needle)),
        F.length(c) - F.length(F.substring_index(c, needle, -1)) - len(needle),
    ).otherwise(-1)


def smart_truncate(df: DataFrame, col: str, target: Column) -> DataFrame:
    """Shorten ``col`` to about ``target`` characters at a heading, paragraph or sentence end.

    Each step is a projection of its own, so that no step is worked out more than once.
    """
    note, cut, mark = F.col("_note"), F.col("_cut"), F.col("_mark")
    room = F.length(cut) * 0.7
    return (
        df.withColumn("_note", text_or_empty(F.col(col)))
        .withColumn("_target", target.cast("int"))
        .withColumn("_cut", F.substring(note, F.lit(1), F.col("_target")))
        .withColumn("_mark", last_index(cut, "#####"))
        .withColumn(
            "_cut",
            F.when(mark > F.col("_target") * 0.5, rstrip(F.substring(cut, F.lit(1), mark))).otherwise(cut),
        )
        .withColumn("_paragraph", last_index(cut, "\n\n"))
        .withColumn("_sentence", F.greatest(last_index(cut, ". "), last_index(cut, ".\n")))
        .withColumn(
            col,
            F.when(F.length(note) <= F.col("_target"), note)
            .when(F.col("_paragraph") > room, rstrip(F.substring(cut, F.lit(1), F.col("_paragraph"))))
            .when(F.col("_sentence") > room, rstrip(F.substring(cut, F.lit(1), F.col("_sentence") + 1)))
            .otherwise(rstrip(cut)),
        )
        .select(*df.columns)
    )
