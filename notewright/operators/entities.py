"""Entity tables: parse, relabel, clean, deduplicate, tag, normalise, compare.

An entity table has one row per entity: ``id, pos, text, label, score`` and,
where spans matter, ``negated, start, end`` (0-based character offsets).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright import parallel
from notewright import schema as S
from notewright.functions.places import word_places
from notewright.functions.text import (
    has_few_words,
    normalize_entity_text,
    strip,
    substrings,
    text_or_empty,
)
from notewright.operators.containment import held_words
from notewright.session import stage


# A table of so many short phrases is small enough to be broadcast.
LARGE_LEXICON = 60_000


def literal_map(pairs: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    return F.exists(literal_array(needles), lambda k: F.contains(text, k))


def where_made(df: DataFrame, condition: Column) -> DataFrame:
    """``df`` filtered by columns made in it. A plain filter would be moved below the steps that make them, and they would run twice."""
    return df.select("*", F.explode_outer(F.array(condition)).alias("_keep")).filter("_keep").drop("_keep")


# ------------------------------------------------------------------- parsing


def _variant_list(text: Column) -> Column:
    """The JSON list in ``text`` as array of variants; null for anything else."""
    return F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")


def parse_entities(
    df: DataFrame, col: str = "response", id_col: str = "id", accept_object: bool = False
) -> DataFrame:
    """Raw entities of a JSON cell: ``id, pos, text, label, score``.

    Code fences are removed. The text is read as a list; failing that, the part from
    the first ``[`` to the last ``]``. Items that are not objects, or lack a text or
    a label, are skipped. With ``accept_object`` a ``{"entities": […]}`` cell counts too.
    """
    text = strip(F.replace(F.replace(text_or_empty(F.col(col)), F.lit("```json"), F.lit("")),
                           F.lit("```"), F.lit("")))
    sliced = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    attempts = [_variant_list(text), _variant_list(sliced)]
    if accept_object:
        attempts.insert(
            0, F.try_variant_get(F.try_parse_json(text), "$.entities", "array<variant>")
        )
    items = df.select(
        F.col(id_col).alias("id"), F.posexplode(F.coalesce(*attempts)).alias("pos", "item")
    )
    fields = items.select(
        "id",
        F.col("pos").cast("long").alias("pos"),
        F.try_variant_get("item", "$.text", "string").alias("text"),
        F.try_variant_get("item", "$.label", "string").alias("label"),
        F.try_variant_get("item", "$.score", "double").alias("score"),
    )
    return where_made(fields, F.col("text").isNotNull() & F.col("label").isNotNull())


def canonical_label(
    entities: DataFrame,
    synonyms: Mapping[str, str] = S.LABEL_SYNONYMS,
    labels: Sequence[str] = S.ENTITY_LABELS,
    max_words: int = S.MAX_SPAN_WORDS,
    default_score: float = S.DEFAULT_SCORE,
) -> DataFrame:
    """Map label spellings, keep known labels and plausible spans, clamp the score."""
    label = F.lower(strip(F.col("label")))
    score = F.coalesce(F.col("score"), F.lit(default_score))
    spelled = entities.withColumns(
        {"text": strip(F.col("text")), "label": F.coalesce(F.try_element_at(literal_map(synonyms), label), label)}
    )
    kept = where_made(
        spelled, F.col("label").isin(*labels) & (F.length("text") > 1) & has_few_words(F.col("text"), max_words)
    )
    return kept.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4))


def entities_json(entities: DataFrame) -> DataFrame:
    """One JSON list cell per id, in ``pos`` order; inverse of :func:`parse_entities`."""
    item = F.struct("pos", F.struct("text", "label", "score").alias("entity"))
    ordered = F.sort_array(F.collect_list(item))
    return entities.groupBy("id").agg(F.to_json(ordered["entity"]).alias("entities_json"))


# ------------------------------------------------------------------ cleaning


def clean_spans(
    entities: DataFrame,
    phrases: Sequence[str] = S.FILLER_PHRASES,
    max_words: int = S.MAX_SPAN_WORDS,
) -> DataFrame:
    """Trim, straighten quotes, peel leading filler phrases, drop long and tiny spans."""
    filler = "(?iU)^(?:(?:" + "|".join(re.escape(p).replace(r"\ ", " ") for p in phrases) + r")\s*)+"
    straight = F.translate(strip(F.col("text")), "’‘", "''")
    peeled = F.when(has_few_words(F.col("text"), max_words), strip(F.regexp_replace("text", filler, "")))
    return where_made(entities.withColumn("text", straight).withColumn("text", peeled), F.length("text") > 1)


def adaptive_threshold(
    entities: DataFrame,
    high: float = S.PRIMARY_THRESHOLD,
    low: float = S.FALLBACK_THRESHOLD,
    minimum: int = S.MIN_ENTITIES,
) -> DataFrame:
    """Entities at ``high`` or above; documents left with fewer than ``minimum`` use ``low``.

    The sure ones are counted along the document, so a table that is cut by ``id`` is not shuffled. Entities
    without an id belong to no document and use ``high``.
    """
    sure = F.col("score") >= high
    n = F.count_if(sure).over(Window.partitionBy("id"))
    weak = F.col("id").isNotNull() & (n < minimum)
    return entities.filter(F.col("score") >= F.least(F.lit(low), F.lit(high))).withColumn("_weak", weak).filter(sure | F.col("_weak")).drop("_weak")


def relabel_broad(
    entities: DataFrame,
    diagnosis_keywords: Sequence[str] = S.DIAGNOSIS_KEYWORDS,
    follow_up_keywords: Sequence[str] = S.FOLLOW_UP_KEYWORDS,
    specialist_pattern: str = S.SPECIALIST_PATTERN,
    doctor_pattern: str = S.DOCTOR_PATTERN,
    dosage_pattern: str = S.DOSAGE_PATTERN,
    vital_pattern: str = S.VITAL_PATTERN,
) -> DataFrame:
    """Four broad labels to the ten fine ones by pattern and keyword; others stay."""
    text = F.col("text")
    lowered = F.lower(strip(text))
    broad = F.col("label")
    is_diagnosis = contains_any(lowered, diagnosis_keywords)
    fine = (
        F.when(broad == "subjective finding", F.when(is_diagnosis, "diagnosis").otherwise("symptom"))
        .when(
            broad == "objective finding",
            F.when(text.rlike(vital_pattern), "vital sign")
            .when(is_diagnosis, "diagnosis")
            .otherwise("physical exam finding"),
        )
        .when(
            broad == "treatment",
            F.when(text.rlike(doctor_pattern) | text.rlike(specialist_pattern), "referral")
            .when(text.rlike(dosage_pattern), "drug detail")
            .when(contains_any(lowered, follow_up_keywords), "follow-up instruction")
            .otherwise("medication"),
        )
        .when(broad == "test", "test or lab order")
        .otherwise(broad)
    )
    return entities.withColumn("label", fine)


def promote_chief(
    entities: DataFrame,
    symptom: str = "symptom",
    chief: str = "chief complaint",
    only_if_absent: bool = False,
) -> DataFrame:
    """Relabel each document's best symptom as its chief complaint.

    Best is the highest score, the earlier one on ties; of several symptoms with that
    text the first is relabelled. With ``only_if_absent`` documents that already have a
    chief complaint stay as they are. All is looked up along the document, so a table that is cut by ``id`` is not shuffled.
    """
    document = Window.partitionBy("id")
    is_symptom = (F.col("label") == symptom) & F.col("id").isNotNull()
    best = F.max(F.when(is_symptom, F.struct("score", (-F.col("pos")).alias("back"), "text")))
    first = F.min(F.when(is_symptom & F.col("text").eqNullSafe(F.col("_best.text")), F.col("pos")))
    seen = entities.withColumn("_best", best.over(document))
    chosen = F.col("pos") == F.col("_first")
    if only_if_absent:
        seen = seen.withColumn("_has", F.coalesce(F.bool_or(F.col("label") == chief).over(document), F.lit(False)))
        chosen &= ~F.col("_has")
    return (
        seen.withColumn("_first", first.over(document))
        .withColumn("label", F.when(chosen, chief).otherwise(F.col("label")))
        .select(*entities.columns)
    )


# --------------------------------------------------------------- deduplication


def dedup_exact(entities: DataFrame) -> DataFrame:
    """Per document and lower-cased text: the best-scored row, at the first sighting's ``pos``."""
    return (
        entities.withColumn("key", F.lower(strip(F.col("text"))))
        .groupBy("id", "key")
        .agg(
            F.min("pos").alias("first_pos"),
            F.max_by(
                F.struct("text", "label", "score"), F.struct(F.col("score"), -F.col("pos"))
            ).alias("best"),
        )
        .select("id", F.col("first_pos").alias("pos"), "best.text", "best.label", "best.score")
    )


def dedup_entities(entities: DataFrame) -> DataFrame:
    """Exact duplicates merged, then spans inside a longer span of the same label dropped.

    Being inside is transitive, so "inside any longer one" equals a greedy longest-first
    pass. Each different span is searched once for the others (:func:`held_words`); a row then names the spans
    that its own holds, and these names meet the spans of their document and label in one grouping.
    Adds ``dup_rank``: the order of the survivors, longest first, then by first sighting.
    """
    unique = stage(dedup_exact(entities).withColumn("low", F.lower("text")), "spans")
    held = held_words(unique, unique.select(F.col("low").alias("word")), longer=True)
    span = F.struct("pos", "text", "score").alias("span")
    own = unique.select("id", "label", "low", span)
    named = (
        unique.filter("id is not null and label is not null").select("id", "label", "low").join(held, "low")
        .select("id", "label", F.col("word").alias("low"), F.lit(None).cast(own.schema["span"].dataType).alias("span"))
    )
    columns = ["id", "pos", "text", "label", "score"]
    # Cut by id alone: neither the grouping nor the ranking shuffles again.
    left = (
        parallel.by_key(own.unionByName(named), "id")
        .groupBy("id", "label", "low")
        .agg(F.first("span", ignorenulls=True).alias("span"), F.bool_or(F.col("span").isNull()).alias("inside"))
        .filter(F.col("span").isNotNull() & ~F.col("inside"))
        .select("id", "label", "span.*")
    )
    order = Window.partitionBy("id").orderBy(F.length("text").desc(), "pos")
    return left.select(*columns).withColumn("dup_rank", F.row_number().over(order).cast("long"))


# -------------------------------------------------------------------- tagging


def _spoken(df: DataFrame, col: str) -> DataFrame:
    """``id, w``: the words of each text with their starts, in order. Cut by id, which moves each text once; all that is done per id after that needs no further shuffle.

    Words are found before that, as the plan of a Python function forgets how its rows are cut, and travel as one string with a list of starts, which is about as large as the text.
    """
    found = df.select("id", word_places(F.col(col)).alias("w"))
    moved = parallel.by_key(found.select("id", F.concat_ws(" ", "w.word").alias("words"), F.col("w.start").alias("starts")), "id")
    words = F.transform(F.split("words", " "), lambda word, i: F.struct(word.alias("word"), F.get("starts", i).alias("start")))
    return moved.select("id", F.slice(words, F.lit(1), F.size("starts")).alias("w"))


def _end(word: Column) -> Column:
    return word["start"] + F.length(word["word"])


def word_pieces(df: DataFrame, col: str = "text") -> DataFrame:
    """Words with their place: ``id, wpos, word, start, end``; ``word`` is lower-cased, places are code points."""
    return (
        _spoken(df, col)
        .select("id", F.posexplode_outer("w").alias("wpos", "w"))  # a plain one would have words found twice, to pass over texts without any
        .filter("w is not null")
        .select("id", F.col("wpos").cast("long").alias("wpos"), "w.word", F.col("w.start").cast("long").alias("start"), _end(F.col("w")).cast("long").alias("end"))
    )


def _runs(df: DataFrame, col: str, max_words: int) -> DataFrame:
    """``id, wpos, n_words, start, end, phrase``: every run of 1 to ``max_words`` words."""
    order = Window.partitionBy("id").orderBy("wpos")
    pieces = word_pieces(df, col)
    if max_words == 1:
        return pieces.select("id", "wpos", F.lit(1).alias("n_words"), "start", "end", F.col("word").alias("phrase"))
    for k in range(1, max_words):
        pieces = pieces.withColumn(f"word_{k}", F.lead("word", k).over(order)).withColumn(
            f"end_{k}", F.lead("end", k).over(order)
        )
    runs, phrase = [], F.col("word")
    for k in range(max_words):
        if k:
            phrase = F.concat_ws(" ", phrase, F.col(f"word_{k}"))
        until = F.col(f"end_{k}") if k else F.col("end")
        runs.append(F.when(until.isNotNull(), F.struct(phrase.alias("phrase"), F.lit(k + 1).alias("n_words"), until.alias("end"))))
    found = pieces.select("id", "wpos", "start", F.explode(F.array(*runs)).alias("run")).filter("run is not null")
    return found.select("id", "wpos", "run.n_words", "start", "run.end", "run.phrase")


def _tagged(found: DataFrame) -> DataFrame:
    place = Window.partitionBy("id").orderBy("start", "end", "label")
    return found.select(
        "id",
        (F.row_number().over(place) - 1).cast("long").alias("pos"),
        F.col("phrase").alias("text"),
        "label",
        F.col("score").cast("double").alias("score"),
        F.lit(False).alias("negated"),
        F.col("start").cast("long").alias("start"),
        F.col("end").cast("long").alias("end"),
    )


def tag_lexicon(
    df: DataFrame, lexicon: DataFrame, col: str = "text", max_words: int = 1
) -> DataFrame:
    """Every occurrence of a lexicon phrase as an entity.

    ``lexicon`` has ``phrase`` (lower-cased words with single spaces), ``label`` and
    ``score``. Runs of 1 to ``max_words`` words are looked up by equality, so the cost
    does not grow with the lexicon. Catalyst sizes the lexicon and broadcasts it if small.
    """
    found = _runs(df, col, max_words).join(lexicon.select("phrase", "label", "score"), "phrase")
    return _tagged(found.select("id", "start", "phrase", "end", "label", "score"))


def tag_longest(
    df: DataFrame, lexicon: DataFrame, col: str = "text", max_words: int = 3, salts: int = 16
) -> DataFrame:
    """As :func:`tag_lexicon`, but hits do not overlap: from left to right the longest phrase at each word, then on behind it.

    Of lexicon rows with one phrase the best-scored counts, then the first label. Where the lexicon is too large to be broadcast (over ``LARGE_LEXICON``
    phrases), they are looked up by phrase and salt, so the rows of a common word are spread over ``salts`` tasks. The choice is one ordered pass over each run of overlapping hits,
    not over the document: a hit that begins behind all earlier ones begins a new run.
    """
    best = F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "label", "score"))
    entries = lexicon.groupBy("phrase").agg(best.alias("entry")).select("phrase", "entry.label", "entry.score")
    salts = salts if entries.count() > LARGE_LEXICON else 1
    spread = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("id", "wpos"), F.lit(salts)).cast("int")
    hits = _runs(df, col, max_words).withColumn("salt", salt).join(spread, ["phrase", "salt"])
    longest = hits.groupBy("id", "wpos").agg(F.max_by(F.struct("n_words", "start", "end", "phrase", "label", "score"), "n_words").alias("hit"))
    line = Window.partitionBy("id").orderBy("wpos")
    reach = F.max(F.col("wpos") + F.col("hit.n_words")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.col("wpos") >= F.coalesce(reach, F.lit(0))).cast("int")
    runs = longest.withColumn("begins", begins).withColumn("run", F.sum("begins").over(line))
    ordered = F.array_sort(F.collect_list(F.struct("wpos", "hit")))
    nothing = F.filter(F.col("hits"), lambda h: F.lit(False))
    chosen = F.aggregate(
        "hits",
        F.struct(F.lit(0).cast("long").alias("free"), nothing.alias("kept")),
        lambda acc, h: F.when(
            h["wpos"] >= acc["free"],
            F.struct((h["wpos"] + h["hit"]["n_words"]).alias("free"), F.concat(acc["kept"], F.array(h)).alias("kept")),
        ).otherwise(acc),
    )
    kept = runs.groupBy("id", "run").agg(ordered.alias("hits")).select("id", F.explode(chosen["kept"]).alias("h"))
    return _tagged(kept.select("id", "h.hit.start", "h.hit.phrase", "h.hit.end", "h.hit.label", "h.hit.score"))


def tag_words(df: DataFrame, lexicon: DataFrame, col: str = "text", max_words: int = 1) -> DataFrame:
    """:func:`tag_lexicon` without places: ``id, pos, text, label, score``, ``pos`` by word.

    Looks at one row at a time, so it needs no shuffle and runs on streams as well.
    """
    spoken = df.select(
        "id",
        F.regexp_extract_all(F.lower(text_or_empty(F.col(col))), F.lit("[a-z0-9]+"), 0).alias("tokens"),
    )

    def runs(n: int) -> Column:
        return F.transform(
            "tokens",
            lambda _, i: F.when(
                i + n <= F.size("tokens"),
                F.struct(i.alias("pos"), F.array_join(F.slice("tokens", i + 1, n), " ").alias("phrase")),
            ),
        )

    every = F.array_compact(F.concat(*[runs(n) for n in range(1, max_words + 1)]))
    return (
        spoken.select("id", F.inline(every))
        .join(lexicon.select("phrase", "label", "score"), "phrase")
        .select(
            "id",
            F.col("pos").cast("long").alias("pos"),
            F.col("phrase").alias("text"),
            "label",
            F.col("score").cast("double").alias("score"),
        )
    )


def negation_scopes(
    df: DataFrame,
    col: str = "text",
    cues: Sequence[str] = S.NEGATION_CUES,
    scope_words: int = S.NEGATION_SCOPE_WORDS,
) -> DataFrame:
    """``id, start, end`` from each negation cue to the end of the ``scope_words``-th word after."""

    def scope(word: Column, i: Column) -> Column:
        until = _end(F.get("w", F.least(i + scope_words, F.size("w") - 1)))
        return F.when(word["word"].isin(*cues), F.struct(word["start"].cast("long").alias("start"), until.cast("long").alias("end")))

    return _spoken(df, col).select("id", F.inline(F.array_compact(F.transform("w", scope))))


def mark_negated(entities: DataFrame, scopes: DataFrame, width: int = 4096) -> DataFrame:
    """Set ``negated`` where a span overlaps a scope of its document; never unset it.

    Spans and scopes are cut into stretches of ``width`` characters, which bounds every
    group, and a running maximum over a stretch finds overlaps without forming pairs.
    Touching intervals do not overlap. Entities go through whole, beside the scopes, and are joined to nothing: where both tables are
    cut by ``id``, as those made from texts are, nothing is shuffled again. Both are read once. Rows that share ``id`` and ``pos`` are marked together.
    """
    first = F.floor(F.col("start") / width)
    stretches = F.sequence(first, F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / width))
    none = F.lit(None)
    marks = scopes.select("id", "start", "end", F.explode(stretches).alias("stretch")).select(
        "id", "stretch", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("end").alias("reach"),
        none.cast("int").alias("nth"), none.cast(entities.schema).alias("own"),
    )
    # One row for each stretch of a span; the first, or the only one of a span without a place, is kept.
    asks = entities.select(F.struct(*entities.columns).alias("own"), "id", "end", F.posexplode_outer(stretches).alias("nth", "stretch")).select(
        "id", "stretch", F.col("end").alias("at"), F.lit(0).alias("kind"), none.cast("long").alias("reach"), "nth", "own",
    )
    line = (
        Window.partitionBy("id", "stretch")
        .orderBy("at", "kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hit = (F.col("kind") == 0) & (F.col("reach") > F.col("own.start")) & F.col("id").isNotNull() & F.col("own.pos").isNotNull()
    seen = marks.unionByName(asks).withColumn("reach", F.max("reach").over(line)).filter("kind = 0").select("id", "own.pos", "nth", "own", hit.alias("is_hit"))
    marked = seen.withColumn("is_hit", F.max("is_hit").over(Window.partitionBy("id", "pos"))).filter(F.coalesce("nth", F.lit(0)) == 0)
    negated = F.coalesce("own.negated", F.lit(False)) | F.coalesce("is_hit", F.lit(False))
    return marked.select(*[negated.alias(c) if c == "negated" else F.col(f"own.{c}").alias(c) for c in entities.columns])


# -------------------------------------------------------------- normalisation


def literal_lexicon(pairs: Sequence[tuple[str, str]] = S.LAY_TERMS) -> Column:
    return F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(p).alias("phrase"), F.lit(t).alias("term"))
            for i, (p, t) in enumerate(pairs)
        ]
    )


def concept_terms(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``key, term`` for those of the distinct ``key`` that equal, contain or stand in a phrase.

    A phrase inside a key is one of the key's substrings, and the other way round, so
    both are found by equality. An equal phrase wins, then the smallest ``ord``.
    """
    entry = F.min(F.struct("ord", "phrase", "term")).alias("entry")
    phrases = lexicon.filter("phrase <> ''").groupBy("phrase").agg(entry)
    sized = texts.select("key", phrases.agg(F.max(F.length("phrase"))).scalar().alias("longest"))
    parts = lexicon.select("*", F.explode(substrings(F.col("phrase"))).alias("part")).groupBy("part").agg(entry)
    inside = sized.select("key", F.explode(substrings(F.col("key"), F.col("longest"))).alias("phrase")).join(phrases, "phrase")
    around = texts.join(parts, F.col("key") == F.col("part"))
    equal = (F.col("key") != F.col("entry.phrase")).alias("other")
    found = inside.select("key", equal, "entry").unionByName(around.select("key", equal, "entry"))
    return found.groupBy("key").agg(F.min(F.struct("other", "entry"))["entry"]["term"].alias("term"))


def normalize_concept(entities: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """Add the clinical ``term`` of a lay phrase and a null ``cui``. Each distinct text is looked up once.

    ``lexicon`` has ``ord, phrase, term``. A text without a match, blank or null, is its own term.
    """
    if lexicon is None:
        lexicon = entities.sparkSession.range(1).select(F.inline(literal_lexicon()))
    texts = entities.select("text").distinct().withColumn("key", F.lower(strip(F.col("text"))))
    terms = concept_terms(texts.select("key").distinct(), lexicon)
    # Stored, so that its size is known: where it is small, the entities are not shuffled to meet it.
    terms = stage(texts.join(terms, "key", "left").select("text", F.coalesce("term", "text").alias("term")), "terms")
    return entities.join(terms, "text", "left").withColumn("cui", F.lit(None).cast("string"))


# ------------------------------------------------------------------ comparison


def entity_sets(entities: DataFrame) -> DataFrame:
    """Distinct ``(id, label, text)`` of the asserted entities, text normalised."""
    kept = entities
    if "negated" in entities.columns:
        kept = kept.filter(~F.coalesce("negated", F.lit(False)))
    return (
        kept.select("id", "label", normalize_entity_text(F.col("text")).alias("text"))
        .filter(F.col("text") != "")
        .distinct()
    )


def entity_set_diff(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """``id, label, text, tp, fp, fn`` over both sets, one aggregation, no join."""
    both = entity_sets(pred).select("*", F.lit(1).alias("p"), F.lit(0).alias("g")).unionByName(
        entity_sets(gold).select("*", F.lit(0).alias("p"), F.lit(1).alias("g"))
    )
    return (
        both.groupBy("id", "label", "text")
        .agg(F.max("p").alias("p"), F.max("g").alias("g"))
        .select(
            "id",
            "label",
            "text",
            (F.col("p") * F.col("g")).cast("long").alias("tp"),
            (F.col("p") * (1 - F.col("g"))).cast("long").alias("fp"),
            ((1 - F.col("p")) * F.col("g")).cast("long").alias("fn"),
        )
    )


