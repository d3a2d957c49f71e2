"""The registered queries of these operators, with production parameters and whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import capfilters, curriculum, exactdedup, importance, licenses, packing, permuterm, pieces, pii, sharding, simhash, tokenbin, zonemaps

PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.find_spans(_table(spark, sf_dir, "documents"), pii.fit(pii.labelled_table(spark)))
    ranks = F.create_map(*(x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))))

    def written(col):
        ordered = F.array_sort(F.transform(col, lambda s: F.struct(s["start"].alias("a"), ranks[s["kind"]].alias("r"), s["stop"].alias("b"), s["kind"].alias("k"))))
        return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["k"], s["a"].cast("string"), s["b"].cast("string"))), ",")

    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return spans.select(
        "doc_id",
        *(of_kind(k) for k in pii.KINDS),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sharding.shard_documents(_table(spark, sf_dir, "documents"), n_shards=16)
    return shards.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenbin.write_token_files(_table(spark, sf_dir, "documents"), VOCABULARY)
    return tokenbin.document_index(tokenbin.read_token_files(spark, path), tokenbin.token_width(VOCABULARY))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), licenses.fit(licenses.labelled_table(spark)))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), VOCABULARY, window=1024)


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capfilters.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exactdedup.exact_groups(_table(spark, sf_dir, "documents"), hash_all=True)
    return groups.withColumnRenamed("full_hash", "text_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; ``round_trip`` holds the decoded text against the one read."""
    docs = _table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    encoded = pieces.encode_pieces(docs, PIECES, keep=("text_sha256",))
    decoded = pieces.decode_pieces(encoded, PIECES, keep=("text_sha256",))
    return decoded.select("doc_id", "n_ids", "ids_crc32", (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


def op11_permuterm(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = permuterm.word_table(_table(spark, sf_dir, "documents"), least=7, occurrences=2, damage=31)
    return permuterm.variants(words, times=10)


def op12_zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemaps.cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dim=64, scale=256, seed=2).drop("n_candidates")


def op13_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words taken in all passes, and the position and slot of its first."""
    order = curriculum.curriculum(_table(spark, sf_dir, "documents"), curriculum.SCHEDULES, budget=1.5, repeats=2)
    return (
        order.groupBy("row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("words").alias("taken"), F.min("at").alias("first_at"), F.min("slot").alias("first_slot"))
        .drop("row")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_importance, op2_personal_data, op3_sharding, op4_token_files, op5_licenses,
        op6_simhash, op7_packing, op8_cap_filters, op9_exact_dedup, op10_sentencepiece,
        op11_permuterm, op12_zone_maps, op13_curriculum,
    )
}

# The schedules of the curriculum solved piece by piece; c is the source's kind, x the integral reached.
CURRICULUM_SQL = """
    WITH d AS (
        SELECT doc_id, 's' || source AS key, md5(doc_id::VARCHAR) AS h,
            len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
        FROM documents
    ), s AS (
        SELECT key, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY key NULLS LAST) - 1) % 3 AS c,
            CASE c WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS weight
        FROM d GROUP BY key
    ), f AS (
        SELECT *, 2 * source_size / weight AS full_at FROM s
    ), l AS (
        SELECT max(level) AS level FROM (
            SELECT full_at, (1.5 * (SELECT sum(source_size) FROM f) - coalesce(sum(2 * source_size) OVER below, 0))::DOUBLE / sum(weight) OVER above AS level
            FROM f
            WINDOW below AS (ORDER BY full_at GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), above AS (ORDER BY full_at GROUPS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ) WHERE level <= full_at
    ), g AS (
        SELECT key, source_size, c, least((2 * source_size)::DOUBLE, weight * level) AS target, floor(target)::BIGINT AS demand FROM f, l
    ), a AS (
        SELECT d.*, source_size, c, target, demand, coalesce(sum(size) OVER (
            PARTITION BY d.key ORDER BY h NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead,
            row_number() OVER () AS row
        FROM d JOIN g ON d.key IS NOT DISTINCT FROM g.key
    ), p AS (
        SELECT *, (pass - 1) * source_size + ahead AS begin, greatest(least(demand - begin, size), 0) AS words, begin / demand AS share,
            CASE WHEN c = 0 THEN CASE WHEN share * 5.0 > 3.0 THEN 0.5 + 2.0 * (share * 5.0 - 3.0) / (5.0 + sqrt(greatest(25.0::DOUBLE - 8.0 * (share * 5.0 - 3.0), 0.0)))
                    ELSE 2.0 * (share * 5.0) / (7.0 + sqrt(greatest(49.0::DOUBLE - 8.0 * (share * 5.0), 0.0))) END
                WHEN c = 1 THEN 2.0 * (share * 2.0) / (2.0 + sqrt(4.0::DOUBLE))
                ELSE CASE WHEN share * 1.0 > 0.125 THEN 0.5 + 2.0 * (share * 1.0 - 0.125) / (0.5 + sqrt(greatest(0.25::DOUBLE + 10.0 * (share * 1.0 - 0.125), 0.0)))
                    WHEN share > 0 THEN 2.0 * share / sqrt(greatest(2.0::DOUBLE * share, 0.0)) ELSE 0.0 END END AS time,
            CASE WHEN words > 0 THEN round(time, 9) END AS spot
        FROM a, (VALUES (1), (2)) AS t(pass) WHERE pass = 1 OR greatest(least(demand - (pass - 1) * source_size - ahead, size), 0) > 0
    ), o AS (
        SELECT *, CASE WHEN words > 0 THEN row_number() OVER (ORDER BY spot NULLS LAST, key NULLS LAST, h NULLS LAST, doc_id NULLS LAST, size, pass) - 1 END AS slot FROM p
    )
    SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken, min(spot) AS first_at, min(slot) AS first_slot
    FROM o GROUP BY row, doc_id, size, source_size, target
"""



def _crc32_table() -> list[int]:
    """The remainders of all bytes by the reflected polynomial of CRC-32."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


# CRC-32 byte by byte; neighbours by their text without a character, put together from both sides of it.
VARIANTS_SQL = f"""
    WITH RECURSIVE r AS (
        SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS run
        FROM documents
    ), o AS (
        SELECT run, hex(encode(id || ':' || run)) AS x, count(*) AS n FROM r GROUP BY id, run
    ), h AS (
        SELECT run, n, xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(range(1, len(x)::BIGINT, 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
            lambda c, b: xor(c >> 8, ({_crc32_table()}::BIGINT[])[(xor(c, b) & 255) + 1]))) AS h
        FROM o
    ), w AS (
        SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
        FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2
    ), c AS (
        SELECT word, n, i, left(word, i - 1) AS a, substring(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)
    ), near AS (
        SELECT x.word, y.word AS other, y.n FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
        UNION SELECT c.word, w.word, w.n FROM c JOIN w ON w.word = c.a || c.b
        UNION SELECT w.word, c.word, c.n FROM c JOIN w ON w.word = c.a || c.b
    ), best AS (
        SELECT word, count(*) AS n_near, max(n) AS form_n, arg_min(other, (-n, other)) AS form FROM near GROUP BY word
    ), f AS (
        SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
        FROM w LEFT JOIN best USING (word)
    ), chain AS (
        SELECT word, word AS last FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.last WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.form, chain.last AS root, f.n, f.n_near, f.form_n
    FROM f JOIN chain ON chain.word = f.word JOIN f AS e ON e.word = chain.last AND e.form IS NULL
"""


def _clusters_sql(k: int, rounds: int, dim: int, seed: int) -> str:
    """Every vector against every centroid, component by component, round after round."""
    parts = [
        f"""v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e, row_number() OVER () AS row FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), x AS (SELECT row, unnest(e) AS x, unnest(range({dim})) AS i FROM v),
        c0 AS (SELECT n, unnest(e) AS c, unnest(range({dim})) AS i FROM (
            SELECT e, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, e) - 1 AS n FROM v) WHERE n < {k})"""
    ]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT row, n, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN c{r} USING (i) GROUP BY row, n)")
        parts.append(f"a{r} AS (SELECT row, arg_min(n, (d, n)) AS n, min(d) AS d FROM d{r} GROUP BY row)")
        parts.append(
            f"""c{r + 1} AS (SELECT n, i, coalesce(m, c) AS c FROM c{r}
            LEFT JOIN (SELECT n, i, floor(sum(x) / count(*))::BIGINT AS m FROM a{r} JOIN x USING (row) GROUP BY n, i) USING (n, i))"""
        )
    return f"""
        WITH {", ".join(parts)}, s AS (SELECT n, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY n)
        SELECT vec_id, n::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY n)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, h AS centroid_sha256
        FROM v JOIN a{rounds} USING (row) JOIN s USING (n)
    """


ORACLES = {
    "op11_permuterm": VARIANTS_SQL,
    "op12_zone_maps": _clusters_sql(k=40, rounds=5, dim=64, seed=2),
    "op13_curriculum": CURRICULUM_SQL,
    "op8_cap_filters": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
                AND list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN part ON part.a = vec_id
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
