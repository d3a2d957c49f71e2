"""Permuterm variants, zone-map clustering and the curriculum against brute force, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from notewright.llm import curriculum, permuterm, queries, zonemaps

DOCS = "doc_id long, text string, source string, n long, word string, size long, target double, cluster int"  # columns named like results
SF = "/root/testdata/sf0.001"


def doc_rows(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdéÿ") for _ in range(rnd.choice((7, 8, 9, 12)))) for _ in range(40)]
    words += [w[:3] + w[4:] for w in words] + [w[:2] + "z" + w[3:] for w in words] + ["aaaaaaaaa", "aaaaaaaa", "aaaaaaa", "AAAAAAAb", "aaabaaaa"]
    weights = [rnd.choice((1, 2, 30, 400)) for _ in words]
    rows = [(i, " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 60))), rnd.choice(["b", "a", "ç", "", None])) for i in range(60)]
    rows += [(60, None, "a"), (61, "", "b"), (62, " \t\n\x0b", "b"), (None, "aaaaaaaaa words without an id", "a"), (7, "twice", "b"), (7, "twice", "b"), (63, "x " * 30_000, "long"), (64, "Q" * 3000 + " " + "Q" * 3000, None)]
    return [(*r, 5, "clash", 6, 0.5, 7) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(doc_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def table(df):
    return [r.asDict() for r in df.collect()]


# ------------------------------------------------------------------ variants


def is_near(a, b):
    """One insertion, deletion or replacement apart."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows, damage=31):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [o for o in n if is_near(w, o)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append({"word": w, "form": form[w], "root": root, "n": n[w], "n_near": len(near[w]), "form_n": form[w] and n[form[w]]})
    return out


@pytest.mark.parametrize("damage", (31, 3))
def test_variants_equal_brute_force(spark, docs, damage):
    got = table(permuterm.variants(permuterm.word_table(docs, damage=damage)))
    want = expected_variants(doc_rows(), damage)
    assert sorted(got, key=lambda r: r["word"]) == sorted(want, key=lambda r: r["word"])
    assert any(r["form"] for r in got) and any(len(r["word"]) > 2000 for r in got)


def test_neighbours_of_long_words_and_runs(spark):
    """Prefixes beyond the length that is sorted as text, and characters that can be deleted in several places."""
    words = ["a" * 100, "a" * 101, "a" * 102, "a" * 50 + "b" + "a" * 50, "ab" * 60, "ab" * 60 + "c", "c" + "ab" * 60, "x" * 100 + "y", "x" * 100]
    df = spark.createDataFrame([(w, 10**i) for i, w in enumerate(words)], "word string, n long")
    got = {r["word"]: r for r in table(permuterm.variants(df))}
    for i, w in enumerate(words):
        near = [o for o in words if is_near(w, o)]
        assert got[w]["n_near"] == len(near)
        best = max(near, key=words.index, default=None)
        assert got[w]["form"] == (best if best and words.index(best) > i else None)


def test_chain_of_forms(spark):
    chain = ["abcdefg" + "x" * i for i in range(9)]
    df = spark.createDataFrame([(w, 10**i) for i, w in enumerate(chain)], "word string, n long")
    assert {r["root"] for r in table(permuterm.variants(df))} == {chain[-1]}


def test_no_words(spark, empty):
    assert table(permuterm.variants(permuterm.word_table(empty, damage=31))) == []


# ---------------------------------------------------------------- clustering


def vector_rows(n=300, dim=6, seed=4):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(5, dim))
    rows = [(i, (centre[i % 5] + 0.1 * rnd.normal(size=dim)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (2000, [0.0] * dim), (2001, None), (2002, [0.5] * (dim - 1)), (2003, [0.5] * (dim + 1))]
    rows += [(2004, [None] + [0.1] * (dim - 1)), (2005, [float("nan")] * dim), (2006, [float("inf")] * dim), (2007, [-0.0] * dim), (2008, []), (2009, [1e300] * dim)]
    return [(*r, 1, "clash", 2) for r in rows]


VECTORS = "vec_id long, embedding array<double>, cluster int, v string, distance long"


def expected_clusters(rows, k, rounds, dim, scale, seed):
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    x = [[max(-zonemaps.LARGEST, min(zonemaps.LARGEST, int(np.floor(scale * c)))) for c in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, hashlib.sha256(f"{seed}:{kept[j][0]}".encode()).hexdigest(), x[j]))
    centroids = [x[j] for j in order[:k]]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for p in x:
            groups.setdefault(nearest(p)[1], []).append(p)
        centroids = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else c for n, c in enumerate(centroids)]
    return [(i, nearest(p)[1], nearest(p)[0], centroids[nearest(p)[1]]) for (i, _), p in zip(kept, x)]


@pytest.mark.parametrize(("k", "block"), ((7, 16), (40, 256), (5, 1)))
def test_clusters_equal_brute_force(spark, monkeypatch, k, block):
    monkeypatch.setattr(zonemaps.zone_map, "__defaults__", (4, block))
    rows = vector_rows()
    got = table(zonemaps.cluster_vectors(spark.createDataFrame(rows, VECTORS), k=k, rounds=3, dim=6, scale=50, seed=9))
    want = expected_clusters(rows, k, 3, 6, 50, 9)
    per = Counter()
    for _, n, d, _ in want:
        per[n] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    key = lambda t: tuple(map(str, t))
    assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got), key=key) == sorted(
        ((i, n, d, per[n], sum(per.values()), digest(c)) for i, n, d, c in want), key=key
    )
    if block == 16:  # the boxes rule centroids out
        assert sum(r["n_candidates"] for r in got) < 0.6 * k * len(got)


def test_hilbert_neighbours_touch():
    """Along the curve one coordinate changes by one from cell to cell, and every cell has its own place."""
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    keys = [k.tobytes() for k in zonemaps.hilbert_keys(cells, 3)]
    walk = cells[sorted(range(len(cells)), key=keys.__getitem__)]
    assert len(set(keys)) == 512 and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest():
    rnd = np.random.default_rng(5)
    for _ in range(200):
        x, c = rnd.integers(-9, 9, (12, 3)) + rnd.integers(-20, 20, 3), rnd.integers(-20, 20, (15, 3))
        some = zonemaps.candidates(x.min(axis=0), x.max(axis=0), c)
        at, distance = zonemaps.nearest(x, c)
        assert set(at) <= set(some)
        assert (((x[:, None] - c) ** 2).sum(axis=2).min(axis=1) == distance).all()


def test_nearest_is_exact_beyond_doubles():
    x = np.array([[zonemaps.LARGEST, 1], [-zonemaps.LARGEST, 0]])
    c = np.array([[-zonemaps.LARGEST, 0], [zonemaps.LARGEST, 0]])
    at, distance = zonemaps.nearest(x, c)
    assert at.tolist() == [1, 0] and distance.tolist() == [1, 0]


def test_no_vectors(spark):
    assert table(zonemaps.cluster_vectors(spark.createDataFrame([], VECTORS))) == []


# ---------------------------------------------------------------- curriculum


def expected_mix(rows, budget=1.5, repeats=2):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows]
    source = [s for _, _, s, *_ in rows]
    names = sorted({s for s in source if s is not None}) + [None] * (None in source)
    own = {s: sum(z for z, o in zip(size, source) if o == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        level = (budget * sum(size) - sum(repeats * own[s] for s in names if s not in open_)) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= repeats * own[s]}
        if not full:
            break
        open_ -= full
    for s in names:
        target[s] = weight[s] * level if s in open_ else float(repeats * own[s])
    return size, own, target


def test_curriculum(spark, docs):
    rows = doc_rows()
    size, own, target = expected_mix(rows)
    got = table(curriculum.curriculum(docs))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got if r["pass"] == 1) == sorted((str(r[0]), z) for r, z in zip(rows, size))
    taken = Counter()
    for r in got:
        assert r["source_size"] == own[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["words"] <= r["size"] and (r["at"] is None) == (r["words"] == 0) == (r["slot"] is None)
        taken[r["source"]] += r["words"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in own)
    order = sorted((r for r in got if r["words"]), key=lambda r: r["slot"])
    assert [r["slot"] for r in order] == list(range(len(order)))
    assert [r["at"] for r in order] == sorted(r["at"] for r in order)
    assert len({r["row"] for r in got}) == len(rows)


def test_positions_follow_the_schedules(spark):
    """What a source has handed out by a time is the integral of its schedule, found here by adding up small steps."""
    rows = [(i, "w " * 5, "abc"[i % 3]) for i in range(900)]
    schedules = (((0.0, 9.0), (0.25, 1.0), (1.0, 0.0)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.0), (0.6, 0.0), (1.0, 4.0)))
    got = table(curriculum.curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string"), schedules, budget=0.6))
    for source, schedule in zip("abc", schedules):
        grid = np.linspace(0, 1, 20_001)
        weights = np.interp(grid, *zip(*schedule))
        share = np.concatenate([[0], np.cumsum((weights[1:] + weights[:-1]) / 2)])
        share /= share[-1]
        at = sorted(r["at"] for r in got if r["source"] == source and r["words"])
        wanted = np.arange(len(at)) / (len(at))
        have = np.interp(at, grid, share)
        assert np.abs(have - wanted)[1:].max() < 0.02


def test_reruns_agree_and_hot_sources_spread(spark):
    rows = [(i, "w " * (i % 7), "hot" if i % 3 else f"s{i % 5}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted(map(str, table(curriculum.curriculum(d).drop("row")))) for d in (df, df.repartition(7)))
    assert one == two


def test_bad_schedules():
    with pytest.raises(ValueError):
        curriculum._pieces([(0.0, 1.0), (0.5, 1.0)])


def test_empty_mix(spark, empty):
    assert table(curriculum.curriculum(empty)) == []


def test_curriculum_is_native(spark, docs):
    plan = curriculum.curriculum(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ----------------------------------------------------------- registered queries


@pytest.mark.parametrize("name", ("op11_permuterm", "op12_zone_maps", "op13_curriculum"))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(want, key=str)
