import math
import random
import re
from collections import Counter

import pytest

from conftest import rows
from notewright.functions import align
from notewright.operators import textscores as TS

PAIRS = [
    (1, "the patient has a cough and a mild fever", "the patient has a cough and a mild fever"),
    (2, "alpha beta gamma delta", "one two three four"),
    (3, "a a a a a b", "a a b c d e"),
    (4, "short", "a much longer reference text with many words"),
    (5, "", "something"),
    (6, "BP 120/80, well-known (ok). Next\nline 3.5", "BP 120/80 well known ok. Next line\n3.5 done"),
    (7, "one two three\nfour five six", "four five six\none two three"),
    (8, "x y z w v " * 5, "x y"),
    (9, "", ""),
]


def frame(spark, data=PAIRS):
    return spark.createDataFrame(data, "id long, pred string, ref string")


def tok13a(s):
    s = s.replace("-\n", "").replace("\n", " ")
    for pat, rep in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 "),
    ):
        s = re.sub(pat, rep, s)
    return s.split()


def ngrams(t, n):
    return Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1))


def bleu_brute(pairs):
    hit, total, pl, rl = [0] * 4, [0] * 4, 0, 0
    for _, p, r in pairs:
        p, r = tok13a(p), tok13a(r)
        pl, rl = pl + len(p), rl + len(r)
        for n in range(4):
            a, b = ngrams(p, n + 1), ngrams(r, n + 1)
            hit[n] += sum((a & b).values())
            total[n] += sum(a.values())
    if not all(hit):
        return 0.0
    bp = 1.0 if pl > rl else math.exp(1 - rl / pl)
    return bp * math.exp(sum(math.log(h / t) for h, t in zip(hit, total)) / 4)


def f1(h, p, r):
    return 2 * h / (p + r) if h else 0.0


def rouge_brute(p, r, n):
    a, b = ngrams(re.findall("[a-z0-9]+", p.lower()), n), ngrams(re.findall("[a-z0-9]+", r.lower()), n)
    return f1(sum((a & b).values()), sum(a.values()), sum(b.values()))


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            t[i][j] = t[i - 1][j - 1] + 1 if x == y else max(t[i - 1][j], t[i][j - 1])
    return t


def test_bleu_equals_brute_force(spark):
    r = TS.bleu(frame(spark)).first()
    assert r["bleu"] == pytest.approx(bleu_brute(PAIRS), abs=1e-6)
    assert r["n_pairs"] == len(PAIRS)
    assert TS.bleu(frame(spark, PAIRS[1:2])).first()["bleu"] == 0.0
    assert TS.bleu(frame(spark, PAIRS[:1])).first()["bleu"] == 1.0
    assert TS.bleu(frame(spark, PAIRS[8:])).first()["bleu"] == 0.0


def test_rouge_n_equals_brute_force(spark):
    got = {r.id: (r.rouge1, r.rouge2) for r in TS.rouge_n_scores(frame(spark)).collect()}
    for i, p, r in PAIRS:
        assert got[i] == pytest.approx((rouge_brute(p, r, 1), rouge_brute(p, r, 2)))


def test_lcs_length_equals_table():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 90))]
        assert align.lcs_length(a, b) == lcs_table(a, b)[-1][-1]


def lsum_brute(pred, ref):
    ps = [re.findall("[a-z0-9]+", s.lower()) for s in pred.split("\n") if s]
    rs = [re.findall("[a-z0-9]+", s.lower()) for s in ref.split("\n") if s]
    np_, nr = sum(map(len, ps)), sum(map(len, rs))
    cp, cr = Counter(t for s in ps for t in s), Counter(t for s in rs for t in s)
    hits = 0
    for r in rs:
        union = set()
        for p in ps:
            t, i, j = lcs_table(r, p), len(r), len(p)
            while i and j:
                if r[i - 1] == p[j - 1]:
                    union.add(i - 1)
                    i, j = i - 1, j - 1
                elif t[i][j - 1] > t[i - 1][j]:
                    j -= 1
                else:
                    i -= 1
        for k in sorted(union):
            if cp[r[k]] > 0 and cr[r[k]] > 0:
                hits, cp[r[k]], cr[r[k]] = hits + 1, cp[r[k]] - 1, cr[r[k]] - 1
    return f1(hits, np_, nr)


def test_rouge_l_equals_brute_force(spark):
    got = {r.id: (r.rougeL, r.rougeLsum) for r in TS.rouge_l_scores(frame(spark)).collect()}
    for i, p, r in PAIRS:
        a, b = re.findall("[a-z0-9]+", p.lower()), re.findall("[a-z0-9]+", r.lower())
        want = f1(lcs_table(a, b)[-1][-1], len(a), len(b))
        assert got[i] == pytest.approx((want, lsum_brute(p, r)))
    assert got[7][1] == 1.0 and got[7][0] == 0.5


def test_lsum_equals_brute_force_on_random_lines():
    rng = random.Random(8)
    for _ in range(60):
        p, r = ("\n".join(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4))) for _ in "pr")
        assert align.rouge_lsum_pair(p, r) == pytest.approx(lsum_brute(p, r))


@pytest.mark.parametrize(
    ("word", "stem"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"),
        ("motoring", "motor"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"),
        ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("digitizer", "digit"),
        ("triplicate", "triplic"), ("hopeful", "hope"), ("goodness", "good"), ("allowance", "allow"),
        ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("sky", "sky"),
    ],
)
def test_porter_stems(word, stem):
    assert align.stem(word) == stem


def test_meteor(spark):
    assert align.meteor_pair("a b c d", "a b c d") == pytest.approx(1 - 0.5 / 64)
    # stem match, two chunks, reversed order
    assert align.meteor_pair("coughing badly", "badly coughs") == pytest.approx(0.5)
    # 2 of 3 and 2 of 4 words, one chunk
    p, r = 2 / 3, 2 / 4
    want = (1 - 0.5 * (1 / 2) ** 3) * p * r / (0.9 * p + 0.1 * r)
    assert align.meteor_pair("a b z", "a b c d") == pytest.approx(want)
    assert align.meteor_pair("", "a") == align.meteor_pair("x", "y") == 0.0
    got = TS.meteor_exact(frame(spark)).first()["meteor_exact"]
    assert got == pytest.approx(sum(align.meteor_pair(p, r) for _, p, r in PAIRS) / len(PAIRS), abs=1e-6)


def test_section_rouge(spark):
    p = "Subjective: bad cough\nPlan: rest"
    r = "Subjective: BAD  cough\nObjective: none"
    got = dict(rows(TS.section_rouge(frame(spark, [(1, p, r)]))))
    assert got == {"Subjective": 1.0, "Objective": 0.0, "Assessment": 1.0, "Plan": 0.0}


def test_length_stats(spark):
    r = TS.length_stats(frame(spark)).first()
    n_p, n_r = [len(p.split()) for _, p, _ in PAIRS], [len(r.split()) for _, _, r in PAIRS]
    assert r.avg_pred_length == round(sum(n_p) / 9, 1)
    assert r.over_2x_ratio == round(sum(b > 0 and a > 2 * b for a, b in zip(n_p, n_r)) / 9, 4)


def test_groups_score_like_single_runs(spark):
    df = frame(spark)
    both = df.selectExpr("'a' config", "*").unionByName(df.selectExpr("'b' config", "id", "ref AS pred", "ref"))
    got = {r.config: r.bleu for r in TS.bleu(both, ["config"], ["config", "id"]).collect()}
    assert got == {"a": TS.bleu(df).first()["bleu"], "b": 1.0}


def test_lcs_positions_by_bits_follow_the_table():
    def by_table(ref, cand):
        table = [[0] * (len(cand) + 1) for _ in range(len(ref) + 1)]
        for i, a in enumerate(ref, 1):
            for j, b in enumerate(cand, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + (a == b))
        i, j, path = len(ref), len(cand), []
        while i and j:
            if ref[i - 1] == cand[j - 1]:
                i, j = i - 1, j - 1
                path.append(i)
            elif table[i][j - 1] > table[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return path

    rng = random.Random(3)
    for _ in range(300):
        ref, cand = ([rng.choice("abcdefgh") for _ in range(rng.randrange(90))] for _ in "12")
        assert align._lcs_positions(ref, cand, align.places_of(cand)) == by_table(ref, cand)


def test_a_word_is_stemmed_once():
    align.meteor_pair("she was coughing " * 50, "he has coughed " * 50)
    before = align.stem.cache_info().misses
    align.meteor_pair("she was coughing " * 50, "he has coughed " * 50)
    assert align.stem.cache_info().misses == before
