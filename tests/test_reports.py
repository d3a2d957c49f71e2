import pytest
from conftest import rows
from pyspark.sql import functions as F

from notewright import schema as S
from notewright.operators import reports as R
from notewright.operators import textscores as TS
from notewright.operators import verify as V

SPAN = "id long, pos long, text string, label string, score double, negated boolean, start long, end long"
GOLD = [(1, "the patient has a cough and fever"), (2, "no pain was found in the left knee"), (3, "third gold note here")]
RUNS = [
    ("a", 1, "the patient has a cough and fever"), ("a", 2, "no pain in the left knee"), ("a", 3, "gold note here"),
    ("b", 1, "the patient has a cough"), ("b", 2, "no pain was found in the left knee"),
    ("c", 1, "the patient has a cough and fever"), ("c", 2, "no pain in the left knee"), ("c", 3, "gold note here"),
]


def tables(spark):
    return (
        spark.createDataFrame(RUNS, "config string, id long, generated_note string"),
        spark.createDataFrame(GOLD, "id long, note string"),
    )


def test_sweep_scores_each_run_alone(spark):
    runs, gold = tables(spark)
    report = {r.config: r for r in R.sweep_report(runs, gold, aligned=True).collect()}
    assert {c: (r.n_pairs, r.coverage) for c, r in report.items()} == {"a": (3, 100.0), "b": (2, 66.6667), "c": (3, 100.0)}
    for config in "abc":
        alone = runs.filter(F.col("config") == config).withColumnRenamed("generated_note", "pred").join(
            gold.withColumnRenamed("note", "ref"), "id"
        )
        assert report[config].bleu == TS.bleu(alone).first()["bleu"]
        assert report[config].rougeL == TS.rouge_l(alone).first()["rougeL"]
        assert report[config].meteor_exact == TS.meteor_exact(alone).first()["meteor_exact"]


def test_compare_and_leaderboard(spark):
    report = R.sweep_report(*tables(spark))
    delta = {r.metric: (r.before, r.after, r.delta) for r in R.compare_runs(report, "a", "b").collect()}
    assert delta["n_pairs"] == (3.0, 2.0, -1.0)
    board = [(r.place, r.config) for r in R.leaderboard(report, "b").collect()]
    best = {r.config: r.bleu for r in report.collect()}
    first = max(best.values())
    assert [c for p, c in board if p == 1] == sorted(c for c in best if best[c] == first)
    assert board[-1][0] == (3 if best["b"] < best["a"] else 2)


def test_best_of_n_breaks_ties_by_config(spark):
    runs, gold = tables(spark)
    ents = spark.createDataFrame([(1, 0, "fever", "symptom", 1.0, False, 0, 0), (2, 0, "Found", "symptom", 1.0, False, 0, 0)], SPAN)
    got = {r.id: (r.config, r.score) for r in R.best_of_n(runs, ents, gold).collect()}
    assert got[1][0] == "a" and got[2][0] == "b" and got[3][0] == "a"
    scores = {(r.config, r.id): r for r in R.candidate_scores(runs, ents, gold).collect()}
    assert scores["a", 3].entity_recall == 1.0 and scores["b", 1].entity_recall == 0.0
    assert got[1][1] == scores["c", 1].score


def test_structure_report(spark):
    notes = spark.createDataFrame([("Subjective Objective Assessment Plan",), ("plan only",), (None,)], "note string")
    r = R.structure_report(notes).first()
    assert (r.n_notes, r.pct_subjective, r.pct_plan, r.pct_all_headers) == (3, 33.33, 66.67, 33.33)
    assert R.structure_report(notes.limit(0)).first().pct_plan == 0.0


def test_corpus_profile(spark):
    df = spark.createDataFrame([("One. Two words!",), ("abc\nd",)], "t string")
    r = R.corpus_profile(df, ["t"]).first()
    assert (r.n_rows, r.mean_chars, r.median_chars, r.mean_words, r.mean_sentences) == (2, 10.0, 10.0, 2.5, 2.0)


def test_full_report(spark):
    pairs = spark.createDataFrame([(1, "A cough.", "a  COUGH."), (2, "fever", "rash")], "id long, pred string, ref string")
    ents = spark.createDataFrame([(1, 0, "cough", "SYMPTOM", 1.0, False, 0, 0)], SPAN)
    got = {r.metric: r.value for r in R.full_report(pairs, ents, ents, ents).collect()}
    assert got["rouge1"] == got["rougeL"] == 0.5
    assert got["entity_f1"] == got["symptom_recall"] == 1.0 and got["hallucination_rate"] == 0.0
    assert got["section_rougeL_plan"] == 1.0
    bare = {r.metric: r.value for r in R.full_report(pairs, aligned=False).collect()}
    assert bare["entity_f1"] is None and "rougeL" not in bare
    raw = {r.metric: r.value for r in R.full_report(pairs, normalize=False, aligned=False).collect()}
    assert raw["rouge2"] == bare["rouge2"]


def verify_case(spark):
    good = "Subjective: cough\nObjective: bp\nAssessment: flu\nPlan: rest"
    notes = spark.createDataFrame([(1, good), (2, "Plan: gout\nSubjective: none"), (3, "")], "id long, note string")
    said = spark.createDataFrame(
        [
            (1, 0, "Cough", "symptom", 1.0, False, 0, 0), (1, 1, "flu", "diagnosis", 1.0, False, 0, 0),
            (2, 0, "rash", "symptom", 1.0, False, 0, 0), (2, 1, "gout", "diagnosis", 1.0, True, 0, 0),
        ], SPAN,
    )
    noted = spark.createDataFrame(
        [
            (1, 0, "cough", "symptom", 1.0, False, 0, 0), (1, 1, "flu", "diagnosis", 1.0, False, 0, 0),
            (2, 0, "gout", "diagnosis", 1.0, False, 0, 0), (2, 1, "lupus", "diagnosis", 1.0, False, 0, 0),
        ], SPAN,
    )
    return notes, said, noted


def test_verify_dimensions(spark):
    notes, said, noted = verify_case(spark)
    got = {r.id: r for r in V.verify_notes(notes, said, noted).collect()}
    assert [got[1][d] for d in V.DIMENSIONS] == [1.0] * 5 and got[1].passed
    # 2: one of two grounded; the denied gout is asserted; gout of rash, gout found;
    # Plan has a body but comes before Subjective's place only for itself; nothing in Assessment.
    assert [got[2][d] for d in V.DIMENSIONS] == [0.5, 0.0, 0.5, 0.25, 0.0]
    assert got[2].overall_score == 0.25 and not got[2].passed
    assert [got[3][d] for d in V.DIMENSIONS] == [1.0, 1.0, 1.0, 0.0, 1.0] and got[3].passed


def test_correction_and_report(spark):
    notes, said, noted = verify_case(spark)
    verified = V.verify_notes(notes, said, noted)
    fixed = V.apply_correction(notes, verified, said)
    got = {r.id: (r.generated_note, r.corrections_applied) for r in fixed.collect()}
    assert got[1] == (notes.filter("id = 1").first().note, 0)
    assert got[2] == (
        "**1. Subjective:**\nnone\nrash\n\n**2. Objective:**\n\n\n**3. Assessment:**\n\n\n**4. Plan:**\ngout", 1
    )
    r = V.verification_report(verified, fixed).first()
    assert (r.n_notes, r.n_passed, r.n_failed, r.n_corrections) == (3, 2, 1, 1)
    assert r.pct_passed == pytest.approx(66.6667)
    assert rows(V.verification_report(verified), "n_corrections") == [(0,)]


def test_verification_in_one_pass(spark):
    """Scores and correction together equal the two steps; null polarity counts as asserted, notes without entities pass on evidence."""
    notes, said, noted = verify_case(spark)
    said = said.unionByName(spark.createDataFrame([(2, 2, "hives", "symptom", 1.0, None, 0, 0), (7, 0, "no note", "symptom", 1.0, False, 0, 0)], SPAN))
    whole = V.verified_notes(notes, said, noted)
    fixed = V.apply_correction(notes, V.verify_notes(notes, said, noted), said)
    assert rows(whole, "id", "generated_note", "corrections_applied") == rows(fixed)
    assert "hives" in whole.filter("id = 2").first().generated_note and whole.count() == 3
    assert V.verification_report(whole).first().n_corrections == whole.agg({"corrections_applied": "sum"}).first()[0]
    assert V.verified_notes(notes.limit(0), said, noted).count() == 0
    assert [r.passed for r in V.verified_notes(notes.filter("id = 1"), said.limit(0), noted.limit(0)).collect()] == [True]


def test_full_report_has_rows_per_label(spark):
    pairs = spark.createDataFrame([(1, "a", "a")], "id long, pred string, ref string")
    pred = spark.createDataFrame([(1, 0, "cough", "symptom", 1.0, False, 0, 0), (1, 1, "flu", "diagnosis", 1.0, False, 0, 0)], SPAN)
    got = {r.metric: r.value for r in R.full_report(pairs, pred, pred.filter("label = 'symptom'"), pred, aligned=False).collect()}
    assert got["entity_f1[symptom]"] == 1.0 and got["entity_precision[diagnosis]"] == 0.0 and got["fp[diagnosis]"] == got["fp"] == 1.0
    assert got["entity_precision"] == 0.5


def test_quality_gates(spark):
    ents = spark.createDataFrame(
        [(1, 0, "cough", "symptom", 0.9), (1, 1, S.BODY_PARTS[0], "symptom", 0.9), (1, 2, "a b c d e f g h", "symptom", 0.9), (2, 0, "Rash", "symptom", 0.9), (3, 0, "no note", "x", 0.9)],
        "id long, pos long, text string, label string, score double",
    )
    notes = spark.createDataFrame([(1, "a cough"), (2, "RASH")], "id long, note string")
    got = {r.metric: (r.value, r.verdict) for r in R.quality_gates(ents, notes).collect()}
    assert got == {
        "usefulness_mean": (pytest.approx(2 / 3, abs=1e-6), "FAIL"), "noise_mean": (pytest.approx(1 / 9, abs=1e-6), "FAIL"),
        "spans_over_7_words": (1.0, "WARN"), "all_scores_identical": (1.0, "WARN"),
    }
    mine = [R.Gate("usefulness_mean", ">=", 0.5), R.Gate("n_entities", "<=", 5), R.Gate("min_score", "<", 0.5)]
    assert [r.verdict for r in R.quality_gates(ents, notes, gates=mine).sort("gate").collect()] == ["PASS", "PASS", "FAIL"]
    assert [r.value for r in R.quality_gates(ents.limit(0), notes).collect()] == [0.0] * 4
    with pytest.raises(ValueError):
        R.quality_gates(ents, notes, gates=[R.Gate("nothing", ">=", 1)])
