from conftest import rows
from pyspark.sql import functions as F

from notewright.operators import prompts as P

ENT = "id long, pos long, text string, label string, score double"


def base(spark):
    return spark.createDataFrame(
        [(1, "[doctor]: hi", "N1", "P1"), (2, " d2 ", None, "P2"), (3, "d3 a b c d e f", "N3", "P3")],
        "id long, dialogue string, note string, generated_note string",
    )


def ents(spark):
    return spark.createDataFrame(
        [
            (1, 0, "rest", "follow-up instruction", 1.0), (1, 1, "Cough", "Symptom", 1.0), (1, 2, "cough", "symptom", 1.0),
            (1, 3, "back pain", "chief complaint", 1.0), (1, 4, "aspirin", "medication", 1.0), (2, 0, "odd", "unknown", 1.0),
        ],
        ENT,
    )


def test_entity_block(spark):
    got = dict(rows(P.entity_block(base(spark), ents(spark))))
    assert got[1] == "Subjective: Cough, back pain\nPlan: rest, aspirin"
    assert got[2] == got[3] == "No entities extracted."


def test_entity_block_flat(spark):
    data = [
        (1, 0, "500 mg", "drug dosage", 1.0), (1, 1, "aspirin", "medication", 1.0), (1, 2, "aspirin", "medication", 1.0),
        (1, 3, "oral", "drug route", 1.0), (1, 4, "daily", "drug frequency", 1.0), (1, 5, "cough", "symptom", 1.0),
        (1, 6, "left arm", "body part or location", 1.0), (1, 7, "z", "unknown", 1.0),
    ]
    got = dict(rows(P.entity_block_flat(base(spark), spark.createDataFrame(data, ENT))))
    assert got[1] == (
        "- Symptoms: cough\n- Medications: aspirin, aspirin, (dosage:500 mg), (frequency:daily), (route:oral)\n"
        "- Body Part Or Location: left arm"
    )
    assert got[2] == "No clinical entities extracted."


def layouts(spark):
    df = base(spark).join(P.entity_block(base(spark), ents(spark)), "id").withColumn("retrieved_note", F.lit("R"))
    examples = P.example_row(df, (2, 1))
    made = P.render_prompts(
        df,
        {
            "d_infer": P.dialogue_prompt(), "d_train": P.dialogue_prompt(True, True),
            "e_infer": P.entity_prompt(), "e_train": P.entity_prompt(True),
            "c_infer": P.combined_prompt(), "c_train": P.combined_prompt(True),
            "o_infer": P.optional_entity_prompt(), "o_none": P.optional_entity_prompt(entities=F.lit(" ")),
            "judge": P.judge_prompt(), "judge_gold": P.judge_prompt(F.col("note")),
            "few": P.fewshot_prompt(examples), "mixed": P.fewshot_prompt(examples, (True, False)),
            "talk": P.fewshot_prompt(examples, (False, False)), "extract": P.extraction_prompt(5),
        },
    )
    return {(r.id, r.layout): r.prompt for r in made.collect()}


def test_layouts(spark):
    got = layouts(spark)
    for kind in "dec":
        for i in (1, 3):
            assert got[i, f"{kind}_train"] == got[i, f"{kind}_infer"] + f"N{i}</s>"
    assert got[1, "d_infer"].startswith("[INST] Convert") and got[1, "d_infer"].endswith("Dialogue:\n[doctor]: hi\n\n[/INST]\n")
    assert "Dialogue:\nd2\n\n" in got[2, "d_infer"]
    assert "Extracted clinical entities:\nSubjective" in got[1, "o_infer"]
    assert "Extracted" not in got[1, "o_none"]
    assert "REFERENCE" not in got[1, "judge"] and "REFERENCE (Gold) SOAP Note ---\nN1\n" in got[1, "judge_gold"]
    assert "REFERENCE" not in got[2, "judge_gold"]
    assert got[1, "extract"].endswith("\n\nDialogue:\n[doct [/INST]")


def test_fewshot_layouts(spark):
    got = layouts(spark)
    assert got[3, "few"].count("Extracted Clinical Entities:") == 3
    assert got[3, "mixed"].count("Extracted Clinical Entities:") == 2
    assert got[3, "talk"].count("Extracted Clinical Entities:") == 0
    for name in ("few", "mixed", "talk"):
        text = got[3, name]
        assert text.index("Example 1") < text.index("Dialogue:\n d2 ") < text.index("Example 2") < text.index("[doctor]: hi")
        assert text.endswith("Dialogue:\nd3 a b c d e f\n\n[/INST]\n")
    assert "=== Your Task ===" in got[3, "talk"] and "=== Your Case ===" in got[3, "few"]


def test_fit_budget(spark):
    words = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(1, words), (2, "tiny talk")], "id long, dialogue string")
    got = {r.id: r for r in P.fit_budget(df, lambda d: P.render("a b {dialogue} c", dialogue=d), 103).collect()}
    assert (got[1].n_kept, got[1].n_tokens) == (50, 53) and got[1].prompt.endswith("w49 c")
    assert (got[2].n_kept, got[2].prompt) == (2, "a b tiny talk c")
    none = P.fit_budget(df, lambda d: P.render("{dialogue}", dialogue=d), 20).filter("id = 1").first()
    assert (none.n_kept, none.prompt) == (0, "")
