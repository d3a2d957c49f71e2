"""Prompt and training-text layouts.

The texts down to the marker are fixed values: a model tuned on them has to see exactly
these. ``{name}`` marks a slot; :func:`notewright.operators.prompts.render` fills it.
"""

# --------------------------------------------------------------- fixed values

END_TOKEN = "</s>"

NOTE_INSTRUCTION = (
    "Convert the following clinical dialogue into a SOAP note. "
    "Include sections: Subjective, Objective, Assessment, Plan."
)

DIALOGUE_INFER = "[INST] " + NOTE_INSTRUCTION + "\n\nDialogue:\n{dialogue}\n\n[/INST]\n"
DIALOGUE_TRAIN = DIALOGUE_INFER + "{note}"

ENTITIES_INFER = (
    "[INST] Convert the following clinical dialogue into a SOAP note. "
    "Use the extracted clinical entities to ensure completeness. "
    "Include sections: Subjective, Objective, Assessment, Plan.\n\n"
    "Extracted Entities:\n{entities}\n\n"
    "Dialogue:\n{dialogue}\n\n[/INST]\n"
)
ENTITIES_TRAIN = ENTITIES_INFER + "{note}" + END_TOKEN

OPTIONAL_HEAD = "[INST] " + NOTE_INSTRUCTION + "\n\n"
OPTIONAL_BLOCK = "Extracted clinical entities:\n{entities}\n\n"
OPTIONAL_TAIL = "Dialogue:\n{dialogue}\n\n[/INST]\n"

INPUT_OUTPUT = "### Input:\n{prompt}\n\n### Output:\n{target}"

FEWSHOT_ENTITY_INSTRUCTION = (
    "[INST] Generate a complete clinical SOAP note from the following doctor-patient dialogue. "
    "Use the extracted clinical entities to ensure all discussed symptoms, medications, "
    "diagnoses, and plans are included. Also include appropriate patient demographics and "
    "provider referral details as contextually relevant."
)
FEWSHOT_HEAD = "\n\nHere are examples:\n\n"
FEWSHOT_EXAMPLE = "=== Example {number} ===\n"
FEWSHOT_ENTITIES = "Extracted Clinical Entities:\n{entities}\n\n"
FEWSHOT_DIALOGUE = "Dialogue:\n{dialogue}\n\n"
FEWSHOT_NOTE = "SOAP Note:\n{note}\n\n"
FEWSHOT_CASE = "=== Your Case ===\n"
FEWSHOT_TASK = "=== Your Task ===\n"
FEWSHOT_END = "[/INST]\n"

EXTRACTION_RULES = """You are a clinical NER system. Extract medical entities from the doctor-patient dialogue below.

Return ONLY a JSON array. No explanation, no markdown, no backticks. Just the raw JSON array.

Entity types (use EXACTLY these labels):
- "chief complaint": the primary reason for the visit (extract only 1-2)
- "symptom": physical symptoms reported by the patient (pain, fatigue, nausea, etc.)
- "diagnosis": medical diagnosis or disease named by the doctor
- "medication": drug name or supplement prescribed
- "drug detail": dosage, frequency, route (e.g., "500mg twice daily", "2 tablets oral")
- "test or lab order": diagnostic test or imaging ordered (CBC, MRI, ECG, etc.)
- "vital sign": measured value with number (BP 120/80, BMI 24.5, HR 72)
- "physical exam finding": doctor's observation from exam (tenderness, swelling, rash)
- "referral": specialist referral (cardiologist, Dr. Smith, dietitian)
- "follow-up instruction": follow-up plan, lifestyle advice, activity recommendation

Rules:
- Keep entity text SHORT (1-5 words max)
- Do NOT extract generic words like "doctor", "patient", "medicine"
- Do NOT extract body parts alone (extract "chest pain" not "chest")
- Extract 10-25 entities per dialogue
- Each entity needs: "text", "label", "score" (your confidence 0.0-1.0)

Example output:
[{"text": "chest pain", "label": "chief complaint", "score": 0.95}, {"text": "shortness of breath", "label": "symptom", "score": 0.9}]"""
EXTRACTION_TAIL = "\n\nDialogue:\n{dialogue} [/INST]"

JUDGE_HEAD = (
    "You are an expert clinical documentation reviewer.\n"
    "Evaluate the GENERATED SOAP note against the original dialogue"
    " and (if provided) the reference note.\n"
    "\nScore each dimension from 1 (worst) to 5 (best):\n"
    "  1. Hallucination  – Are there unsupported facts not in the dialogue?\n"
    "  2. Omission       – Is key clinical information missing?\n"
    "  3. SOAP Structure – Are all four headers present and content placed correctly?\n"
    "  4. Clinical Consistency – Are findings, assessment, and plan logically aligned?\n"
    "  5. Plan Realism   – Are medications, dosages, and referrals appropriate?\n"
    "  6. Overall Quality – Holistic score considering all dimensions.\n"
    "\n--- Original Dialogue ---\n{dialogue}\n"
)
JUDGE_GOLD = "\n--- REFERENCE (Gold) SOAP Note ---\n{gold}\n"
JUDGE_NOTE = "\n--- GENERATED SOAP Note ---\n{note}\n"
JUDGE_TAIL = (
    "\nReturn your evaluation as a JSON object with exactly these keys:\n"
    "{\n"
    '  "hallucination": <1-5>,\n'
    '  "omission": <1-5>,\n'
    '  "soap_structure": <1-5>,\n'
    '  "clinical_consistency": <1-5>,\n'
    '  "plan_realism": <1-5>,\n'
    '  "overall": <1-5>,\n'
    '  "notes": "<short justification>"\n'
    "}\n"
    "\nJSON:"
)

# ----------------------------------------------------- layout chosen by this repo

COMBINED_INFER = (
    "[INST] " + NOTE_INSTRUCTION + "\n\n"
    "Extracted clinical entities:\n{entities}\n\n"
    "Note of a similar case:\n{retrieved}\n\n"
    "Dialogue:\n{dialogue}\n\n[/INST]\n"
)
COMBINED_TRAIN = COMBINED_INFER + "{note}" + END_TOKEN
