"""Table shapes, label sets and lexicons.

Everything in capitals below the marker is a fixed value: it has to be exactly
this for results to be comparable with published numbers for the task.
Operators take each of them as an argument with the value here as the default.
"""

from __future__ import annotations

from pyspark.sql import types as T

PAIR_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("note", T.StringType()),
        T.StructField("dialogue", T.StringType()),
    ]
)

SUBMISSION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("generated_note", T.StringType()),
    ]
)

ANNOTATED_SCHEMA = T.StructType(
    [*PAIR_SCHEMA.fields, T.StructField("entities_json", T.StringType())]
)

RETRIEVAL_CACHE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("retrieved_note", T.StringType()),
    ]
)

ENTITY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
    ]
)

# --------------------------------------------------------------- fixed values

ENTITY_LABELS = (
    "chief complaint",
    "symptom",
    "diagnosis",
    "medication",
    "drug detail",
    "test or lab order",
    "vital sign",
    "physical exam finding",
    "referral",
    "follow-up instruction",
)

SECTIONS = ("Subjective", "Objective", "Assessment", "Plan")

SECTION_LABELS = {
    "Subjective": ("chief complaint", "symptom"),
    "Objective": ("vital sign", "physical exam finding"),
    "Assessment": ("diagnosis",),
    "Plan": (
        "medication",
        "drug detail",
        "test or lab order",
        "referral",
        "follow-up instruction",
    ),
}

LABEL_SYNONYMS = {
    "follow-up": "follow-up instruction",
    "follow up": "follow-up instruction",
    "test": "test or lab order",
    "lab order": "test or lab order",
    "lab": "test or lab order",
    "exam finding": "physical exam finding",
    "physical exam": "physical exam finding",
    "dosage": "drug detail",
    "drug dosage": "drug detail",
}

SYMPTOM_LABELS = ("SYMPTOM", "S_CC_COMPLAINT", "S_HPI_SYMPTOM")

MAX_SPAN_WORDS = 7
PRIMARY_THRESHOLD = 0.4
FALLBACK_THRESHOLD = 0.25
MIN_ENTITIES = 5
DEFAULT_SCORE = 0.8

FILLER_PHRASES = (
    "i've also been having ",
    "i've also been ",
    "i've been having ",
    "i've been ",
    "i'm having ",
    "i also have ",
    "i have ",
    "patient reports ",
    "patient denies ",
    "patient has ",
    "the ",
    "my ",
)

FOLLOW_UP_KEYWORDS = (
    "follow-up",
    "follow up",
    "week",
    "month",
    "return",
    "appointment",
    "lifestyle",
    "exercise",
    "diet",
    "yoga",
    "meditation",
    "meal plan",
    "physical therapy",
    "occupational therapy",
    "monitor",
    "check-up",
    "recheck",
)

BODY_PARTS = (
    "skin", "nails", "stomach", "abdomen", "chest", "head", "neck", "back",
    "arm", "leg", "foot", "hand", "eye", "ear", "nose", "throat", "heart",
    "lung", "liver", "kidney",
)

# "anxiety" and "depression" stand in two groups and count twice.
CLINICAL_KEYWORDS = {
    "symptoms": (
        "pain", "fatigue", "nausea", "vomiting", "dizziness", "headache",
        "cough", "fever", "shortness of breath", "dyspnea", "palpitations",
        "weight loss", "weight gain", "anorexia", "insomnia", "sweating",
        "chills", "weakness", "numbness", "tingling", "swelling", "bloating",
        "diarrhea", "constipation", "bleeding", "rash", "itching", "anxiety",
        "depression", "confusion", "syncope", "fainting", "tremor",
    ),
    "diagnoses": (
        "diabetes", "hypertension", "asthma", "copd", "anemia", "cancer",
        "hypothyroidism", "hyperthyroidism", "depression", "anxiety",
        "pneumonia", "infection", "obesity", "hyperlipidemia", "arthritis",
        "osteoporosis", "gerd", "ibs", "uti", "sinusitis", "migraine",
        "atrial fibrillation", "heart failure", "coronary artery disease",
    ),
    "medications": (
        "metformin", "lisinopril", "atorvastatin", "omeprazole", "levothyroxine",
        "amlodipine", "metoprolol", "aspirin", "ibuprofen", "acetaminophen",
        "albuterol", "sertraline", "fluoxetine", "amoxicillin", "prednisone",
        "insulin", "warfarin", "furosemide", "gabapentin", "hydrochlorothiazide",
    ),
    "tests": (
        "cbc", "bmp", "cmp", "hba1c", "tsh", "ecg", "ekg", "x-ray", "mri",
        "ct scan", "ultrasound", "urinalysis", "blood culture", "lipid panel",
        "thyroid", "glucose", "creatinine", "hemoglobin", "a1c", "echo",
        "echocardiogram", "colonoscopy", "mammogram", "pap smear",
    ),
}

# Lay phrase -> clinical term, in lookup order.
LAY_TERMS = (
    ("tummy hurts", "Abdominal Pain"),
    ("tummy ache", "Abdominal Pain"),
    ("stomach ache", "Abdominal Pain"),
    ("belly ache", "Abdominal Pain"),
    ("stomach pain", "Abdominal Pain"),
    ("abdominal pain", "Abdominal Pain"),
    ("burning sensation", "Burning sensation"),
    ("burning when urinating", "Dysuria"),
    ("burning when peeing", "Dysuria"),
    ("painful urination", "Dysuria"),
    ("throwing up", "Vomiting"),
    ("vomiting", "Vomiting"),
    ("nausea", "Nausea"),
    ("shortness of breath", "Dyspnea"),
    ("can't breathe", "Dyspnea"),
    ("difficulty breathing", "Dyspnea"),
    ("trouble breathing", "Dyspnea"),
    ("chest pain", "Chest Pain"),
    ("fever", "Fever"),
    ("headache", "Headache"),
    ("headaches", "Headache"),
    ("frequent urination", "Urinary frequency"),
    ("urinary frequency", "Urinary frequency"),
    ("fatigue", "Fatigue"),
    ("tired", "Fatigue"),
    ("cough", "Cough"),
    ("coughing", "Cough"),
    ("sore throat", "Pharyngitis"),
    ("runny nose", "Rhinorrhea"),
    ("congestion", "Nasal congestion"),
    ("back pain", "Back pain"),
    ("joint pain", "Arthralgia"),
    ("muscle pain", "Myalgia"),
    ("diarrhea", "Diarrhea"),
    ("constipation", "Constipation"),
    ("insomnia", "Insomnia"),
    ("trouble sleeping", "Insomnia"),
    ("anxiety", "Anxiety"),
    ("depression", "Depression"),
    ("dizziness", "Dizziness"),
    ("lightheadedness", "Dizziness"),
)

# Layout of the flat entity listing: (heading, labels) in printing order. The
# medication heading also takes the drug qualifier labels, as "(kind:text)".
FLAT_HEADINGS = (
    ("Chief Complaint", "chief complaint"),
    ("Symptoms", "symptom"),
    ("Diagnoses", "diagnosis"),
    ("Medications", "medication"),
    ("Tests/Labs", "test or lab order"),
    ("Procedures", "procedure"),
    ("Vital Signs", "vital sign"),
    ("Past Medical History", "past medical history"),
    ("Family History", "family history"),
    ("Social History", "social history"),
    ("Allergy", "allergy"),
    ("Treatment Plan", "treatment plan"),
    ("Follow-up", "follow-up instruction"),
    ("Body Part Or Location", "body part or location"),
    ("Severity", "severity"),
    ("Temporal Expression", "temporal expression"),
)
DRUG_QUALIFIERS = ("dosage", "frequency", "duration", "route")

NO_ENTITIES = "No entities extracted."
NO_ENTITIES_FLAT = "No clinical entities extracted."

RRF_CONSTANT = 60
CANDIDATE_POOL = 20
HIT_DIALOGUE_CHARS = 2000
PROMPT_DIALOGUE_CHARS = 6000
PROMPT_TOKEN_BUDGET = 6500
CHUNK_WORDS = 200
EXAMPLE_IDS = (1, 3747)

BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# ----------------------------------------------------- values chosen by this repo

# Rule-pass patterns; no published values exist for these.
SPECIALIST_PATTERN = (
    r"(?i)\b(?:cardiolog|dermatolog|endocrinolog|neurolog|psychiatr|psycholog|"
    r"gastroenterolog|pulmonolog|urolog|nephrolog|rheumatolog|oncolog|orthop|"
    r"ophthalmolog|gynecolog|dietitian|nutritionist|therapist|specialist)\w*"
)
DOCTOR_PATTERN = r"\b[Dd]r\.?\s+[A-Z]\w+"
DOSAGE_PATTERN = (
    r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|units?|tablets?|pills?|capsules?)\b"
    r"|\b(?:once|twice|three times)\s+(?:a\s+day|daily|weekly)\b|\bevery\s+\d+\s+hours\b"
)
VITAL_PATTERN = (
    r"(?i)\b\d{2,3}\s*/\s*\d{2,3}\b|\b(?:bp|blood pressure|heart rate|hr|bmi|"
    r"temperature|temp|weight|oxygen saturation|spo2|respiratory rate)\b\D{0,12}\d"
)
DIAGNOSIS_KEYWORDS = CLINICAL_KEYWORDS["diagnoses"]

NEGATION_CUES = ("no", "not", "denies", "without", "never")
NEGATION_SCOPE_WORDS = 5
