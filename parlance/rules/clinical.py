"""Default clinical tables. Every operator takes such tables as parameters."""

from __future__ import annotations

# Canonical names of clinical terms.
ALIASES = {
    "stuffy nose": "nasal congestion",
    "stuffed nose": "nasal congestion",
    "blocked nose": "nasal congestion",
    "congested nose": "nasal congestion",
    "nose congestion": "nasal congestion",
    "rhinorrhea": "runny nose",
    "anosmia": "loss of smell",
    "ageusia": "loss of taste",
    "covid": "covid-19",
    "covid 19": "covid-19",
    "covid-19": "covid-19",
    "coronavirus": "covid-19",
    "covid swab test": "covid swab",
    "covid test swab": "covid swab",
    "covid-19 swab": "covid swab",
    "covid testing": "covid test",
    "swab": "covid swab",
    "common cold": "viral infection / common cold",
    "xray": "x-ray",
    "x ray": "x-ray",
    "chest xray": "chest x-ray",
    "chest x ray": "chest x-ray",
    "chest x-ray": "chest x-ray",
    "chest radiograph": "chest x-ray",
    "short of breath": "shortness of breath",
    "difficulty breathing": "shortness of breath",
    "trouble breathing": "shortness of breath",
    "hard to breathe": "shortness of breath",
    "dizzy": "dizziness",
    "nauseous": "nausea",
    "tired": "fatigue",
    "sputum blood": "hemoptysis",
    "red spots sputum": "hemoptysis",
    "red skin": "redness",
    "sore skin": "soreness",
    "type one diabetes": "type 1 diabetes",
    "type i diabetes": "type 1 diabetes",
    "high blood pressure": "hypertension",
    "high cholesterol": "high cholesterol",
    "hypercholesterolaemia": "hypercholesterolemia",
    "tylenol cold": "tylenol cold",
    "physical examination": "physical exam",
    "lung exam": "physical exam",
    "lung examination": "physical exam",
    "prostate enlargement": "enlarged prostate",
    "pre diabetic": "prediabetes",
    "pre-diabetic": "prediabetes",
    "gallbladder removal": "cholecystectomy",
    "wisdom teeth extraction": "wisdom teeth removal",
    "wisdom tooth extraction": "wisdom teeth removal",
    "isolation for 14 days": "14-day isolation",
    "self isolation": "self-isolation",
    "saltwater gargle": "salt water gargle",
    "daily puffer": "maintenance inhaler",
    "puffer": "rescue puffer",
    "rescue puffer": "rescue puffer",
    "rescue inhaler": "rescue inhaler",
    "preventer inhaler": "maintenance inhaler",
    "bloodwork": "laboratory tests",
    "blood work": "laboratory tests",
    "blood tests": "laboratory tests",
    "class exposure": "school exposure",
    "cat allergy": "possible cat allergy",
    "pet cat": "possible cat allergy",
    "father heart attack": "family history heart attack",
    "cold air": "cold air trigger",
    "cold weather": "cold air trigger",
    "pollen": "pollen trigger",
    "exercise": "exercise trigger",
    "beta agonist": "long acting beta agonist",
    "antibiotics prophylaxis": "prophylactic antibiotics",
    "antibiotic treatment": "antibiotics",
    "tick bite location: behind left knee": "behind left knee",
}

# What a low-value denial denies (regular expressions).
LOW_VALUE_DENIALS = [
    "travel", "sick contacts?", "pets?", "mold", "dust", "asbestos", "old carpets?",
    "recreational drugs?", "marijuana use", "medications?", "other drugs?",
    "developmental delays?", "environmental exposures?",
    "family history of (respiratory problems|lung disease|other allergies|sudden death)",
    "vision/hearing changes", "blood in stool", "blood in vomit", "bloating/gas",
    "confusion(/memory loss)?", "bowel changes", "urinary symptoms", "sexual activity",
    "surgeries", "iv drugs", "flu shot", "skin changes", "cough triggers", "other triggers",
    "other allergies", "previous chest pain", "previous hospital", "previous cough",
]
LOW_VALUE_REGEX = r"^(absent|no)\s+(" + "|".join(LOW_VALUE_DENIALS) + r")$"

# Fixed values: (type, name, regex, fallback terms).
PATTERNS = [
    ("SYMPTOM", "yellow sputum", r"\byellow (?:phlegm|sputum|mucus)\b", ("yellow",)),
    ("SYMPTOM", "green sputum", r"\bgreen (?:phlegm|sputum|mucus)\b", ("green",)),
    ("SYMPTOM", "mucus production", r"\b(?:mucus|phlegm|sputum)\b", ("mucus", "phlegm", "sputum")),
    ("SYMPTOM", "loss of taste", r"\bloss of (?:sense of )?taste\b|\bcan't taste\b", ("taste",)),
    ("SYMPTOM", "loss of smell", r"\bloss of (?:sense of )?smell\b|\bcan't smell\b", ("smell",)),
    ("SYMPTOM", "hemoptysis", r"\b(?:blood|red spots?) (?:in|with) (?:sputum|phlegm|mucus)\b", ("blood",)),
    ("SYMPTOM", "worsening cough", r"\b(?:cough|coughing).{0,40}(?:worse|worsening|progressively)\b", ("cough",)),
    ("SYMPTOM", "pleuritic chest pain", r"\bchest pain\b.{0,60}\b(?:deep breath|breathing|cough|coughing)\b", ("chest pain",)),
    ("SYMPTOM", "subjective fever", r"\b(?:felt|feel|feeling) feverish\b", ("feverish",)),
    ("SYMPTOM", "decreased appetite", r"\b(?:decreased|reduced|low|poor) appetite\b", ("appetite",)),
    ("SYMPTOM", "nocturnal wheezing", r"\b(?:wheez(?:e|ing)).{0,40}\b(?:night|nighttime|sleep)\b", ("wheez",)),
    ("SYMPTOM", "difficulty deep breathing", r"\b(?:difficult|hard|trouble).{0,30}\bdeep breath", ("deep breath",)),
    ("SYMPTOM", "breathing faster", r"\bbreath(?:ing)? faster\b|\bfast breathing\b", ("breathing",)),
    ("SYMPTOM", "redness", r"\bred(?:ness)?\b", ("red",)),
    ("SYMPTOM", "tenderness", r"\btender(?:ness)?\b", ("tender",)),
    ("SYMPTOM", "soreness", r"\bsore(?:ness)?\b", ("sore",)),
    ("SYMPTOM", "flu-like symptoms", r"\bflu[- ]like symptoms?\b", ("flu-like",)),
    ("SYMPTOM", "chest soreness", r"\bchest sore(?:ness)?\b|\bsore chest\b", ("chest sore", "sore chest")),
    ("SYMPTOM", "rash", r"\brash\b", ("rash",)),
    ("SYMPTOM", "no fever", r"\bno fever\b", ("no fever",)),
    ("SYMPTOM", "absent abdominal pain", r"\bno abdominal pain\b|\bdenies abdominal pain\b", ("abdominal pain",)),
    ("SYMPTOM", "absent back or muscle pain", r"\bno (?:back|muscle) pain\b|\bdenies (?:back|muscle) pain\b", ("back pain", "muscle pain")),
    ("SYMPTOM", "absent joint pain", r"\bno joint pain\b|\bdenies joint pain\b", ("joint pain",)),
    ("SYMPTOM", "chest pain (absent)", r"\bno chest pain\b|\bdenies chest pain\b", ("no chest pain",)),
    ("DIAGNOSIS", "viral infection / common cold", r"\bviral infection\b.{0,30}\bcommon cold\b|\bcommon cold\b", ("common cold",)),
    ("DIAGNOSIS", "viral illness", r"\bviral illness\b", ("viral illness",)),
    ("DIAGNOSIS", "upper respiratory infection", r"\bupper respiratory infection\b|\buri\b", ("upper respiratory",)),
    ("DIAGNOSIS", "respiratory infection", r"\brespiratory infection\b", ("respiratory infection",)),
    ("DIAGNOSIS", "asthma exacerbation", r"\basthma exacerbation\b", ("asthma exacerbation",)),
    ("DIAGNOSIS", "asthma ruled out", r"\basthma\b.{0,30}\bruled out\b|\brule out asthma\b", ("ruled out asthma",)),
    ("DIAGNOSIS", "suspected infection", r"\bsuspected infection\b|\bconcern(?:ed)? for infection\b", ("suspected infection",)),
    ("DIAGNOSIS", "suspected allergies", r"\bsuspected allergies\b|\blikely allergies\b", ("allergies",)),
    ("DIAGNOSIS", "cardiac ischemia", r"\bcardiac ischemia\b|\bischemia\b", ("ischemia",)),
    ("DIAGNOSIS", "heart disease concern", r"\b(?:heart disease|heart attack|cardiac).{0,40}\b(?:concern|worried|worry)\b", ("heart",)),
    ("DIAGNOSIS", "tick bite", r"\btick bite\b|\btick\b.{0,30}\b(?:bite|bit)", ("tick",)),
    ("TREATMENT", "decongestants", r"\bdecongestants?\b", ("decongestant",)),
    ("TREATMENT", "nsaids", r"\bnsaids?\b|\bnon[- ]steroidal\b", ("nsaid",)),
    ("TREATMENT", "ventolin", r"\bventolin\b", ("ventolin",)),
    ("TREATMENT", "spiriva", r"\bspiriva\b", ("spiriva",)),
    ("TREATMENT", "atorvastatin", r"\batorvastatin\b", ("atorvastatin",)),
    ("TREATMENT", "diuretic", r"\bdiuretics?\b", ("diuretic",)),
    ("TREATMENT", "supplemental oxygen", r"\bsupplemental oxygen\b|\boxygen\b", ("oxygen",)),
    ("TREATMENT", "steroids", r"\bsteroids?\b|\bprednisone\b", ("steroid", "prednisone")),
    ("TREATMENT", "antibiotics", r"\bantibiotics?\b", ("antibiotic",)),
    ("TREATMENT", "long acting beta agonist", r"\blong[- ]acting beta agonist\b|\blaba\b", ("beta agonist", "laba")),
    ("TREATMENT", "inhalers", r"\binhalers\b", ("inhalers",)),
    ("TREATMENT", "salt water gargle", r"\bsalt ?water gargle\b", ("gargle",)),
    ("TREATMENT", "painkillers", r"\bpain ?killers?\b|\bpain medications?\b", ("pain",)),
    ("TREATMENT", "14-day isolation", r"\b14[- ]day isolation\b|\bisolat(?:e|ion).{0,20}\b14 days\b", ("14", "isolation")),
    ("TREATMENT", "self-isolation", r"\bself[- ]isolation\b|\bstay isolated\b", ("isolated", "isolation")),
    ("TREATMENT", "dietary modification", r"\bdiet(?:ary)? modifications?\b|\bchange (?:your )?diet\b", ("diet",)),
    ("TREATMENT", "maintenance inhaler", r"\bmaintenance inhaler\b|\bdaily puffer\b|\bpreventer inhaler\b", ("maintenance", "daily puffer")),
    ("TREATMENT", "rescue inhaler", r"\brescue inhaler\b", ("rescue inhaler",)),
    ("TREATMENT", "rescue puffer", r"\brescue puffer\b", ("rescue puffer",)),
    ("TREATMENT", "lifestyle modifications", r"\blifestyle modifications?\b", ("lifestyle",)),
    ("TREATMENT", "allergy shots", r"\ballergy shots?\b", ("allergy shot",)),
    ("TREATMENT", "prophylactic antibiotics", r"\bprophylactic antibiotics?\b", ("prophylactic",)),
    ("TREATMENT", "penicillin", r"\bpenicillin\b", ("penicillin",)),
    ("TREATMENT", "vitamins", r"\bvitamins?\b", ("vitamin",)),
    ("TREATMENT", "oral contraceptive (deyo)", r"\bdeyo\b|\boral contraceptive\b|\bbirth control\b", ("deyo", "birth control")),
    ("TREATMENT", "statin", r"\bstatins?\b", ("statin",)),
    ("PROCEDURE", "cbc", r"\bcbc\b", ("cbc",)),
    ("PROCEDURE", "electrolytes", r"\belectrolytes?\b", ("electrolyte",)),
    ("PROCEDURE", "kidney function test", r"\bkidney function(?: test)?\b|\bcreatinine\b", ("kidney",)),
    ("PROCEDURE", "abg", r"\babg\b|\barterial blood gas\b", ("abg", "arterial blood gas")),
    ("PROCEDURE", "pulse oximetry", r"\bpulse ox(?:imetry)?\b|\bo2 sat\b|\boxygen saturation\b", ("pulse", "oxygen saturation")),
    ("PROCEDURE", "chest auscultation", r"\bchest auscultation\b|\blisten(?:ing)? to (?:your )?chest\b", ("chest", "listen")),
    ("PROCEDURE", "vital signs", r"\bvital signs?\b", ("vital",)),
    ("PROCEDURE", "lyme serology", r"\blyme serology\b|\blyme blood test\b", ("lyme",)),
    ("MEDICAL_HISTORY", "hypertension history", r"\bhistory of hypertension\b|\bhypertension history\b", ("hypertension",)),
    ("MEDICAL_HISTORY", "mononucleosis", r"\bmononucleosis\b|\bmono\b", ("mono",)),
    ("MEDICAL_HISTORY", "school exposure", r"\b(?:school|class|classmate)\b.{0,60}\b(?:sick|exposure|cold)\b", ("school", "class")),
    ("MEDICAL_HISTORY", "hiking exposure", r"\bhik(?:e|ing)\b", ("hiking", "hike")),
    ("MEDICAL_HISTORY", "hay fever", r"\bhay fever\b", ("hay fever",)),
    ("MEDICAL_HISTORY", "hospital worker", r"\bhospital\b.{0,30}\bwork", ("hospital",)),
    ("MEDICAL_HISTORY", "prior er visits", r"\b(?:er|emergency).{0,30}\bvisits?\b", ("er", "emergency")),
    ("MEDICAL_HISTORY", "missed medication dose", r"\bmissed\b.{0,30}\b(?:dose|medication)\b", ("missed",)),
    ("MEDICAL_HISTORY", "exercise trigger", r"\bexercise\b.{0,30}\btrigger\b|\btrigger(?:ed)? by exercise\b", ("exercise",)),
    ("MEDICAL_HISTORY", "cold air trigger", r"\bcold air\b|\bcold weather\b", ("cold air", "cold weather")),
    ("MEDICAL_HISTORY", "pollen trigger", r"\bpollen\b", ("pollen",)),
    ("MEDICAL_HISTORY", "chemical plant work", r"\bchemical plant\b", ("chemical",)),
    ("MEDICAL_HISTORY", "family hx allergies (father)", r"\bfather\b.{0,40}\ballerg", ("father", "allerg")),
    ("MEDICAL_HISTORY", "family hx asthma (cousin)", r"\bcousin\b.{0,40}\basthma", ("cousin", "asthma")),
    ("MEDICAL_HISTORY", "brother had cold", r"\bbrother\b.{0,40}\bcold", ("brother", "cold")),
    ("MEDICAL_HISTORY", "possible cat allergy", r"\bcat\b.{0,40}\ballerg", ("cat", "allerg")),
    ("MEDICAL_HISTORY", "family history heart attack", r"\b(?:father|mother|family).{0,50}\bheart attack\b", ("heart attack",)),
    ("MEDICAL_HISTORY", "sick contact - husband", r"\bhusband\b.{0,50}\b(?:sick|cold|cough)", ("husband",)),
    ("MEDICAL_HISTORY", "carpets in home", r"\bcarpets?\b", ("carpet",)),
    ("MEDICAL_HISTORY", "prior tick bite", r"\bprior\b.{0,30}\btick bite\b|\btick bite\b.{0,30}\bbefore\b", ("tick",)),
    ("MEDICAL_HISTORY", "prior bullseye rash", r"\bbullseye rash\b", ("bullseye",)),
    ("MEDICAL_HISTORY", "gardening exposure", r"\bgarden(?:ing)?\b", ("garden",)),
    ("LOCATION", "top of head", r"\btop of (?:my |the )?head\b", ("top of", "head")),
    ("LOCATION", "throat", r"\bthroat\b", ("throat",)),
    ("LOCATION", "lungs", r"\blungs?\b", ("lung",)),
    ("LOCATION", "sinuses", r"\bsinuses?\b", ("sinus",)),
    ("LOCATION", "right chest", r"\bright chest\b|\bright side of (?:my )?chest\b", ("right", "chest")),
    ("LOCATION", "head", r"\bhead\b", ("head",)),
    ("LOCATION", "behind left knee", r"\bbehind (?:my )?left knee\b", ("left knee",)),
    ("LAB_RESULT", "temperature ~101 f", r"\b101\s*(?:f|fahrenheit)?\b", ("101",)),
    ("LAB_RESULT", "temperature 37.4 c", r"\b37\.4\s*(?:c|celsius)?\b", ("37.4",)),
]

# Where a symptom is located.
LOCATIONS = {
    "sore throat": "throat",
    "scratchy throat": "throat",
    "runny nose": "nose",
    "nasal congestion": "nose",
    "stuffy nose": "nose",
    "headache": "head",
    "top of head pain": "top of head",
    "chest pain": "chest",
    "chest tightness": "chest",
    "pleuritic chest pain": "chest",
    "chest pain with coughing": "chest",
    "sharp pain with deep breath": "right chest",
    "wheezing": "lungs",
    "shortness of breath": "lungs",
    "sinus pressure": "sinuses",
    "tick bite": "behind left knee",
    "redness": "behind left knee",
    "tenderness": "behind left knee",
}

# Symptoms that indicate a diagnosis.
INDICATIONS = {
    "covid-19": [
        "dry cough", "cough", "fever", "sore throat", "fatigue", "shortness of breath",
        "loss of taste", "loss of smell", "headache", "muscle aches", "chills",
    ],
    "viral infection / common cold": ["nasal congestion", "stuffy nose", "runny nose", "fatigue"],
    "viral illness": ["fever", "cough", "sore throat", "fatigue", "muscle aches", "chills"],
    "upper respiratory infection": ["cough", "sore throat", "runny nose", "nasal congestion"],
    "respiratory infection": ["cough", "dry cough", "fever", "shortness of breath", "yellow sputum"],
    "asthma exacerbation": ["wheezing", "shortness of breath", "chest tightness", "nocturnal wheezing"],
    "copd exacerbation": ["shortness of breath", "wheezing", "cough", "yellow sputum", "mucus production"],
    "heart disease concern": ["chest pain", "breathing faster", "difficulty deep breathing"],
    "tick bite": ["redness", "tenderness", "soreness", "rash"],
}

# What a treatment is taken for.
TREATMENT_TARGETS = {
    "insulin": [("type 1 diabetes", "MEDICAL_HISTORY")],
    "decongestants": [("nasal congestion", "SYMPTOM"), ("runny nose", "SYMPTOM")],
    "tylenol": [("fever", "SYMPTOM"), ("headache", "SYMPTOM"), ("viral illness", "DIAGNOSIS")],
    "tylenol cold": [("viral infection / common cold", "DIAGNOSIS"), ("nasal congestion", "SYMPTOM")],
    "self-isolation": [("covid-19", "DIAGNOSIS")],
    "14-day isolation": [("covid-19", "DIAGNOSIS")],
    "atorvastatin": [("high cholesterol", "MEDICAL_HISTORY"), ("hypercholesterolemia", "MEDICAL_HISTORY")],
    "statin": [("high cholesterol", "MEDICAL_HISTORY"), ("hypercholesterolemia", "MEDICAL_HISTORY")],
    "ventolin": [("asthma", "MEDICAL_HISTORY"), ("wheezing", "SYMPTOM"), ("shortness of breath", "SYMPTOM")],
    "spiriva": [("copd", "MEDICAL_HISTORY")],
    "maintenance inhaler": [("asthma", "MEDICAL_HISTORY"), ("copd", "MEDICAL_HISTORY")],
    "rescue inhaler": [("asthma exacerbation", "DIAGNOSIS"), ("shortness of breath", "SYMPTOM")],
    "rescue puffer": [("asthma exacerbation", "DIAGNOSIS"), ("shortness of breath", "SYMPTOM")],
    "steroids": [("asthma exacerbation", "DIAGNOSIS"), ("copd exacerbation", "DIAGNOSIS")],
    "antibiotics": [("infection", "DIAGNOSIS"), ("respiratory infection", "DIAGNOSIS")],
    "prophylactic antibiotics": [("tick bite", "DIAGNOSIS")],
    "salt water gargle": [("sore throat", "SYMPTOM")],
    "painkillers": [("chest pain", "SYMPTOM"), ("headache", "SYMPTOM")],
    "nsaids": [("chest pain", "SYMPTOM"), ("headache", "SYMPTOM")],
    "dietary modification": [("prediabetes", "MEDICAL_HISTORY")],
    "lifestyle modifications": [("hypertension", "MEDICAL_HISTORY"), ("prediabetes", "MEDICAL_HISTORY")],
    "allergy shots": [("seasonal allergies", "MEDICAL_HISTORY"), ("hay fever", "MEDICAL_HISTORY")],
    "diuretic": [("hypertension", "MEDICAL_HISTORY")],
    "supplemental oxygen": [("shortness of breath", "SYMPTOM"), ("copd exacerbation", "DIAGNOSIS")],
}

# Tests, and the diagnoses they rule out or confirm.
COVID_TESTS = ["covid swab", "covid test"]
GENERAL_TESTS = [
    "chest x-ray", "cbc", "electrolytes", "kidney function test", "abg", "pulse oximetry", "laboratory tests",
]
TESTED_DIAGNOSES = ["pneumonia", "respiratory infection", "copd exacerbation", "asthma exacerbation"]
FEVER_READINGS = ["temperature ~101 f", "temperature 37.4 c"]

# What a history or exposure causes.
CAUSES = {
    "daycare exposure": ["viral infection / common cold", "viral illness", "covid-19"],
    "school exposure": ["viral illness", "upper respiratory infection", "covid-19"],
    "sick contact exposure": ["viral illness", "respiratory infection", "covid-19"],
    "sick contact - husband": ["viral illness", "respiratory infection"],
    "hospital worker": ["covid-19", "respiratory infection"],
    "smoking": ["copd", "copd exacerbation"],
    "smoking history": ["copd", "copd exacerbation"],
    "past smoking": ["copd"],
    "chemical plant work": ["respiratory infection", "shortness of breath"],
    "pollen trigger": ["asthma exacerbation", "wheezing"],
    "cold air trigger": ["asthma exacerbation", "wheezing"],
    "exercise trigger": ["asthma exacerbation", "shortness of breath"],
    "carpets in home": ["asthma exacerbation", "wheezing"],
    "possible cat allergy": ["suspected allergies", "wheezing"],
    "hiking exposure": ["tick bite", "lyme disease"],
    "gardening exposure": ["tick bite"],
}

# Admissible (relation, source type, target type).
ALLOWED_PAIRS = [
    ("RULES_OUT", "PROCEDURE", "DIAGNOSIS"),
    ("RULES_OUT", "SYMPTOM", "DIAGNOSIS"),
    ("RULES_OUT", "SYMPTOM", "MEDICAL_HISTORY"),
    ("LOCATED_AT", "SYMPTOM", "LOCATION"),
    ("LOCATED_AT", "PROCEDURE", "LOCATION"),
    ("LOCATED_AT", "DIAGNOSIS", "LOCATION"),
    ("LOCATED_AT", "MEDICAL_HISTORY", "LOCATION"),
    ("TAKEN_FOR", "TREATMENT", "MEDICAL_HISTORY"),
    ("TAKEN_FOR", "TREATMENT", "DIAGNOSIS"),
    ("TAKEN_FOR", "TREATMENT", "SYMPTOM"),
    ("INDICATES", "SYMPTOM", "DIAGNOSIS"),
    ("INDICATES", "SYMPTOM", "MEDICAL_HISTORY"),
    ("INDICATES", "PROCEDURE", "DIAGNOSIS"),
    ("INDICATES", "MEDICAL_HISTORY", "DIAGNOSIS"),
    ("INDICATES", "LAB_RESULT", "DIAGNOSIS"),
    ("CAUSES", "MEDICAL_HISTORY", "DIAGNOSIS"),
    ("CAUSES", "MEDICAL_HISTORY", "MEDICAL_HISTORY"),
    ("CAUSES", "MEDICAL_HISTORY", "SYMPTOM"),
    ("CAUSES", "SYMPTOM", "SYMPTOM"),
    ("CAUSES", "DIAGNOSIS", "DIAGNOSIS"),
    ("CAUSES", "TREATMENT", "SYMPTOM"),
    ("CONFIRMS", "LAB_RESULT", "DIAGNOSIS"),
    ("CONFIRMS", "LAB_RESULT", "SYMPTOM"),
    ("CONFIRMS", "PROCEDURE", "DIAGNOSIS"),
]

# Which denied endpoint forbids an edge (relation, source, target).
NEGATION_CHECKS = [
    ("TAKEN_FOR", True, True),
    ("CAUSES", True, True),
    ("INDICATES", True, False),
    ("LOCATED_AT", True, False),
    ("CONFIRMS", False, True),
    ("RULES_OUT", False, False),
]

# Endpoint types to try first, in order (relation: sources, targets).
ENDPOINT_PRIORITY = {
    "INDICATES": (["SYMPTOM", "LAB_RESULT", "PROCEDURE", "MEDICAL_HISTORY"], ["DIAGNOSIS"]),
    "CAUSES": (["MEDICAL_HISTORY", "DIAGNOSIS", "TREATMENT"], ["DIAGNOSIS", "SYMPTOM"]),
    "LOCATED_AT": (["SYMPTOM"], ["LOCATION"]),
    "RULES_OUT": (["PROCEDURE", "LAB_RESULT", "SYMPTOM"], ["DIAGNOSIS"]),
    "TAKEN_FOR": (["TREATMENT"], ["MEDICAL_HISTORY", "DIAGNOSIS"]),
    "CONFIRMS": (["LAB_RESULT", "PROCEDURE"], ["DIAGNOSIS"]),
}

# Cue words of the deterministic extraction rules.
OUTCOME_ANCHORS = [
    "unremarkable", "stable", "clear", "normal", "negative", "positive",
    "elevated", "decreased", "mild", "moderate", "severe",
]
HISTORY_CUES = ["prior", "past", "previous", "history of"]
RELATIVES = ["mother", "father", "brother", "sister", "cousin", "grandmother", "grandfather", "family"]
BLANKET_NEGATIVE = r"^\s*(?:none of (?:that|those)|not really|i'm fine|no|nope)\b"
EXAM_DENIALS = ["no {x}", "no evidence of {x}", "negative for {x}", "clear of {x}", "{x} is normal"]


def relation_rules() -> list[tuple]:
    """(rule_set, ord, src_text, src_types, tgt_text, tgt_types, edge_type), in firing order."""
    symptom, diagnosis, history = ["SYMPTOM"], ["DIAGNOSIS"], ["MEDICAL_HISTORY"]
    rows = [("located_at", s, ["SYMPTOM", "DIAGNOSIS"], t, ["LOCATION"], "LOCATED_AT") for s, t in LOCATIONS.items()]
    rows += [("indicates", s, symptom, d, diagnosis, "INDICATES") for d, many in INDICATIONS.items() for s in many]
    rows += [("taken_for", s, ["TREATMENT"], t, [kind], "TAKEN_FOR")
             for s, many in TREATMENT_TARGETS.items() for t, kind in many]
    rows += [("rules_out", s, ["PROCEDURE"], "covid-19", diagnosis, "RULES_OUT") for s in COVID_TESTS]
    rows += [("rules_out", s, ["PROCEDURE"], d, diagnosis, "RULES_OUT")
             for s in GENERAL_TESTS for d in TESTED_DIAGNOSES]
    rows += [("confirms", s, ["LAB_RESULT"], "fever", symptom, "CONFIRMS") for s in FEVER_READINGS]
    rows += [("causes", s, history, t, ["DIAGNOSIS", "MEDICAL_HISTORY", "SYMPTOM"], "CAUSES")
             for s, many in CAUSES.items() for t in many]
    return [(rule_set, i, *rest) for i, (rule_set, *rest) in enumerate(rows, 1)]
