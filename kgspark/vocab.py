"""Fixed vocabularies and constants of the data model.

Everything in this module is a fixed value: the names, pairs and numbers have to be
exactly these for results to agree with the data model, so they are stated as plain text.
"""

from __future__ import annotations

# Namespaces.
BASE = "http://example.org/medical/"
TYPES = BASE + "types/"
RELATIONS = BASE + "relations/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
SKOS = "http://www.w3.org/2004/02/skos/core#"
SKOS_PREF = SKOS + "prefLabel"
SKOS_ALT = SKOS + "altLabel"
LABEL_PREDICATES = [RDFS_LABEL, SKOS_PREF, SKOS_ALT]

# Prefixes that a short name may use without declaring them.
PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dc": "http://purl.org/dc/elements/1.1/",
    "dcterms": "http://purl.org/dc/terms/",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "schema": "http://schema.org/",
    "med": "http://example.org/medical/",
    "medtype": "http://example.org/medical/types/",
    "medrel": "http://example.org/medical/relations/",
}
# The prefixes used when a URI is shortened for display.
DISPLAY_PREFIXES = ["rdf", "rdfs", "owl", "skos", "medtype", "medrel", "med"]

# Entity types, relation types, statuses.
ENTITY_TYPES = [
    "disease", "symptom", "finding", "organ", "imaging_procedure",
    "examination_procedure", "therapeutic_procedure", "imaging_result",
    "examination_measure", "parameter", "score", "therapy", "substance",
    "adverse_event",
]
RELATION_TYPES = [
    "has_symptom", "has_finding", "suggests", "located_in", "indicated_for",
    "produces_result", "treats", "first_line_for", "contraindicated_in",
    "rules_out", "assesses", "affects",
]

# KG classes that a mention of each entity type may link to.
ALLOWED_KG_TYPES = {
    "disease": ["Disease"],
    "symptom": ["Finding"],
    "finding": ["Finding"],
    "organ": ["Finding"],
    "imaging_procedure": ["Procedure"],
    "examination_procedure": ["Procedure"],
    "therapeutic_procedure": ["Procedure"],
    "imaging_result": ["Finding"],
    "examination_measure": ["QuantitativeMeasure"],
    "parameter": ["QuantitativeMeasure"],
    "score": ["QuantitativeMeasure"],
    "therapy": ["Substance", "Procedure"],
    "substance": ["Substance"],
    "adverse_event": ["Finding", "Disease"],
}

# Lower-case KG class names that count as entity types, and their canonical name.
KG_TYPE_SYNONYMS = {
    "quantitativemeasure": "parameter",
    "quantitative_measure": "parameter",
    "imagingprocedure": "imaging_procedure",
    "examinationprocedure": "examination_procedure",
    "therapeuticprocedure": "therapeutic_procedure",
    "imagingresult": "imaging_result",
    "examinationmeasure": "examination_measure",
    "adverseevent": "adverse_event",
    "procedure": "therapeutic_procedure",
}
CANONICAL_KG_TYPES = {**{t: t for t in ENTITY_TYPES}, **KG_TYPE_SYNONYMS}

# RDF class of each entity type, and the parent of six classes.
CLASS_NAMES = {
    "disease": "Disease",
    "symptom": "Symptom",
    "finding": "Finding",
    "organ": "Organ",
    "imaging_procedure": "ImagingProcedure",
    "examination_procedure": "ExaminationProcedure",
    "therapeutic_procedure": "TherapeuticProcedure",
    "imaging_result": "ImagingResult",
    "examination_measure": "ExaminationMeasure",
    "parameter": "Parameter",
    "score": "Score",
    "therapy": "Therapy",
    "substance": "Substance",
    "adverse_event": "AdverseEvent",
}
PARENT_CLASSES = {
    "ImagingProcedure": "Procedure",
    "ExaminationProcedure": "Procedure",
    "TherapeuticProcedure": "Procedure",
    "ExaminationMeasure": "QuantitativeMeasure",
    "Parameter": "QuantitativeMeasure",
    "Score": "QuantitativeMeasure",
}

# Link type to predicate; any other link type gives skos:related.
LINK_PREDICATES = {
    "sameAs": "http://www.w3.org/2002/07/owl#sameAs",
    "relatedTo": SKOS + "related",
    "narrowerThan": SKOS + "narrower",
    "broaderThan": SKOS + "broader",
    "closeMatch": SKOS + "closeMatch",
    "exactMatch": SKOS + "exactMatch",
}
DEFAULT_LINK_PREDICATE = SKOS + "related"

# The type pairs each relation allows.
RELATION_PAIRS = {
    "has_symptom": [("disease", "symptom"), ("disease", "finding")],
    "has_finding": [
        ("disease", "finding"), ("disease", "symptom"),
        ("imaging_procedure", "finding"), ("examination_procedure", "finding"),
    ],
    "suggests": [
        ("finding", "disease"), ("symptom", "disease"), ("imaging_result", "disease"),
        ("examination_measure", "disease"), ("parameter", "disease"),
    ],
    "located_in": [
        ("disease", "organ"), ("finding", "organ"), ("symptom", "organ"),
        ("imaging_result", "organ"), ("therapeutic_procedure", "organ"),
    ],
    "indicated_for": [
        ("imaging_procedure", "disease"), ("examination_procedure", "disease"),
        ("therapeutic_procedure", "disease"), ("substance", "disease"),
    ],
    "produces_result": [
        ("imaging_procedure", "imaging_result"),
        ("examination_procedure", "examination_measure"),
        ("examination_procedure", "finding"), ("imaging_procedure", "finding"),
    ],
    "treats": [
        ("substance", "disease"), ("therapy", "disease"),
        ("therapeutic_procedure", "disease"), ("substance", "symptom"),
    ],
    "first_line_for": [("substance", "disease"), ("therapy", "disease")],
    "contraindicated_in": [
        ("substance", "disease"), ("therapeutic_procedure", "disease"),
        ("substance", "adverse_event"),
    ],
    "rules_out": [
        ("finding", "disease"), ("imaging_result", "disease"),
        ("examination_measure", "disease"), ("parameter", "disease"),
    ],
    "assesses": [
        ("score", "disease"), ("parameter", "disease"),
        ("examination_procedure", "disease"), ("examination_measure", "disease"),
    ],
    "affects": [
        ("disease", "organ"), ("substance", "organ"),
        ("adverse_event", "organ"), ("disease", "parameter"),
    ],
}

# Relations with a direction, their source types and their target types.
DIRECTIONAL_RELATIONS = {
    "treats": (["substance", "therapy", "therapeutic_procedure"], ["disease", "symptom"]),
    "first_line_for": (["substance", "therapy"], ["disease"]),
    "produces_result": (
        ["imaging_procedure", "examination_procedure"],
        ["imaging_result", "examination_measure", "finding"],
    ),
    "assesses": (
        ["score", "parameter", "examination_procedure", "examination_measure"],
        ["disease"],
    ),
}

# Labels of other NER models, lower case without "_" and "-".
FOREIGN_LABELS = {
    "disease": "disease",
    "symptom": "symptom",
    "finding": "finding",
    "organ": "organ",
    "parameter": "parameter",
    "score": "score",
    "therapy": "therapy",
    "substance": "substance",
    "procedure": "therapeutic_procedure",
    "anatomicalstructure": "organ",
    "bacterium": "substance",
    "biologicfunction": "finding",
    "biomedicaloccupationordiscipline": "examination_procedure",
    "bodysubstance": "substance",
    "bodysystem": "organ",
    "chemical": "substance",
    "clinicalattribute": "finding",
    "eukaryote": "substance",
    "food": "substance",
    "healthcareactivity": "therapeutic_procedure",
    "injuryorpoisoning": "disease",
    "intellectualproduct": "finding",
    "medicaldevice": "imaging_procedure",
    "organization": "finding",
    "populationgroup": "finding",
    "professionaloroccupationalgroup": "finding",
    "researchactivity": "examination_procedure",
    "spatialconcept": "organ",
    "virus": "substance",
}

# Synonyms of entity types in token labels.
IOB_SYNONYMS = {
    "disease": "disease",
    "symptom": "symptom",
    "finding": "finding",
    "organ": "organ",
    "imaging_procedure": "imaging_procedure",
    "imagingprocedure": "imaging_procedure",
    "examination_procedure": "examination_procedure",
    "examinationprocedure": "examination_procedure",
    "therapeutic_procedure": "therapeutic_procedure",
    "therapeuticprocedure": "therapeutic_procedure",
    "imaging_result": "imaging_result",
    "imagingresult": "imaging_result",
    "examination_measure": "examination_measure",
    "examinationmeasure": "examination_measure",
    "parameter": "parameter",
    "score": "score",
    "therapy": "therapy",
    "substance": "substance",
    "adverse_event": "adverse_event",
    "adverseevent": "adverse_event",
    "chemical": "substance",
    "drug": "substance",
    "medication": "substance",
    "procedure": "therapeutic_procedure",
    "treatment": "therapy",
    "quantitative_measure": "parameter",
    "quantitativemeasure": "parameter",
    "measure": "parameter",
}

# The 29 token labels: O, then B- and I- of each entity type; a label's id is its position.
TOKEN_LABELS = ["O"] + [f"{side}-{t}" for t in ENTITY_TYPES for side in "BI"]
IGNORED_LABEL_ID = -100

# Words that hint at an entity type; groups are tried in this order.
TYPE_HINTS = [
    ("disease", ["itis", "osis", "emia", "oma", "pathy", "disease", "syndrome", "disorder",
                 "infection", "cancer", "tumor", "endometriosis"]),
    ("imaging_procedure", ["scan", "mri", "ct", "x-ray", "xray", "ultrasound", "angiography",
                           "radiograph", "echocardiography", "pet"]),
    ("therapeutic_procedure", ["surgery", "biopsy", "laparoscopy", "thrombectomy", "transplant",
                               "resection", "excision", "implant"]),
    ("examination_procedure", ["test", "examination", "screening", "assessment", "lab"]),
    ("substance", ["mg", "ml", "dose", "drug", "medication", "medicine", "tablet", "capsule",
                   "injection", "heparin", "insulin"]),
    ("score", ["score", "scale", "index", "wells", "apache", "glasgow"]),
    ("parameter", ["%", "level", "count", "rate", "pressure", "temperature", "mmhg", "mg/dl",
                   "d-dimer"]),
    ("organ", ["artery", "vein", "bowel", "bladder", "ureter", "ovarian", "uterus", "kidney",
               "liver", "heart", "lung", "brain", "bone"]),
    ("symptom", ["pain", "fever", "cough", "nausea", "dyspnea", "fatigue", "headache",
                 "vomiting", "dizziness"]),
]
DEFAULT_ENTITY_TYPE = "finding"

# Words of the scorecard's type rules.
POPULATION_WORDS = ["patients", "subjects", "individuals", "participants", "cohort", "group",
                    "male", "female", "adults", "children", "men", "women", "cases", "controls"]
FINDING_WORDS = ["pain", "ache", "fever", "cough", "symptom", "sign", "elevated", "decreased",
                 "abnormal", "normal", "positive", "negative", "swelling", "rash", "bleeding",
                 "dysfunction"]
GENERIC_WORDS = ["the", "a", "an", "this", "that"]
COUNTED_TYPES = ["finding", "disease", "substance"]

# Bands of a link score.
EXACT_AT = 0.95
SIMILAR_AT = 0.70
LOW_AT = 0.60

# The characters that Python's str.strip, str.split and \s treat as blank,
# as a regular-expression class for Java.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
BLANK_CHARACTERS = "".join(
    chr(c) for lo, hi in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
                          (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
    for c in range(lo, hi + 1)
)
