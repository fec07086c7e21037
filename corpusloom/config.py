"""Parameters of the retrieval engine: every term list, weight and threshold is a value that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass

# The term lists and patterns below must equal those of the engine whose results this one matches.

SECTION_PREFIXES = ("annex", "chapter", "section", "part", "appendix", "module")
REQUIREMENT_STEMS = ("shall", "must", "should", "required", "requirement", "expect", "ensure", "defined", "responsible", "procedure", "establish", "maintain", "verify", "review")
REQUIREMENT_SIGNALS = ("shall", "must", "required", "should", "ensure", "in accordance with")
BROAD_INCLUDE = ("require", "required", "requirements", "must", "shall", "should", "validation", "qualification")
BROAD_EXCLUDE = ("how to", "steps", "procedure", "investigate", "handle", "process for", "method for")
BROAD_ANCHORS = ("validation", "qualification", "shall", "must", "required", "in accordance with", "annex 15", "21 cfr 211")
HEADING_PATTERNS = ("introduction", "purpose", "scope", "recommendations", "guidance for industry", "table of contents")
BOILERPLATE = ("introduction", "purpose", "recommendations", "scope of this guidance", "this guidance represents", "table of contents", "guidance for industry")
GENERIC_TITLES = ("table of contents", "contents", "introduction", "purpose", "scope")
VALIDATION_PRIMARY = ("validation", "validate", "validated", "process validation")
VALIDATION_SECONDARY = (
    "qualification", "qualified", "iq", "oq", "pq", "acceptance criteria", "critical process parameter", "critical quality attribute",
    "continued process verification", "ongoing verification", "continued verification",
)
VALIDATION_NEGATIVE = (
    "email subject line", "co-operation between manufacturers and sponsors", "investigational medicinal products", "shall be deemed to be adulterated",
)
TOPIC_STOP = ("what", "does", "how", "for", "the", "and", "with", "under", "according", "about", "require", "requires", "required", "requirement", "gmp")
TOKEN_STOP = ("what", "how", "when", "where", "which", "should", "this", "that", "with", "from", "into")
SEARCH_STOP = ("what", "how", "when", "where", "which", "should", "could", "would")
TRAILING_STOP = ("a", "an", "the", "and", "or", "to", "of", "for", "with", "in", "on", "at", "by")
ACRONYM_CASE = ("FDA", "GMP", "CGMP", "ICH", "API", "OOS", "EMA", "WHO")
SYNONYMS = (("continuous processing", "continuous manufacturing"),)
ACRONYMS = (("gmp", "good manufacturing practice"),)
AUTHORITY_BY_FOLDER = {
    "fda": "FDA", "ema": "EMA", "eu_gmp": "EU_GMP", "ich": "ICH", "pic_s": "PIC_S", "who": "WHO", "sop": "SOP", "sops": "SOP", "other": "OTHER", "others": "OTHER",
}
AUTHORITIES = ("FDA", "EMA", "EU_GMP", "ICH", "PIC_S", "WHO", "SOP", "OTHER")
SCOPES = {"FDA": ("FDA",), "ICH": ("ICH",), "EMA": ("EMA", "EU_GMP", "PIC_S"), "SOPS": ("SOP",), "MIXED": AUTHORITIES}
OUT_OF_SPEC = ("oos", "out-of-specification", "out of specification", "out of spec", "laboratory investigation")
APR_PRIMARY = ("apr", "pqr", "product quality review", "annual product review")
VALIDATION_DOMAIN = ("validation", "vmp", "revalidation", "cleaning validation", "continued process verification", "lifecycle")
DOMAIN_PRIORITY = ("deviations", "equipment_qualification", "data_integrity", "computerized_systems", "apr", "validation")
RELAXED_DOMAINS = ("data_integrity", "computerized_systems", "apr", "validation")
DOC_HINTS = ("annex15", "validation", "qualification", "processvalidation", "211")
FRAMEWORK = (
    "stages", "lifecycle", "what documentation", "what controls", "what is required in", "what is validation", "what is process validation",
    "what is computer system validation", "what is csv", "what is an out-of-specification", "what is oos",
)
TRIGGERS = {
    "data_integrity": ("data integrity", "alcoa", "audit trail", "metadata", "record retention", "true copy"),
    "validation": ("process validation", "validation stages", "lifecycle approach", "vmp", "validation master plan", "cleaning validation", "revalidation"),
    "requalification": ("requalification", "periodic qualification"),
    "deviation": ("deviation", "nonconformance", "non conformance", "root cause"),
    "apr": ("annual product review", "product quality review"),
}
ANCHORS = {
    "apr": ("annual product review", "product quality review", "pqr", "annual review", "quality review"),
    "deviation": ("deviation", "deviation investigation", "investigation", "root cause", "impact assessment", "corrective action", "preventive action", "capa", "deviation report"),
    "data_integrity": ("data integrity", "alcoa", "audit trail", "metadata", "attributable", "legible", "contemporaneous", "original", "accurate", "record retention"),
    "validation": (
        "process validation", "stage 1", "stage 2", "stage 3", "lifecycle", "validation master plan", "vmp", "continued process verification", "cleaning validation",
        "revalidation", "ppq", "cpv",
    ),
    "requalification": ("requalification", "periodic qualification", "periodic review", "qualification review", "revalidation", "iq", "oq", "pq"),
}
TOPICS = {
    "computerized_systems": (("annex 11", "part 11", "computerised", "computerized", "electronic records", "audit trail"), ("eu_gmp/", "fda/21-cfr-part-11", "pic_s/pi 011")),
    "process_validation": (
        (
            "validation", "process validation", "continued process verification", "stage 1", "stage 2", "stage 3", "continuous manufacturing", "qualification", "dq", "iq",
            "oq", "pq", "validation master plan", "vmp", "annex 15", "qualification and validation",
        ),
        ("eu_gmp/", "eu_gmp/annex15", "fda/", "ich/"),
    ),
    "oos": (("oos", "out-of-specification", "out of specification", "retest", "retesting", "resample", "investigation"), ("fda/", "pic_s/", "who/")),
    "sterile": (("aseptic", "annex 1", "sterile", "environmental monitoring"), ("eu_gmp/", "fda/", "pic_s/")),
    "data_integrity": (("alcoa", "data integrity", "audit trail review", "data governance"), ("fda/", "pic_s/", "who/", "others/mhra")),
    "api_gmp": (("api", "ich q7", "drug substance"), ("ich/", "eu_gmp/")),
}


@dataclass(frozen=True)
class Lexicon:
    """Tokens of one domain; a sentence passes with enough strong or secondary tokens and no negative one."""

    strong: tuple[str, ...]
    secondary: tuple[str, ...]
    negative: tuple[str, ...] = ()
    min_strong: int = 1
    min_secondary: int = 2


@dataclass(frozen=True)
class Weights:
    """Numeric parameters; defaults are the matched engine's."""

    word: float = 0.62
    char: float = 0.28
    overlap: float = 0.10
    hits_cap: int = 3
    boost_per_hit: float = 0.005
    max_boost: float = 0.015
    min_similarity: float = 0.20
    fallback_similarity: float = 0.18
    top_k: int = 8
    pipeline_top_k: int = 12
    max_context: int = 8
    mmr_lambda: float = 0.60
    per_authority: int = 3
    pool: int = 80
    floor_delta: float = 0.22
    refill_gap: float = 0.02
    relevance_floor: float = 0.28
    chunk_chars: int = 1000
    min_chunk_chars: int = 220
    repeat_ratio: float = 0.60
    route_tfidf: float = 0.80
    route_name: float = 0.20
    route_topic: float = 0.15
    route_hint: float = 0.12
    top_docs: int = 5
    wide_docs: int = 8
    max_facts: int = 5
    per_doc: int = 2
    sentence_words: int = 30


DEFAULT = Weights()

# Fixed values again: the lexicons of the domains and the profiles of the priors that are in force unless a caller gives others.

COMPUTERIZED_SYSTEMS = Lexicon(
    strong=(
        "computerized system", "computerised system", "csv", "computer system validation", "system validation", "validation of computerized systems", "electronic records",
        "electronic signatures", "audit trail", "access control",
    ),
    secondary=(
        "software", "hardware", "infrastructure", "configuration", "user requirements", "urs", "functional specification", "design specification", "change control", "security", "backup",
        "restore", "data backup", "disaster recovery", "privilege", "role-based", "authentication", "authorization", "traceability", "vendor", "supplier", "periodic review",
    ),
    negative=("capa", "corrective action", "preventive action", "deviation investigation", "oos", "out of specification", "adulteration"),
)
DATA_INTEGRITY = Lexicon(
    strong=(
        "data integrity", "alcoa", "alcoa+", "attributable", "legible", "contemporaneous", "original", "accurate", "audit trail", "metadata", "data governance", "good documentation practices",
    ),
    secondary=(
        "complete", "consistent", "enduring", "available", "record retention", "retention", "raw data", "true copy", "data governance", "gdp", "record", "documentation practices", "access control",
        "user access", "backup", "restore", "time stamp", "timestamp", "controlled records", "record controls", "backup and restore", "audit trail review", "access rights", "user privileges",
        "attributable legible", "contemporaneous original",
    ),
    negative=("cleaning validation", "process validation", "iq", "oq", "pq", "installation qualification", "operational qualification", "performance qualification"),
)
DEVIATIONS = Lexicon(
    strong=(
        "deviation", "nonconformance", "non-conformance", "departure", "discrepancy", "incident", "investigation", "root cause", "deviation handling", "deviation management", "investigation report",
        "impact assessment", "capa", "oos investigation",
    ),
    secondary=(
        "impact assessment", "assessment", "immediate action", "containment", "corrective action", "preventive action", "capa", "disposition", "documentation", "record", "batch impact",
        "product impact", "qms", "classification", "disposition decision", "qa approval", "quality unit", "documented", "evaluate impact", "implement capa", "documented fully", "highest priority",
    ),
    negative=("audit trail", "electronic records", "electronic signatures", "computer system validation", "computerized system"),
)
EQUIPMENT_QUALIFICATION = Lexicon(
    strong=(
        "qualification", "equipment qualification", "equipment", "analytical equipment qualification", "iq", "oq", "pq", "installation qualification", "operational qualification",
        "performance qualification", "instrument qualification", "system qualification", "qualification plan", "qualification protocol", "qualification report", "protocol/plan",
    ),
    secondary=(
        "urs", "user requirements", "acceptance criteria", "calibration", "maintenance", "verification", "validation plan", "protocol", "documented evidence", "intended use", "critical equipment",
        "installation", "operational", "performance", "commissioning", "verification", "requalification", "periodic qualification", "intended purpose", "internal documentation",
        "criteria and limits", "summarized and reported", "document/report", "original plan", "approved plan", "reduced testing", "reduced document",
    ),
    negative=("annual product review", "product quality review", "pqr", "apr", "trending"),
)
APR = Lexicon(
    strong=(
        "annual product review", "product quality review", "apr", "pqr", "annual review", "product review", "quality review", "product quality review report", "investigations", "included in the review",
    ),
    secondary=(
        "trending", "trend", "batch review", "complaints", "deviations", "oos", "stability", "stability data", "process performance", "product quality", "quality metrics", "corrective actions", "capa",
        "change control", "recalls", "batch records", "manufacturing process", "process changes", "quality system", "rejections", "returns", "investigations", "yield",
        "critical quality attributes", "specification", "batch release", "review frequency", "audit trail review",
    ),
    negative=("audit trail", "electronic signatures", "computerized system validation", "computer system validation", "access control"),
)
VALIDATION = Lexicon(
    strong=(
        "process validation", "validation lifecycle", "continued process verification", "stage 1", "stage 2", "stage 3", "validation master plan", "vmp", "cleaning validation", "cleaning procedure",
        "revalidation", "validated state", "quality unit review", "process variability", "fit for its intended use",
    ),
    secondary=(
        "protocol", "validation protocol", "validation report", "qualification", "verification", "commercial distribution", "process performance", "ppq", "cpv", "acceptance criteria",
        "quality, safety, and efficacy", "designed or built into the product",
    ),
)
LEXICONS = {
    "computerized_systems": COMPUTERIZED_SYSTEMS, "data_integrity": DATA_INTEGRITY, "deviations": DEVIATIONS, "equipment_qualification": EQUIPMENT_QUALIFICATION, "apr": APR, "validation": VALIDATION,
}
PROFILES = (
    {
        "signals": ("risk management", "risk managment", "quality risk management", "ich q9", "q9"),
        "authority": {"ICH": 0.12},
        "file": (("q9", 0.26), ("q10", 0.04)),
        "text": (
            ("quality risk management is a systematic process for the assessment, control, communication", 0.45),
            ("quality risk management (qrm): a systematic process", 0.30),
            ("systematic process for the assessment, control, communication and review of risks to quality", 0.30),
        ),
    },
    {
        "signals": ("continuous manufacturing", "continuous processing", "ich q13", "q13"),
        "authority": {"ICH": 0.08},
        "file": (("q13", 0.08),),
        "text": (("continuous manufacturing (cm)", 0.12), ("development, implementation, operation, and lifecycle management of continuous manufacturing", 0.16)),
    },
    {
        "signals": ("data integrity", "alcoa", "audit trail", "part 11", "annex 11"),
        "authority": {"FDA": 0.07, "PIC_S": 0.05, "WHO": 0.05, "EMA": 0.03},
        "file": (
            ("data integrity and compliance", 0.16), ("trs1033-annex4-guideline-on-data-integrity", 0.12), ("pi 041", 0.08), ("data integrity", 0.08), ("part-11", 0.06), ("annex11", 0.06),
        ),
    },
    {
        "signals": ("process validation", "validation lifecycle", "continued process verification"),
        "authority": {"FDA": 0.07, "ICH": 0.06, "EU_GMP": 0.05},
        "file": (("process-validation", 0.14), ("annex15", 0.12), ("q8", 0.06), ("q11", 0.06)),
    },
    {
        "signals": ("deviation", "capa", "corrective action", "preventive action"),
        "authority": {"FDA": 0.06, "ICH": 0.05, "EU_GMP": 0.04},
        "file": (("q10", 0.10), ("deviation", 0.07), ("capa", 0.07)),
    },
    {
        "signals": ("sop", "internal sop", "our procedure", "work instruction", "company procedure"),
        "authority": {"SOP": 0.30},
        "file": (("sop", 0.18), ("manual-", 0.12), ("validation and verification", 0.10)),
    },
)
