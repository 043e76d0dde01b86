"""Default tables of the evidence scan: grades, attributes, anchor weights (decisions and scores: `attesta.variants`).

Fields a table may name: title, text (the passage), combined (title and passage), location, source_kind,
article_type, evidence_domain.
"""

from __future__ import annotations

from attesta.operators.rules import Label, Score, any_word, has, labels_on, lacks
from attesta.variants import P_COMPUTATIONAL, P_WET

RESULTS_PLACE = r"\bResults?\b|Figure|Fig\.|Table|Supplement"
INTRODUCTION = r"\bIntroduction\b"
DISCUSSION = r"\bDiscussion\b|Conclusion"

# Grades of accepted rows, by source kind and place.
GRADES = [
    Label("B", (has("source_kind", "abstract"), has("text", r"\bclinical|phase|patients?|well tolerated|adverse|off-target\b"))),
    Label("C", (has("source_kind", "abstract"),)),
    Label("C", (has("location", INTRODUCTION + "|" + DISCUSSION),)),
    Label("A", (has("location", RESULTS_PLACE + "|Safety|Toxicity|Cytotoxicity|Off-target|Specificity"),)),
    Label("B", (has("location", "."),)),
]
# Evidence that was only computed is grade C, whatever its place.
GRADES_COMPUTATIONAL = [Label("C", (has("is_computational_prediction", "^(?:1|true)$"),)), *GRADES]
GRADES_BY_TERMS = [
    Label("C", (has("text", any_word(["review", "guidance", "perspective", "meta-analysis"])),)),
    Label("C", (has("article_type", "^review-article$"),)),
    Label("B", (has("text", "rna-seq|transcriptome|rat|mouse|mice|in vivo|in vitro|cell|dose|study|assay|figure|table"),)),
]

# First-match attributes of a passage.
ENDPOINTS = labels_on("text", [
    ("hepatotoxicity", r"\bALT|AST|bilirubin|TBIL|liver|hepatic|hepatotoxic"),
    ("renal safety", r"\bkidney|renal|creatinine|BUN|Scr\b"),
    ("thrombocytopenia", r"\bplatelet|thrombocytopenia|hematolog"),
    ("immune activation", r"\bimmune|immunogenicity|cytokine|interferon|complement|TLR|MCP-1"),
    ("DNA damage response", r"\bDNA damage|genotoxic"),
    ("neurotoxicity", r"\bneurotoxic|CNS|neuron"),
    ("cell viability/cytotoxicity", r"\bcell viability|cytotoxic|hemolysis|haemolysis|hemocompat"),
    ("systemic safety/tolerability", r"\badverse|tolerability|tolerated|safety|biocompat"),
])
# Category of each endpoint.
ENDPOINT_CATEGORY = {
    "hepatotoxicity": "hepatic",
    "renal safety": "renal",
    "thrombocytopenia": "hematological",
    "immune activation": "immunotoxicity",
    "DNA damage response": "genotoxicity",
    "neurotoxicity": "neurological",
    "cell viability/cytotoxicity": "general safety",
    "systemic safety/tolerability": "general safety",
    "toxicity": "general toxicity",
}
EVIDENCE_TYPES = labels_on("text", [
    ("seed-mediated off-target effect", r"\b[67]-?mer seed\b|\bseed (?:match|region|sequence)\b|seed-mediated|miRNA-like|microRNA-like"),
    ("transcriptome-level off-target effect", r"\bRNA-seq|RNA seq|transcriptome|microarray|global gene expression|gene expression profiling\b"),
    ("hybridization/mismatch off-target effect", r"\bmismatch|hybridization|partial complementarity|partially complementary|cross-react"),
])
MODALITIES = labels_on("combined", [
    ("CpG oligodeoxynucleotide", r"\bCpG|ODN|oligodeoxynucleotide"),
    ("PMO", r"\bPMO|morpholino|phosphorodiamidate"),
    ("siRNA", r"\bsiRNA|small interfering|RNAi|shRNA"),
    ("ASO", r"\bantisense|ASO|gapmer|LNA"),
])
# Assay of a safety passage and of an off-target passage, in order; each has its own default.
ASSAYS_TOXICITY = labels_on("text", [
    ("clinical safety assessment", r"\bclinical|phase [123]|patients?\b"),
    ("RNA-seq", r"\bRNA-seq|transcriptome\b"),
    ("cell viability assay", r"\bMTT|CCK-8|CellTiter|cell viability\b"),
    ("LDH cytotoxicity assay", r"\bLDH\b"),
    ("in vivo toxicity", r"\bALT|AST|BUN|creatinine|serum|blood chemistry|histolog|H&E|body weight\b"),
    ("hemolysis assay", r"\bhemolysis|haemolysis\b"),
])
ASSAYS_OFFTARGET = [
    *labels_on("text", [
        ("RNA-seq/transcriptome profiling", r"\bRNA-seq|RNA seq|transcriptome\b"),
        ("microarray", r"\bmicroarray\b"),
        ("luciferase reporter", r"\bluciferase|reporter\b"),
    ]),
    Label("computational off-target prediction", (has("combined", any_word(P_COMPUTATIONAL)), lacks("text", any_word(P_WET)))),
]
ORGANISMS = labels_on("text", [
    ("human", r"\bpatients?|participants?|human\b"),
    ("non-human primate", r"\bmonkey|cynomolgus|macaque|non-human primate|NHP\b"),
    ("rat", r"\brats?\b"),
    ("mouse", r"\bmice|mouse|murine\b"),
    ("cell line", r"\bcells?|cell line|HepG2|HeLa|A549|HUVEC|PBMC|fibroblast|hepatocyte\b"),
])
TISSUES = labels_on("text", [
    ("liver", r"\bliver|hepatic|hepatocyte|HepG2|ALT|AST\b"),
    ("kidney", r"\bkidney|renal|BUN|creatinine|Scr\b"),
    ("blood/serum", r"\bserum|blood|platelet|PBMC\b"),
    ("lung", r"\blung|pulmonary|A549\b"),
    ("brain/CNS", r"\bbrain|CNS|neuron|glioma|microglia\b"),
    ("cell line", r"\bcells?|cell line|HeLa|HUVEC|fibroblast\b"),
])
DIRECTIONS = labels_on("text", [
    ("no significant change", r"\b(?:no significant|no observable|unchanged|remained stable|well tolerated|normal)\b"),
    ("increased", r"\bincreased|elevated|induced|higher|upregulated|thrombocytopenia|adverse\b"),
    ("decreased", r"\bdecreased|reduced|lower|downregulated|minimized|attenuated\b"),
])
SIGNIFICANCE = labels_on("text", [("not significant", "no significant|not significant"), ("significant", "significant|p <|p<")])
ATTRIBUTES = {
    "endpoint_name": (ENDPOINTS, "toxicity"),
    "evidence_type": (EVIDENCE_TYPES, "off-target evidence"),
    "modality_name": (MODALITIES, "oligonucleotide"),
    "assay_type": (ASSAYS_TOXICITY, "experimental safety assessment"),
    "organism": (ORGANISMS, ""),
    "tissue": (TISSUES, ""),
    "direction": (DIRECTIONS, ""),
    "significance_label": (SIGNIFICANCE, ""),
}
# The same for off-target passages: another list of assays, with its own default.
ATTRIBUTES_OFFTARGET = {**ATTRIBUTES, "assay_type": (ASSAYS_OFFTARGET, "off-target assessment")}
# Molecule name patterns and words that are no molecule.
MOLECULE_PATTERNS = [
    r"\b[A-Z]{2,}[0-9][A-Z0-9-]*\b",
    r"\b[A-Za-z0-9-]+(?:virsen|arsen|acarsen|ersen|siran|zarsen)\b",
]
NON_MOLECULES = ["rna", "dna", "aso", "sirna", "rnai", "alt", "ast", "pcr", "hla", "risc", "galnac"]
SEED_LENGTH = r"\b([67])-?mer seed\b"

# Weights of the full-text anchor scan.
ANCHOR_OLIGO = [
    "antisense oligonucleotide", "antisense", "oligonucleotide", "aso", "sirna", "small interfering rna", "rnai", "galnac",
    "gapmer", "phosphorothioate", "locked nucleic acid", "lna",
]
ANCHOR_DOMAIN_TERMS = {
    "toxicity": [
        "toxicity", "toxic", "hepatotoxicity", "neurotoxicity", "renal", "kidney", "liver", "adverse", "safety",
        "tolerability", "dna damage", "cytotoxicity", "thrombocytopenia", "immunogenicity", "complement",
    ],
    "offtarget": [
        "off-target", "off target", "seed", "unintended", "transcriptome", "mismatch", "hybridization", "silencing",
        "risc", "partially complementary",
    ],
}
ANCHOR_EXPERIMENTAL = [
    "rna-seq", "transcriptome", "rat", "mouse", "mice", "in vivo", "in vitro", "cell", "dose", "repeat-dose", "study",
    "assay", "figure", "table", "supplement",
]
ANCHOR_RESULT_WORDS = "significant|reduced|increased|mitigated|observed"


def anchor_scores(domain_terms: list[str], required: list[str], experimental: list[str], verbs: str = ANCHOR_RESULT_WORDS) -> list[Score]:
    """Points of a full-text passage for one evidence domain."""
    return [
        Score(6, "text", terms=tuple(domain_terms), match="substring"),
        Score(3, "text", terms=tuple(required), match="substring"),
        Score(2, "text", terms=tuple(experimental), match="substring"),
        Score(-8, "location", "(?-i)Abstract", otherwise=3),
        Score(-5, "location", INTRODUCTION),
        Score(-2, "location", r"\bDiscussion\b|\bConclusion"),
        Score(7, "location", r"\bResults\b"),
        Score(8, "location", r"\b(?:Fig|Figure|Table|Supplement)"),
        Score(2, "text", verbs),
    ]
