"""Domain vocabularies and rule values. All entries are fixed values: results depend on them.

Operators never read these directly; a vocabulary is always an argument, and these are the defaults.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    """A labelled group of spellings."""

    key: str
    label: str
    synonyms: tuple[str, ...]
    kind: str = ""


# Modification vocabulary.
MODIFICATIONS = [
    Term("galnac", "GalNAc conjugation", ("galnac", "n-acetylgalactosamine"), "targeted conjugate"),
    Term("lnp", "Lipid nanoparticle", ("lnp", "lipid nanoparticle", "lipid nanoparticles"), "delivery"),
    Term("ps", "Phosphorothioate backbone", ("phosphorothioate", "ps-aso", "ps aso"), "chemical modification"),
    Term(
        "2ome", "2'-O-methyl", ("2'-o-methyl", "2-o-methyl", "2' ome", "2-ome", "2'ome"), "chemical modification"
    ),
    Term("2moe", "2'-MOE", ("2'-moe", "2-moe", "methoxyethyl", "moe"), "chemical modification"),
    Term("lna", "Locked nucleic acid", ("lna", "locked nucleic acid"), "chemical modification"),
    Term(
        "pmo", "Phosphorodiamidate morpholino oligomer", ("pmo", "morpholino", "phosphorodiamidate"), "modality"
    ),
    Term("aso", "Antisense oligonucleotide", ("aso", "antisense", "antisense oligonucleotide"), "modality"),
    Term("sirna", "siRNA", ("sirna", "small interfering rna", "rnai"), "modality"),
]

# Off-target mechanism classes, first match wins, the last is the fallback.
OFFTARGET_CLASSES = [
    Term(
        "seed_mediated",
        "Seed-mediated / miRNA-like",
        ("seed", "3'utr", "3 utr", "mirna", "microrna", "seed-mediated", "seed match"),
    ),
    Term(
        "hybridization_mismatch",
        "Hybridization or mismatch",
        ("hybridization", "mismatch", "partial complementarity", "complementarity", "unintended binding"),
    ),
    Term(
        "transcriptome_level",
        "Transcriptome-level observation",
        ("rna-seq", "rnaseq", "transcriptome", "microarray", "expression profiling", "gene expression"),
    ),
    Term(
        "immune_like",
        "Immune-like off-target signal",
        ("immune", "tlr", "cytokine", "interferon", "inflammatory", "immunostimulation"),
    ),
    Term(
        "computational_only",
        "Computational prediction only",
        ("computational", "prediction", "in silico", "algorithm", "predicted"),
    ),
    Term("general_offtarget", "General off-target", ("off-target", "off target", "offtarget", "unintended")),
]

# Words ignored in searches.
SEARCH_STOPWORDS = (
    "a an and are b by cite curated evidence find for from grade grades in is of open pubmed record records "
    "release show source sources the verified what which with"
).split()

# Search token -> spellings that count as a hit.
SEARCH_SYNONYMS = {
    "galnac": ["galnac", "n-acetylgalactosamine"],
    "hepatotoxicity": ["hepatotoxicity", "hepatic", "liver", "hepatocyte", "hepatocellular", "alt", "ast"],
    "hepatic": ["hepatic", "hepatotoxicity", "liver", "hepatocyte", "hepatocellular", "alt", "ast"],
    "liver": ["liver", "hepatic", "hepatotoxicity", "hepatocyte", "hepatocellular", "alt", "ast"],
    "renal": ["renal", "kidney", "nephrotoxicity", "nephrotoxic"],
    "kidney": ["kidney", "renal", "nephrotoxicity", "nephrotoxic"],
    "platelet": ["platelet", "thrombocytopenia", "hematology", "blood"],
    "blood": ["blood", "hematology", "platelet", "thrombocytopenia"],
    "immune": ["immune", "immunogenicity", "cytokine", "complement", "inflammation"],
    "toxicity": ["toxicity", "toxic", "safety", "adverse"],
    "safety": ["safety", "toxicity", "adverse"],
    "offtarget": ["off-target", "off target", "offtarget", "mismatch", "hybridization", "unintended"],
    "target": ["target"],
    "seed": ["seed", "seed-mediated", "seed match", "seed region", "mirna-like", "microrna-like"],
    "mismatch": ["mismatch", "hybridization", "off-target", "off target", "offtarget"],
    "hybridization": ["hybridization", "mismatch", "off-target", "off target", "offtarget"],
    "aso": ["aso", "antisense", "antisense oligonucleotide", "gapmer"],
    "antisense": ["antisense", "aso", "gapmer"],
    "gapmer": ["gapmer", "aso", "antisense"],
    "sirna": ["sirna", "rnai", "rna interference", "small interfering rna"],
    "rnai": ["rnai", "sirna", "rna interference", "small interfering rna"],
    "lnp": ["lnp", "lipid nanoparticle", "lipid nanoparticles"],
    "moe": ["moe", "2'-moe", "2-moe", "methoxyethyl"],
    "lna": ["lna", "locked nucleic acid"],
    "pmo": ["pmo", "morpholino", "phosphorodiamidate"],
}


@dataclass(frozen=True)
class QuestionTerm:
    """A question concept: asked for by any label, found in a row by any synonym."""

    key: str
    labels: tuple[str, ...]
    synonyms: tuple[str, ...]


# Concepts recognised in questions.
QUESTION_TERMS = [
    QuestionTerm("galnac", ("galnac", "n-acetylgalactosamine"), ("galnac", "n-acetylgalactosamine")),
    QuestionTerm(
        "liver",
        ("liver", "hepatic", "hepatotoxicity"),
        ("liver", "hepatic", "hepatotoxicity", "alanine aminotransferase", "alt", "ast"),
    ),
    QuestionTerm(
        "renal",
        ("renal", "kidney", "nephrotoxicity"),
        ("renal", "kidney", "nephro", "nephrotoxicity", "creatinine"),
    ),
    QuestionTerm("platelet", ("platelet", "thrombocytopenia"), ("platelet", "thrombocytopenia", "platelets")),
    QuestionTerm("seed", ("seed", "seed-mediated"), ("seed", "seed-mediated", "seed mediated")),
    QuestionTerm("mismatch", ("mismatch", "hybridization"), ("mismatch", "hybridization", "hybridisation")),
    QuestionTerm(
        "transcriptome",
        ("transcriptome", "rna-seq", "microarray"),
        ("transcriptome", "transcriptomic", "rna-seq", "rna seq", "microarray"),
    ),
    QuestionTerm("lnp", ("lnp", "lipid nanoparticle"), ("lnp", "lipid nanoparticle", "lipid nanoparticles")),
    QuestionTerm("phosphorothioate", ("phosphorothioate", "ps"), ("phosphorothioate", "ps-aso", "ps aso")),
    QuestionTerm("lna", ("lna", "locked nucleic acid"), ("lna", "locked nucleic acid")),
]

# Question words that fix the evidence domain (the toxicity words are looked at last and win).
QUESTION_OFFTARGET_WORDS = ["off-target", "off target", "seed", "mismatch", "transcriptome"]
QUESTION_TOXICITY_WORDS = ["toxicity", "toxic", "safety", "hepato", "liver", "renal", "platelet"]
# Capital tokens that are never a target gene.
QUESTION_NON_TARGETS = ["ASO", "RNA", "DNA", "LNA", "LNP", "PMO", "PMID", "DOI"]


@dataclass(frozen=True)
class Concern:
    key: str
    domain: str
    label: str
    terms: tuple[str, ...]
    extra_from: str = ""


# Safety concerns; `extra_from` names the design column whose text is added to the terms.
CONCERNS = [
    Concern(
        "sequence_seed_offtarget",
        "offtarget",
        "Seed and hybridization off-target evidence",
        ("seed", "off-target", "hybridization", "mismatch"),
    ),
    Concern(
        "transcriptome_offtarget",
        "offtarget",
        "Transcriptome-level off-target readout",
        ("transcriptome", "RNA-seq", "microarray", "off-target"),
    ),
    Concern(
        "hepatobiliary_toxicity",
        "toxicity",
        "Hepatic and hepatobiliary toxicity",
        ("hepatotoxicity", "hepatic", "liver", "ALT", "AST", "GalNAc"),
        "modification",
    ),
    Concern("renal_toxicity", "toxicity", "Renal toxicity", ("renal", "kidney", "nephrotoxicity")),
    Concern(
        "hematology_platelet",
        "toxicity",
        "Hematology and platelet safety",
        ("platelet", "thrombocytopenia", "hematology", "blood"),
    ),
    Concern(
        "immune_inflammatory",
        "toxicity",
        "Immune and inflammatory activation",
        ("immune", "cytokine", "TLR", "immunostimulation", "inflammation"),
    ),
    Concern(
        "local_tissue",
        "toxicity",
        "Local tissue and administration-site safety",
        ("local", "injection", "tissue", "skin"),
        "delivery",
    ),
]

# Keywords per evidence domain for the sentence scan.
DOMAIN_KEYWORDS = {
    "toxicity": [
        "toxicity", "toxic", "safety", "risk", "adverse", "hepatotoxicity", "renal", "hematological",
        "proarrhythmic", "dna damage", "tolerability",
    ],
    "offtarget": [
        "off-target", "off target", "seed", "transcriptome", "hybridization", "mismatch", "unintended", "silencing",
    ],
    "chemistry": [
        "chemical", "modification", "modified", "phosphorothioate", "galnac", "2'-o", "2'-moe", "lna", "amna",
        "conjugate",
    ],
    "delivery": ["delivery", "nanoparticle", "galnac", "conjugated", "lnp", "uptake", "route"],
    "assay": ["assay", "screen", "preclinical", "model", "rna-seq", "experiment", "phase", "trial"],
    "benchmark": ["database", "model", "prediction", "tool", "generator", "benchmark", "challenge", "dataset"],
}


@dataclass(frozen=True)
class QueueTask:
    domain: str
    target: str
    grade: str
    priority: str
    title_words: tuple[str, ...] = ()
    source_types: tuple[str, ...] = ()
    always: bool = False


# Curation tasks opened per source, and what in the title or source type opens them.
QUEUE_TASKS = [
    QueueTask("source_provenance", "source_location", "C", "high", always=True),
    QueueTask("molecule_identity", "sequence_or_molecule_name", "B", "high", always=True),
    QueueTask(
        "chemistry", "site_level_modification_or_chemistry_summary", "B", "high",
        ("chemical", "modified", "modification", "phosphorothioate", "galnac", "locked nucleic acid", "lna", "moe",
         "morpholino", "pmo", "conjugate", "chemistry"),
    ),
    QueueTask(
        "delivery", "delivery_modality_and_route", "C", "medium",
        ("delivery", "nanoparticle", "galnac", "lnp", "conjugate", "formulation", "uptake", "lipid", "carrier",
         "vehicle", "targeted"),
    ),
    QueueTask(
        "assay", "model_system_dose_time_replicates", "B", "high",
        ("trial", "phase", "screen", "screening", "assay", "preclinical", "nonclinical", "toxicology", "model",
         "clinical", "patient", "dose", "study"),
    ),
    QueueTask(
        "toxicity", "toxicity_endpoint_and_direction", "B", "high",
        ("toxicity", "toxic", "safety", "risk", "adverse", "tolerability", "immunogenicity", "immunostimulation",
         "immune", "innate", "cytokine", "interferon", "tlr", "complement", "platelet", "thrombocytopenia",
         "hepatotoxicity", "liver", "renal", "kidney", "hematological", "dna damage"),
    ),
    QueueTask(
        "offtarget", "transcriptome_or_seed_offtarget_evidence", "B", "high",
        ("off-target", "off target", "seed", "transcriptome", "hybridization", "mismatch", "specificity",
         "unintended", "silencing", "rna-seq", "microarray"),
    ),
    QueueTask(
        "benchmark", "benchmark_eligibility_and_leakage_group", "C", "medium",
        ("database", "dataset", "benchmark", "prediction", "model", "machine learning"),
        ("industry_guidance", "tool_reference", "method_reference", "literature_signal"),
    ),
]

# Source types that get no curation tasks.
QUEUE_EXCLUDED_TYPES = ["nar_guideline", "nar_editorial", "closest_work"]

# Source types by manifest priority class.
CORE_SOURCE_TYPES = [
    "nar_guideline", "nar_editorial", "challenge_notice", "closest_work", "database_reference",
    "industry_guidance", "tool_reference",
]
CONTEXT_SOURCE_TYPES = ["review_reference"]

# Weights of title keywords in source discovery.
TITLE_WEIGHTS = {
    "toxicity": 4, "toxic": 4, "safety": 4, "off-target": 4, "off target": 4, "seed": 3, "transcriptome": 3,
    "hepatotoxicity": 4, "renal": 3, "hematological": 3, "thrombocytopenia": 4, "dna damage": 4,
    "phosphorothioate": 3, "galnac": 2, "antisense": 2, "sirna": 2, "oligonucleotide": 2, "rna interference": 2,
    "immunogenicity": 3, "immunostimulation": 3, "complement": 3, "cytokine": 2, "clinical trial": 2,
    "adverse event": 3, "lipid nanoparticle": 2, "lnp": 2, "lna": 2, "2'-o-methyl": 2, "2'-moe": 2,
    "prediction": 1, "benchmark": 1, "database": 1,
}

# Fixed values: (field, group, strict) of the completeness report.
COMPLETENESS_FIELDS = [
    ("canonical_name", "identity", True),
    ("modality", "identity", True),
    ("target_gene_symbol", "identity", False),
    ("category", "safety", True),
    ("evidence_label", "safety", True),
    ("evidence_grade", "safety", True),
    ("source_title", "provenance", True),
    ("source_location", "provenance", True),
    ("pmid", "provenance", False),
    ("doi", "provenance", False),
    ("sense_sequence", "sequence", False),
    ("antisense_sequence", "sequence", False),
    ("guide_sequence", "sequence", False),
    ("passenger_sequence", "sequence", False),
    ("seed_region", "sequence", False),
    ("backbone_chemistry", "chemistry", False),
    ("sugar_modification", "chemistry", False),
    ("base_modification", "chemistry", False),
    ("conjugate_delivery", "chemistry", False),
]

# Meaning of the grades.
GRADE_TEXT = {
    "A": (
        "Grade A",
        "High-confidence curator-verified evidence with strong source localization.",
        "Suitable for citation and benchmark reuse when the endpoint matches the user's question.",
    ),
    "B": (
        "Grade B",
        "Curator-verified evidence with useful source support, but less complete context than Grade A.",
        "Suitable for citation and benchmark reuse; inspect source location before strong claims.",
    ),
    "C": (
        "Grade C",
        "Curator-verified contextual evidence retained for evidence mapping, not benchmark eligibility.",
        "Use as contextual support only; do not mix into A/B reference benchmark splits.",
    ),
}
