"""The four shipped variants of the decision cascade and the three score tables, each with its own word lists.

Lists, patterns, weights and reasons are fixed values, whole and in their own order; no list is shared between
variants. Fields: title, text (the passage, with its neighbours where a variant reads a window), passage (the
passage alone), combined (title and text), joined (title, a full stop and text), scope (what the scope rules read),
location, source_kind, article_type, evidence_domain, molecule.
"""

from __future__ import annotations

from dataclasses import dataclass

from attesta.operators.rules import Label, Reject, Score, Test, any_word, either, every, has, has_words, lacks, lacks_words, near

REASON = "reject reason: "


@dataclass(frozen=True)
class Variant:
    rejects: tuple[Reject, ...]
    grades: tuple[Label, ...]
    default_grade: str


def reject(reason: str, *tests: Test, domain: str = "") -> Reject:
    return Reject(REASON + reason, tests, domain)


ABSTRACT = has("source_kind", "abstract$")
FULL_TEXT = has("source_kind", "full_text$")
TOXICITY = has("evidence_domain", "^toxicity$")
OFFTARGET = has("evidence_domain", "^offtarget$")
NO_TEXT = lacks("text", r"\S")
IN_RESULTS = r"\bResults?\b|Figure|Fig\.|Table|Supplement"
IN_INTRODUCTION = r"\bIntroduction\b"
IN_DISCUSSION = r"\bDiscussion\b|Conclusion"

# --- 003: terms between letters and digits, then patterns ------------------------------------------------

# Molecules and modalities, wide and therapeutic.
T_OLIGO = [
    "antisense oligonucleotide", "antisense", "oligonucleotide", "ASOs", "ASO-based", "ASO-associated",
    "ASO therapeutics", "ASO drug", "gapmer", "sirna", "small interfering rna", "rnai", "rna interference", "galnac",
    "locked nucleic acid", "lna", "phosphorothioate", "morpholino oligomer", "morpholino oligo",
    "phosphorodiamidate morpholino", "pmo", "nanp", "dna origami", "aptamer", "nusinersen", "inotersen", "inclisiran",
    "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran", "volanesorsen", "olezarsen", "pelacarsen",
    "danvatirsen", "casimersen", "eteplirsen", "golodirsen", "viltolarsen", "tofersen", "bepirovirsen", "mipomersen",
    "fomivirsen", "drisapersen", "milasen", "SLN360", "SPC5001", "GTI-2040", "CDR132L",
]
T_THERAPEUTIC = [
    "antisense oligonucleotide", "antisense", "ASOs", "ASO-based", "ASO-associated", "ASO therapeutics", "ASO drug",
    "gapmer", "sirna", "small interfering rna", "rnai therapeutic", "galnac", "locked nucleic acid", "lna",
    "phosphorothioate", "morpholino oligomer", "morpholino oligo", "phosphorodiamidate morpholino", "pmo",
    "nusinersen", "inotersen", "inclisiran", "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran",
    "volanesorsen", "olezarsen", "pelacarsen", "danvatirsen", "casimersen", "eteplirsen", "golodirsen", "viltolarsen",
    "tofersen", "bepirovirsen", "mipomersen", "fomivirsen", "drisapersen", "milasen", "SLN360", "SPC5001", "GTI-2040",
    "CDR132L",
]
# Safety, off-target (wide and strict), primary work, background articles.
T_SAFETY = [
    "safety", "safe", "tolerability", "tolerated", "adverse", "toxicity", "toxic", "cytotoxicity", "cell viability",
    "viability", "hemolysis", "hemocompatibility", "immunotoxicity", "immunogenicity", "immune activation", "cytokine",
    "interferon", "complement", "tlr", "platelet", "thrombocytopenia", "liver", "hepatic", "hepatotoxicity", "alt",
    "ast", "kidney", "renal", "histology", "body weight", "mortality", "genotoxicity", "dna damage",
]
T_OFFTARGET = [
    "off-target", "off target", "offtarget", "seed", "seed-mediated", "mismatch", "mismatched", "hybridization",
    "partially complementary", "transcriptome", "rna-seq", "microarray", "unintended", "non-target",
]
T_STRICT = [
    "off-target", "off target", "offtarget", "seed-mediated", "6-mer seed", "6mer seed", "mismatch", "mismatched",
    "hybridization-dependent", "partially complementary", "unintended",
]
T_PRIMARY = [
    "we observed", "we found", "we evaluated", "we investigated", "we tested", "we assessed", "we measured",
    "we administered", "we performed", "study showed", "results showed", "was well tolerated", "were well tolerated",
    "no adverse", "adverse events", "no toxicity", "no significant toxicity", "no signs of toxicity", "no indication",
    "cell viability", "hemolysis", "histology", "rna-seq", "luciferase", "reporter", "transcriptome", "microarray",
    "mice", "mouse", "rat", "rats", "patients", "phase", "clinical trial",
]
T_REVIEW = [
    "review", "reviews", "overview", "systematic review", "systematic reviews", "meta-analysis", "guidance",
    "recommendation", "recommendations", "perspective", "commentary", "protocol", "methods in molecular biology",
]
# Title words out of scope, those with a reason of their own first, then all.
T_FIELD_TITLE = [
    "plant", "plants", "crop", "crops", "cotton", "rice", "wheat", "maize", "soybean", "rapeseed", "grapevine",
    "fungal", "fungus", "insect", "insects", "mosquito", "beetle", "honey bee", "drosophila", "plutella", "bemisia",
    "aphid", "pest", "pesticide", "food safety",
]
T_DIAGNOSTIC_TITLE = ["diagnostic", "diagnosis", "detection", "sensor", "biosensor", "hla", "typing", "pcr", "genotyping", "single-antigen bead"]
T_EDITING_TITLE = ["crispr", "genome editing", "aav", "shrna", "mirna scaffold"]
T_DRUG_TITLE = ["polyphyllin", "cisplatin", "folic acid", "aromatase inhibitor", "statin", "natural product"]
T_MRNA_TITLE = ["mrna", "messenger rna"]
T_SCOPE_TITLE = [
    "plant", "plants", "crop", "crops", "cotton", "rice", "wheat", "maize", "soybean", "rapeseed", "grapevine",
    "fungal", "fungus", "insect", "insects", "mosquito", "beetle", "honey bee", "drosophila", "plutella", "bemisia",
    "aphid", "pest", "rhodnius", "helicoverpa", "tribulium", "kosteletzkya", "foxtail millet", "anopheles",
    "heterodera", "periplaneta", "mikania", "duck", "c. elegans", "caenorhabditis", "nematode", "grapholita",
    "nilaparvata", "locusta", "pesticide", "food safety", "hla", "typing", "diagnostic", "diagnosis", "detection",
    "sensor", "biosensor", "biosensing", "probe", "probes", "fluorescence in situ", "assay for", "single-antigen bead",
    "pcr", "qpcr", "genotyping", "genome editing", "crispr", "aav", "shrna", "mirna scaffold",
    "artificial mirna delivered by aav", "mrna delivery", "mrna", "messenger rna", "polyphyllin", "cisplatin",
    "folic acid", "aromatase inhibitor", "statin", "natural product",
]
# Organisms of the field in title or text, and molecules whose titles are exempt.
T_FIELD = [
    "plant", "plants", "crop", "crops", "cotton", "rice", "wheat", "maize", "soybean", "rapeseed", "grapevine",
    "fungal", "fungus", "insect", "insects", "mosquito", "beetle", "honey bee", "drosophila", "plutella", "bemisia",
    "aphid", "pest", "pesticide", "rhodnius", "helicoverpa", "tribulium", "grapholita", "nilaparvata", "locusta",
    "kosteletzkya", "foxtail millet", "anopheles", "heterodera", "periplaneta", "mikania", "duck", "c. elegans",
    "caenorhabditis", "nematode",
]
T_FIELD_EXEMPT = [
    "nusinersen", "inotersen", "inclisiran", "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran",
    "volanesorsen", "olezarsen", "pelacarsen", "danvatirsen", "casimersen", "eteplirsen", "golodirsen", "viltolarsen",
    "tofersen", "bepirovirsen", "SLN360", "SPC5001", "GTI-2040",
]
# Toxins, other drugs, efficacy words and the words that clear an efficacy reading.
T_TOXIN = [
    "alnps", "zno", "arsenite", "arsenic", "lead", "cadmium", "cry1ac", "triptolide", "chlorpyrifos",
    "organophosphorus", "pesticide", "amyloid beta", "lithocholic acid", "anit",
]
T_OTHER_DRUG = ["risdiplam", "apitegromab", "belzutifan", "cilostazol", "paclitaxel", "trastuzumab", "doxorubicin"]
T_EFFICACY = ["antitumor", "anti-tumor", "anticancer", "anti-cancer", "apoptosis", "proliferation", "migration", "invasion", "tumor growth", "cell death"]
T_NOT_EFFICACY = [
    "normal cell", "healthy", "hemolysis", "hemocompatibility", "adverse", "safety", "tolerability", "off-target",
    "off target", "no observable organ toxicity", "no toxicity", "low toxicity", "no cytotoxicity", "well tolerated",
    "toxicokinetics",
]
T_DIRECT_TITLE = [
    "safety", "tolerability", "toxicology", "toxicological", "toxicity", "toxicokinetics", "cytotoxicity", "hemolysis",
    "biodistribution", "adverse",
]
# Patterns of a favourable result, of what was studied, of products and of endpoints.
T_FAVOURABLE = (
    r"no|not|without|low|lower|minimal|negligible|acceptable|favorable|favourable|excellent|improved|reduced|limited|"
    r"non[- ]?toxic|biocompatible|well tolerated"
)
T_EFFECT = (
    r"toxicity|cytotoxicity|toxic|adverse|hemolysis|haemolysis|immunogenicity|safety|tolerability|tolerated|"
    r"biocompatibility"
)
T_STUDIED = (
    r"safety|tolerability|toxicology|toxicokinetics|adverse event|adverse events|platelet count|complement activation|"
    r"hepatic safety|renal safety"
)
T_DONE = r"evaluated|assessed|reported|observed|measured"
T_DONE_ON = T_DONE + r"|profile|study|trial|phase|patients|mice|monkeys|rats"
T_PRODUCT = [
    "antisense oligonucleotide", "oligonucleotide", "ASO", "gapmer", "siRNA", "small interfering RNA",
    "RNAi therapeutic", "GalNAc", "LNP", "lipid nanoparticle", "nanoparticle", "nanocomplex", "polyplex", "liposome",
    "carrier", "delivery vector", "aptamer", "NANP", "DNA origami",
]
T_ENDPOINT = [
    "safety", "safe", "tolerab", "adverse", "toxicity", "toxic", "cytotoxicity", "viability", "hemolysis",
    "hemocompatibility", "immunogenicity", "immunotoxicity", "cytokine", "interferon", "complement", "platelet",
    "thrombocytopenia", "ALT", "AST", "histology", "body weight", "mortality", "renal", "kidney", "liver",
]
T_PROTECTS = r"\b(suppress(?:es)?|attenuat(?:e|ed|es)|neutralize[sd]?|protects?|ameliorat(?:e|ed|es)|improves?)\b.{0,80}\b(neurotoxicity|toxicity|toxic RNA|injury|damage)\b"
T_DAMAGE = r"neurotoxicity|toxicity|toxic|injury|damage|inflammation|fibrosis"
T_PERTURBS = (
    r"\b(knockdown|silencing|inhibition|downregulation|down-regulation|attenuat(?:e|ed|es)|protects? against|mediates?|"
    rf"suppress(?:es)?)\b.{{0,100}}\b({T_DAMAGE})\b"
)
T_PERTURBED = (
    rf"\b({T_DAMAGE})\b.{{0,100}}\b(knockdown|silencing|inhibition|downregulation|down-regulation|attenuat(?:e|ed|es)|"
    r"protects?|suppress(?:es)?)\b"
)
T_PROBIOTIC = r"\b(probiotic|probiotics|Lactiplantibacillus|Lactobacillus|kimchi|virulence factor|toxin-encoding genes?)\b"
T_MATERIAL = (
    r"\b(hydrogels?|nanoparticles?|nanosystems?|nanocarriers?|chitosan|photothermal|camptothecin|palladium|gold|"
    r"biosensors?|sensors?|theranostic|imaging)\b"
)
T_MRNA = r"\bmRNA-based therapy\b|\bmRNA delivery\b"

DIRECT_SAFETY_TITLE = every(
    has_words("title", T_OLIGO),
    has_words("title", T_DIRECT_TITLE),
    either(
        lacks("title", T_PROTECTS),
        has_words("title", ["safety", "tolerability", "toxicology", "toxicological", "toxicokinetics", "adverse", "cytotoxicity"]),
    ),
)
EXPLICIT_SAFETY = has(
    "text",
    rf"\b({T_FAVOURABLE})\b.{{0,90}}\b({T_EFFECT})\b|\b({T_EFFECT})\b.{{0,90}}\b({T_FAVOURABLE})\b|"
    rf"\b({T_STUDIED})\b.{{0,130}}\b({T_DONE_ON})\b|\b({T_DONE})\b.{{0,130}}\b({T_STUDIED})\b",
)
NOT_EFFICACY_READOUT = [has_words("combined", T_EFFICACY), lacks_words("combined", T_NOT_EFFICACY)]
IS_THERAPEUTIC = has_words("combined", T_THERAPEUTIC)

R_NON_OLIGO = "safety endpoint belongs to non-oligonucleotide therapeutic"
R_MECHANISM = "disease-mechanism study using RNA perturbation, not oligo safety evidence"
R_PROBIOTIC = "probiotic/genome safety study, not therapeutic oligonucleotide evidence"
R_APTAMER = "aptamer material/drug-delivery safety, not core ASO/siRNA therapeutic oligo evidence"
R_MRNA = "mRNA delivery context, not ASO/siRNA/off-target evidence"
R_FIELD = "agricultural/plant/insect/non-therapeutic RNAi context"
R_GUIDANCE = "review/guidance/protocol rather than primary safety/off-target evidence"
R_ASSAY = "diagnostic or assay-development article, not therapeutic oligo safety evidence"
R_SPECIFICITY = "delivery/efficacy specificity rather than oligo off-target evidence"
R_EFFICACY = "cytotoxicity appears to be efficacy/cancer-killing readout, not safety evidence"

CASCADE_003 = Variant(
    rejects=(
        reject("source location unsupported; no full-text anchor or PubMed abstract evidence", NO_TEXT),
        # The article.
        reject(R_NON_OLIGO, has_words("title", ["risdiplam", "onasemnogene", "apitegromab"]), lacks("title", r"\bnusinersen\b")),
        reject("mixed SMA therapy safety is not oligo-specific", has_words("title", ["risdiplam", "onasemnogene"]), has("title", r"\b(safety concerns|safety of risdiplam|after short-term treatment)\b")),
        reject("chemotherapy co-delivery/efficacy study, not oligo safety evidence", has_words("title", ["paclitaxel", "doxorubicin", "trastuzumab"]), has("title", r"\b(co-delivery|targeted delivery|delivery)\b"), lacks_words("title", ["toxicology", "toxicological", "toxicity study", "toxicokinetics", "safety"])),
        reject(R_NON_OLIGO, has_words("title", T_OTHER_DRUG), lacks_words("title", T_OLIGO)),
        reject("endogenous antisense/lncRNA biology, not therapeutic oligo evidence", has("title", r"\b(antisense noncoding|antisense non-coding|lncRNA|long noncoding|long non-coding)\b"), lacks_words("title", ["oligonucleotide", "ASOs", "ASO-based", "siRNA"])),
        reject(R_MECHANISM, has("title", r"\b(promotes?|regulates?|mediates?|axis|signature|biomarker|prognostic|knockdown of|senescence|hub genes|renal denervation|dipyridamole|qingshen|NUAK1)\b"), lacks_words("title", T_OLIGO)),
        reject("review or systematic review, not primary evidence", has("article_type", r"^(?:review-article|systematic-review)$")),
        reject("review/meta-analysis, not primary evidence", has("article_type", "review|meta-analysis")),
        reject("commentary/correction, not primary evidence", has("article_type", "comment|correction")),
        # The title's scope.
        reject(R_PROBIOTIC, has("title", T_PROBIOTIC)),
        reject(R_APTAMER, has("title", r"\baptamer\b"), has("title", T_MATERIAL)),
        reject(R_MRNA, has("title", T_MRNA)),
        reject("oligo used as experimental depletion tool, not safety evidence", has("title", r"\bplatelet depletion method\b")),
        reject(R_FIELD, has("title", r"c\.\s*elegans|caenorhabditis|nematode")),
        reject("imaging/theranostic delivery study, not primary safety/off-target evidence", has("title", r"\b(theranostic|light controlled imaging|imaging)\b"), lacks_words("title", ["safety", "toxicity", "toxicology", "tolerability", "adverse"])),
        reject("physicochemical/fluorescence assay, not primary safety/off-target evidence", has("title", r"\b(spectral|fluorescence|time-resolved fluorescence|exciton)\b"), lacks_words("title", ["toxicity", "safety", "tolerability", "adverse"])),
        reject("ASO is vascular disease abbreviation, not antisense oligonucleotide", has("title", r"\bASO\b.{0,60}\b(femoral|popliteal|arter(?:y|ies)|arteriosclerosis|obliterans)\b")),
        reject(R_GUIDANCE, has("title", r"\b(systematic reviews?|meta-analysis|overview of systematic|risk assessment strategy|points to consider|safe starting dose|industry perspective)\b")),
        reject("environmental/diagnostic toxicity assay, not therapeutic oligo safety evidence", has("title", r"\b(lead-caused|unknown waters|effect-directed monitoring)\b")),
        reject(R_ASSAY, has("title", r"\b(assay|monitoring|quantification|biosensing|sensor|probe|probes|fluorescence in situ)\b"), lacks_words("title", ["therapeutic", "therapy", "delivery", "safety", "toxicity", "toxicological"])),
        reject(R_FIELD, has_words("title", T_FIELD_TITLE)),
        reject(R_ASSAY, has_words("title", T_DIAGNOSTIC_TITLE)),
        reject("viral/gene-editing/shRNA modality outside core therapeutic oligo evidence", has_words("title", T_EDITING_TITLE)),
        reject("toxicity endpoint belongs to non-oligonucleotide drug or exposure", has_words("title", T_DRUG_TITLE)),
        reject(R_MRNA, has_words("title", T_MRNA_TITLE)),
        reject("out-of-scope modality or source context", has_words("title", T_SCOPE_TITLE)),
        reject(R_GUIDANCE, has_words("title", T_REVIEW)),
        # The scope of title and passage.
        reject(R_PROBIOTIC, has("combined", T_PROBIOTIC)),
        reject(R_APTAMER, has("combined", r"\baptamer\b"), has("combined", T_MATERIAL)),
        reject(R_GUIDANCE, has("combined", r"\b(in this review|we review|systematically discuss|future directions|resources, methods)\b"), domain="offtarget"),
        reject("computational/design-only off-target prediction without observed evidence", has("combined", r"\b(computational approach|computational approaches|in silico|machine learning|deep learning|algorithm|predict(?:ing|ion)?|designing siRNA|designed \d+ siRNAs)\b"), domain="offtarget"),
        reject(R_SPECIFICITY, has("combined", r"\b(nanomachine|nanodevice|targeting precision|interaction specificity|targeted delivery system|delivery system|nanobubbles|nanocarrier)\b"), lacks_words("combined", ["seed-mediated", "mismatch", "unintended transcript", "unintended transcripts", "transcriptome-wide"]), domain="offtarget"),
        reject(R_MECHANISM, has("combined", r"\b(lychee|polyphenol|mycobacterium|tuberculosis|atherosclerosis)\b"), domain="offtarget"),
        reject(R_SPECIFICITY, has("combined", r"\b(cancer|melanoma|tumou?r|glioma|carcinoma|metastasis|immunotherapy)\b"), lacks_words("combined", ["off-target", "off target", "offtarget", "mismatch", "seed-mediated", "unintended transcript", "unintended transcripts", "transcriptome-wide"]), domain="offtarget"),
        reject(R_MRNA, has("combined", T_MRNA), lacks_words("combined", ["siRNA", "small interfering RNA", "antisense oligonucleotide", "ASOs"])),
        reject(R_FIELD, has_words("combined", T_FIELD), lacks_words("title", T_FIELD_EXEMPT)),
        # The passage.
        reject("no ASO/siRNA/oligonucleotide molecule support in source text", lacks_words("combined", T_OLIGO)),
        reject("source text is background/narrative rather than primary result", lacks_words("text", T_PRIMARY), lacks("text", r"\b(no|not|well|safe|tolerated|increased|decreased|significant|observed|measured|assessed|evaluated|administered)\b")),
        reject("introduction/background anchor without primary safety/off-target result", FULL_TEXT, has("location", IN_INTRODUCTION)),
        reject(R_EFFICACY, *NOT_EFFICACY_READOUT, lacks_words("combined", T_STRICT), domain="offtarget"),
        reject(R_EFFICACY, *NOT_EFFICACY_READOUT, has("combined", "cytotoxic|toxicity|cell viability|off-target toxicity"), domain="toxicity"),
        reject("no primary safety/toxicity endpoint in verified source text", lacks_words("text", T_SAFETY), domain="toxicity"),
        reject("PubMed abstract does not report a direct oligo/product safety result", ABSTRACT, ~DIRECT_SAFETY_TITLE, ~EXPLICIT_SAFETY, domain="toxicity"),
        reject(
            "toxicity belongs to disease/toxin model where oligo is a perturbation tool",
            ~DIRECT_SAFETY_TITLE,
            either(
                has_words("joined", T_TOXIN),
                every(has("joined", T_PERTURBS + "|" + T_PERTURBED), lacks_words("title", ["safety", "tolerability", "toxicology", "toxicokinetics", "adverse"])),
            ),
            domain="toxicity",
        ),
        reject("safety/toxicity endpoint is not linked to the oligo molecule or delivery product", lacks("joined", near(T_PRODUCT, T_ENDPOINT, 120)), ~DIRECT_SAFETY_TITLE, domain="toxicity"),
        reject("no off-target/seed/mismatch/transcriptome evidence in verified source text", lacks_words("text", T_STRICT), either(lacks("text", "seed"), lacks_words("text", ["sirna", "small interfering rna", "mirna", "microRNA"])), domain="offtarget"),
    ),
    grades=(
        Label("C", (~IS_THERAPEUTIC,)),
        Label("B", (ABSTRACT, TOXICITY, has_words("text", ["phase", "patients", "clinical trial", "adverse events", "well tolerated"]))),
        Label("B", (ABSTRACT, OFFTARGET, has_words("text", ["rna-seq", "transcriptome", "seed", "off-target", "off target"]))),
        Label("C", (ABSTRACT,)),
        Label("A", (has("location", IN_RESULTS),)),
    ),
    default_grade="B",
)

# --- 009: patterns, both domains -------------------------------------------------------------------------

# Modalities, organisms out of scope, background articles, method titles.
P_OLIGO = [
    "siRNA", "small interfering RNA", "RNAi", "shRNA", "antisense oligonucleotide", "antisense", "ASO", "gapmer",
    "oligonucleotide", "oligodeoxynucleotide", "ODN", "CpG", "morpholino", "PMO", "phosphorodiamidate",
    "locked nucleic acid", "LNA", "GalNAc", "inclisiran", "patisiran", "vutrisiran", "givosiran", "lumasiran",
    "fitusiran", "olezarsen", "volanesorsen", "tofersen", "nusinersen", "inotersen", "bepirovirsen", "milasen",
    "elebsiran", "pelacarsen", "danvatirsen", "mipomersen", "eteplirsen", "drisapersen",
]
P_SCOPE = [
    "wheat", "soybean", "rice", "maize", "cotton", "arabidopsis", "plant", "plants", "crop", "crops", "seedling",
    "tomato", "tuta", "spodoptera", "bemisia", "planthopper", "pest", "pests", "sap-sucking", "fungal", "fungus",
    "insect", "cockroach", "drosophila", "drosophilid", "aphid", "mosquito", "honeybee", "beetle", "locust",
    "hyphantria", "henosepilachna", "eucryptorrhynchus", "schistosoma", "cryptosporidium", "nematode", "worm",
    "flatworm", "planarian", "zebrafish", "xenopus", r"c\\. elegans", "caenorhabditis", "duck", "goose", "chicken",
    "livestock", "bacteri", "biofilm", "Prevotella", "HLA typing", "PCR typing", "diagnostic", "biosensor", "sensor",
    "food safety", "metabolic engineering of soybean",
]
P_REVIEW = [
    "review", "reviews", "overview", "meta-analysis", "systematic review", "perspective", "commentary", "protocol",
    "roadblocks", "recent advances", "delivery of therapeutic oligonucleotides", "basic principles",
]
P_METHOD = [
    "generator", "suite", "software", "web server", "database", "algorithm", "deep learning", "machine learning",
    "in silico", "computational study", "computational design", "bioinformat", "probe", "primer", "typing", "diagnos",
    "detection", "biosensor", "microarray", "phosphoramidites",
]
# Safety endpoints, reported results, primary work, efficacy.
P_SAFETY = [
    "safety", "safe", "tolerability", "tolerated", "well tolerated", "adverse", "toxicity", "toxic", "cytotoxicity",
    "cytotoxic", "cell viability", "viability", "hemolysis", "haemolysis", "hemocompatibility", "immunotoxicity",
    "immunogenicity", "immune activation", "cytokine", "interferon", "complement", "platelet", "thrombocytopenia",
    "ALT", "AST", "alanine transaminase", "aspartate transaminase", "bilirubin", "TBIL", "BUN", "creatinine", "Scr",
    "serum chemistry", "blood chemistry", "histology", "histological", "H&E", "body weight", "organ index",
    "pathology", "pathological", "mortality", "DNA damage", "genotoxicity", "no observable adverse",
]
P_RESULT = (
    r"no significant (?:change|difference|cytotoxicity|toxicity)|no (?:observable )?adverse|"
    r"well tolerated|no signs? of toxicity|did not (?:affect|induce|cause)|"
    r"remained (?:stable|unchanged)|normal (?:ALT|AST|liver enzymes|serum)|"
    r"hemolysis rate|cell viability (?:was |remained |above)|viability (?:was |remained |above)|"
    r"platelet .*<|thrombocytopenia|ALT|AST|BUN|creatinine|histolog|H&E|body weight"
)
P_PRIMARY = [
    "we ", "our ", "this study", "results?", "methods?", "treated", "administered", "measured", "assessed",
    "evaluated", "tested", "observed", "showed", "demonstrated", "quantified", "phase [123]", "clinical trial",
    "patients?", "mice", "mouse", "rats?", "monkeys?", "cells?",
]
P_EFFICACY = [
    "tumou?r growth", "anti-?tumou?r", "anticancer", "cell death", "apoptosis", "proliferation", "migration",
    "invasion", "disease model", "inflammation", "fibrosis", "injury", "viral replication", "knockdown protects",
    "ameliorates", "attenuates", "rescues", "therapeutic efficacy", "reduced cell viability",
    "decreased cell viability", "impedes viability", "inhibited cell viability", "suppressed cell viability",
]
# Off-target words, wide and concrete, and profiling beside an effect.
P_OFFTARGET = [
    "off-target", "off target", "offtarget", "seed-mediated", "seed region", "seed match", "seed sequence",
    "miRNA-like", "microRNA-like", "mismatch", "mismatched", "hybridization", "partial complementarity",
    "partially complementary", "unintended", "non-target", "nontarget", "transcriptome", "RNA-seq", "RNA seq",
    "microarray", "gene expression profiling", "global expression", "genome-wide", "specificity", "cross-react",
]
P_CONCRETE = [
    "off-target", "off target", "offtarget", "seed-mediated", "seed match", "miRNA-like", "microRNA-like", "mismatch",
    "mismatched", "hybridization", "partial complementarity", "partially complementary", "unintended gene",
    "unintended transcript", "non-target gene", "nontarget gene", "cross-react",
]
P_PROFILED = near(
    ["RNA-seq", "RNA seq", "transcriptome", "microarray", "global gene expression", "gene expression profiling", "genome-wide"],
    ["off-target", "off target", "specificity", "unintended", "non-target", "nontarget", "mismatch", "seed", "hybridization"],
    160,
)
# Computational and laboratory words.
P_COMPUTATIONAL = [
    "in silico", "software", "algorithm", "model", "deep learning", "machine learning", "predict", "prediction", "design",
    "designer", "suite", "tool", "web server", "database", "benchmark",
]
P_WET = [
    "RNA-seq", "transcriptome", "microarray", "luciferase", "reporter", "qPCR", "RT-qPCR", "western blot",
    "cell viability", "CCK-8", "MTT", "LDH", "flow cytometry", "ELISA", "histology", "H&E", "ALT", "AST", "clinical",
    "patients?",
]
P_BACKGROUND = (
    r"\bIntroduction\b|\bBackground\b|COMMENTARY|Key Summary Points|"
    r"Emerging therapeutic approaches|Therapeutic Perspective|Perspectives and Significance"
)
P_OFFTARGET_PLACE = r"off-target|off target|offtarget|seed|mismatch|hybridization"

IN_BACKGROUND = [lacks("source_kind", "abstract$"), has("location", P_BACKGROUND)]
COMPUTED = every(has("combined", any_word(P_COMPUTATIONAL)), lacks("text", any_word(P_WET)))
R_BACKGROUND = "source support is introduction/background only"

CASCADE_009 = Variant(
    rejects=(
        reject("review/background article, not primary release evidence", either(has("title", any_word(P_REVIEW)), has("article_type", r"\bReview\b"))),
        reject("out-of-scope organism or non-therapeutic oligonucleotide context", has("scope", any_word(P_SCOPE))),
        reject("non-therapeutic oligonucleotide method/tool source", has("title", any_word(P_METHOD)), lacks("title", r"\b(clinical|patients?|mice|mouse|rats?|monkeys?|in vivo|toxicity|hepatotoxicity|safety|tolerability|off-target activit|off-target effect)\b")),
        reject("mRNA-only source, not ASO/siRNA/oligonucleotide safety or off-target evidence", has("title", r"\bmRNA\b"), lacks("title", r"\b(siRNA|ASO|antisense|CpG|oligonucleotide)\b")),
        reject("source text unavailable for curator verification", NO_TEXT),
        reject("no therapeutic oligonucleotide/siRNA/ASO safety modality supported by source context", lacks("combined", any_word(P_OLIGO)), domain="toxicity"),
        reject("source location does not contain a toxicity or safety endpoint", lacks("text", any_word(P_SAFETY)), domain="toxicity"),
        reject(R_BACKGROUND, *IN_BACKGROUND, lacks("location", r"\bSafety|Toxicity|Cytotoxicity\b"), domain="toxicity"),
        reject("safety-like term is part of disease efficacy/cell-killing readout", has("text", any_word(P_EFFICACY)), lacks("text", P_RESULT), domain="toxicity"),
        reject("safety endpoint is too generic or unsupported", lacks("text", P_RESULT), lacks("text", r"\bcytotoxicity|cell viability|hemolysis|adverse events?|well tolerated|blood chemistry|serum chemistry|histolog|H&E\b"), domain="toxicity"),
        reject("no oligonucleotide modality linked to off-target evidence", lacks("combined", any_word(P_OLIGO)), domain="offtarget"),
        reject("source location does not support specific off-target evidence", lacks("text", any_word(P_CONCRETE)), lacks("text", P_PROFILED), domain="offtarget"),
        reject(R_BACKGROUND, *IN_BACKGROUND, domain="offtarget"),
        reject("source location is discussion-only generic off-target support", has("location", IN_DISCUSSION), lacks("location", P_OFFTARGET_PLACE), domain="offtarget"),
        reject("methods source location is not an off-target assay result", has("location", r"\bMethods?\b|Materials"), lacks("location", P_OFFTARGET_PLACE + "|RNA-seq|transcriptome"), domain="offtarget"),
        reject("computational source lacks concrete off-target evidence", COMPUTED, lacks("text", r"\b(off-target|seed|mismatch|hybridization|specificity)\b"), domain="offtarget"),
        reject("off-target mention is not supported by primary analysis", lacks("text", any_word(P_WET)), ~COMPUTED, lacks("text", r"\bvalidated|evaluated|assessed|identified|profiled|screened\b"), domain="offtarget"),
    ),
    grades=(
        Label("C", (OFFTARGET, COMPUTED)),
        Label("B", (ABSTRACT, has("text", r"\bclinical|phase|patients?|well tolerated|adverse|off-target\b"))),
        Label("C", (ABSTRACT,)),
        Label("C", (has("location", r"\bIntroduction\b|\bDiscussion\b|Conclusion"),)),
        Label("A", (has("location", r"\bResults?\b|Figure|Fig\.|Table|Safety|Toxicity|Cytotoxicity|Off-target|Specificity"),)),
    ),
    default_grade="B",
)

# --- 011: abstracts, off-target only ---------------------------------------------------------------------

# Modalities, organisms out of scope, background articles, method and delivery titles.
W_OLIGO = [
    "siRNA", "small interfering RNA", "RNAi", "shRNA", "antisense oligonucleotide", "antisense", "ASO", "gapmer",
    "oligonucleotide", "oligodeoxynucleotide", "ODN", "morpholino", "PMO", "locked nucleic acid", "LNA", "GalNAc",
    "inclisiran", "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran", "olezarsen", "volanesorsen",
    "tofersen", "nusinersen", "inotersen", "bepirovirsen", "pelacarsen", "mipomersen", "eteplirsen", "drisapersen",
    "AAV-RNAi",
]
W_SCOPE = [
    "plant", "plants", "wheat", "rice", "maize", "soybean", "arabidopsis", "tomato", "crop", "seedling", "pollen",
    "brassica", "vicia faba", "faba bean", "leafhopper", "honey bee", "honey bees", "apis mellifera", "mollusk",
    "mollusc", "fungal", "fungus", "yeast", "insect", "mosquito", "aedes", "drosophila", "aphid", "beetle", "locust",
    "nematode", "worm", r"c\\. elegans", "caenorhabditis", "flatworm", "schistosoma", "fish", "zebrafish", "xenopus",
    "bacteri", "biofilm", "bacterial cells", "helicobacter", "escherichia", r"e\\. coli", "paramecium", "chicken",
    "avian", "pesticidal", "pesticide", "food safety", "HLA typing", "PCR typing", "diagnostic", "biosensor", "primer",
    "probe",
]
W_REVIEW = [
    "review", "reviews", "overview", "systematic review", "meta-analysis", "perspective", "commentary", "protocol",
    "roadmap", "recent advances", "what have we learnt", "lessons learned",
]
W_METHOD = [
    "software", "web server", "database", "algorithm", "deep learning", "machine learning", "computational model",
    "prediction model", "generator", "suite", "pipeline", "benchmark", "scoring system", "classifier", "platform",
]
W_DELIVERY = [
    "delivery", "nanoparticle", "nanoparticles", "nanocomplex", "conjugates", "hydrogel", "polymer", "polymeric",
    "dendrimer", "polymersome", "liposome", "PEI", "GNRs", "ionic liquid", "surface modification", "pharmacokinetics",
    "drug-drug interaction", "CYP450", "transporter",
]
# Off-target words, alone, beside an oligonucleotide and beside profiling.
W_OFFTARGET = [
    "off-target", "off target", "offtarget", "seed-mediated", "seed match", "seed region", "seed sequence",
    "miRNA-like", "microRNA-like", "mismatch", "mismatched", "partial complementarity", "partially complementary",
    "unintended gene", "unintended transcript", "unintended silencing", "non-target gene", "nontarget gene",
    "non-target transcript", "cross-reactivity", "cross-reactive",
]
W_BESIDE_OLIGO = near(
    ["siRNA", "small interfering RNA", "RNAi", "shRNA", "ASO", "antisense oligonucleotide", "antisense", "gapmer", "oligonucleotide", "morpholino", "PMO"],
    ["off-target", "off target", "offtarget", "seed-mediated", "seed match", "mismatch", "mismatched", "unintended gene", "unintended transcript", "non-target gene", "nontarget gene", "miRNA-like", "microRNA-like"],
    180,
)
W_PROFILED = near(
    ["RNA-seq", "RNA seq", "transcriptome", "microarray", "global gene expression", "gene expression profiling", "genome-wide"],
    ["off-target", "off target", "unintended", "non-target", "nontarget", "seed", "mismatch"],
    180,
)
W_NAMED_OLIGO = r"\b(siRNA|shRNA|ASO|antisense|gapmer|oligonucleotide|RNAi)\b"
# Primary work, results, obstacles, computational and laboratory words.
W_PRIMARY = [
    "we ", "our ", "this study", "evaluated", "assessed", "measured", "tested", "validated", "observed", "identified",
    "profiled", "RNA-seq", "transcriptome", "microarray", "luciferase", "reporter", "qPCR", "cells?", "mice", "mouse",
    "patients?", "clinical trial", "phase [123]", "in vivo", "in vitro",
]
W_RESULT = [
    "evaluat", "assess", "measur", "test", "validat", "observ", "identif", "profil", "analyz", "microarray", "RNA-seq",
    "transcriptome", "luciferase", "reporter", "qPCR", "found", "show", "demonstrat", "caus", "induc", "unexpected",
    "deregulat", "suppress", "reduce", "reduced", "minimiz", "minimized", "without off-target", "off-target-free",
    "no off-target", "mismatched target", "seed region", "seed-mediated",
]
W_OBSTACLE = (
    r"(?:hampered by|limited by|obstacle|challenge|barrier|poor delivery|poor accumulation).{0,120}"
    r"(?:off-target|off target)|"
    r"(?:off-target|off target).{0,80}(?:poor accumulation|poor circulation|delivery|barrier|"
    r"clinical application|challenging)"
)
W_COMPUTATIONAL = [
    "in silico", "software", "algorithm", "model", "deep learning", "machine learning", "predict", "prediction",
    "web server", "database", "benchmark", "computational",
]
W_WET = [
    "RNA-seq", "RNA seq", "transcriptome", "microarray", "luciferase", "reporter", "qPCR", "RT-qPCR", "western blot",
    "cells?", "mice", "mouse", "patients?", "clinical", "in vivo", "in vitro",
]

W_COMPUTED = every(has("combined", any_word(W_COMPUTATIONAL)), lacks("text", any_word(W_WET)))

CASCADE_011 = Variant(
    rejects=(
        reject("review/background article, not primary off-target evidence", either(has("title", any_word(W_REVIEW)), has("article_type", r"\bReview\b"))),
        reject("out-of-scope organism or non-therapeutic oligonucleotide context", has("scope", any_word(W_SCOPE))),
        reject("non-oligonucleotide editing/silencing modality", has("scope", r"\bCRISPR|Cas9|Cas13|dCas13\b"), lacks("scope", r"\bsiRNA|shRNA|ASO|antisense oligonucleotide|oligonucleotide therapeutic\b")),
        reject("non-therapeutic oligonucleotide method/tool source", has("title", any_word(W_METHOD)), lacks("title", r"therapeutic|clinical|patients?|mice|mouse|in vivo|GalNAc|ASO|siRNA therapeutic")),
        reject("delivery/PK source without title-level off-target assay", has("title", any_word(W_DELIVERY)), lacks("title", r"off-target|off target|offtarget|specificity|mismatch|seed")),
        reject("source text lacks concrete off-target evidence", NO_TEXT),
        reject("no oligonucleotide modality linked to off-target evidence", lacks("combined", any_word(W_OLIGO))),
        reject("source location does not support specific off-target evidence", lacks("text", W_BESIDE_OLIGO), either(lacks("text", W_PROFILED), lacks("text", W_NAMED_OLIGO))),
        reject("off-target claim is about non-oligonucleotide therapy", has("text", r"\boff[- ]target toxicit\w*\b|\boff[- ]target effect\w*\b"), has("text", r"\bsmall molecule|inhibitor|chemotherapy|drug therapy\b")),
        reject("off-target mention is a generic delivery/development obstacle", has("text", W_OBSTACLE)),
        reject("abstract does not report an off-target result or assay", lacks("text", r"\b(" + "|".join(W_RESULT) + ")")),
        reject("off-target mention is not supported by primary analysis", lacks("text", any_word(W_PRIMARY))),
        reject("generic computational method/tool without molecule-specific evidence", W_COMPUTED, has("title", any_word(W_METHOD))),
        reject("no explicit molecule, target, or cohort for verified release evidence", lacks("molecule", ".")),
    ),
    grades=(
        Label("C", (W_COMPUTED,)),
        Label("B", (has("text", r"\bRNA-seq|RNA seq|transcriptome|microarray|luciferase|reporter|clinical|patients?|mice|in vivo\b"),)),
    ),
    default_grade="C",
)

# --- 012: anchored full text, off-target only ------------------------------------------------------------

# Modalities, off-target words, organisms out of scope, background articles, method titles.
A_OLIGO = [
    "siRNA", "small interfering RNA", "RNAi", "shRNA", "short hairpin RNA", "antisense oligonucleotide", "antisense",
    "ASO", "AON", "gapmer", "oligonucleotide", "morpholino", "PMO", "locked nucleic acid", "LNA", "duplex",
    "miRNA-like", "microRNA-like", "GalNAc", "nusinersen", "inclisiran", "tofersen", "inotersen", "bepirovirsen",
    "volanesorsen", "patisiran", "vutrisiran", "givosiran", "lumasiran", "fitusiran",
]
A_OFFTARGET = [
    "off-target", "off target", "offtarget", "seed-mediated", "seed match", "seed region", "seed sequence",
    "miRNA-like", "microRNA-like", "mismatch", "mismatched", "partial complementarity", "unintended gene",
    "unintended transcript", "non-target gene", "nontarget gene", "transcriptome", "RNA-seq", "microarray",
    "global gene expression", "specificity",
]
A_SCOPE = [
    "plant", "wheat", "rice", "maize", "soybean", "arabidopsis", "tomato", "crop", "insect", "mosquito", "aedes",
    "drosophila", "beetle", "aphid", "fungal", "fungus", "yeast", "bacteri", "biofilm", "zebrafish", "xenopus",
    r"c\. elegans", "caenorhabditis", "chicken", "avian", "paramecium", "pesticidal", "diagnostic", "biosensor",
    "HLA typing", "PCR typing",
]
A_REVIEW = ["review", "overview", "meta-analysis", "systematic review", "perspective", "commentary", "protocol"]
A_METHOD = [
    "web server", "software", "database", "algorithm", "deep learning", "machine learning", "prediction tool",
    "computational model", "benchmark", "pipeline", "generator",
]
# Places of primary work and of background, words of primary work, generic statements.
A_PRIMARY_PLACE = r"\b(Results?|Figure|Fig\.|Table|Supplement)"
A_OTHER_PLACE = [
    "Background", "Introduction", "Discussions?", "Conclusion", "Conclusions", "Materials and Methods", "Methods",
    "Expected outcomes", "article body", "CELL-PENETRATING PEPTIDES",
]
A_PRIMARY = [
    "we ", "our ", "this study", "evaluated", "assessed", "measured", "tested", "validated", "observed", "identified",
    "profiled", "performed", "microarray", "RNA-seq", "RNA seq", "transcriptome", "luciferase", "reporter", "qPCR",
    "enrichment", "screen", "screened", "cells?", "mice", "mouse", "patients?", "in vivo", "in vitro",
]
A_GENERIC = (
    r"(?:well known|widely used|major concern|can cause|may cause|has been reported|"
    r"potential off-target|avoid off-target|reduce off-target).{0,140}$"
)

CASCADE_012 = Variant(
    rejects=(
        reject("PMC full-text anchor could not be verified", NO_TEXT),
        reject("review/background article, not primary off-target evidence", has("title", any_word(A_REVIEW))),
        reject("out-of-scope organism or non-therapeutic oligonucleotide context", has("combined", any_word(A_SCOPE))),
        reject("full-text anchor is background/discussion rather than primary evidence", has("location", any_word(A_OTHER_PLACE)), lacks("location", A_PRIMARY_PLACE)),
        reject("method/tool article, not molecule-specific release evidence", has("title", any_word(A_METHOD))),
        reject("anchor text lacks explicit ASO/siRNA/oligonucleotide context", lacks("text", any_word(A_OLIGO))),
        reject("anchor text lacks specific off-target evidence", lacks("text", any_word(A_OFFTARGET))),
        reject("off-target statement is not supported by primary result text", lacks("location", A_PRIMARY_PLACE), lacks("text", any_word(A_PRIMARY))),
        reject("generic off-target statement without molecule-specific result", has("passage", A_GENERIC), lacks("location", A_PRIMARY_PLACE)),
        reject("no explicit molecule name in verified source context", lacks("molecule", ".")),
    ),
    grades=(),
    default_grade="",
)

VARIANTS = {"003": CASCADE_003, "009": CASCADE_009, "011": CASCADE_011, "012": CASCADE_012}

# --- scores ----------------------------------------------------------------------------------------------

# 003: points per distinct term.
SCORES_003 = [
    Score(5, "text", terms=tuple(T_OLIGO)),
    Score(2, "text", terms=tuple(T_PRIMARY)),
    Score(6, "text", terms=tuple(T_SAFETY), domain="toxicity"),
    Score(8, "text", terms=tuple(T_OFFTARGET), domain="offtarget"),
    Score(10, "hash_exact", "^true$"),
    Score(12, "location", IN_RESULTS),
    Score(2, "location", r"\bAbstract\b"),
    Score(-10, "location", IN_INTRODUCTION),
    Score(-5, "location", r"\bDiscussion\b|\bConclusion"),
    Score(-8, "text", has_words("text", T_REVIEW).pattern),
]
# 009: points per pattern and place.
SCORES_009 = [
    Score(20, "hash_exact", "^true$"),
    Score(4, "source_kind", "full_text$"),
    Score(12, "location", IN_RESULTS + "|Methods?"),
    Score(12, "location", r"\bSafety|Toxicity|Cytotoxicity|Off-target|Off target|Specificity"),
    Score(-18, "location", IN_INTRODUCTION),
    Score(-5, "location", IN_DISCUSSION),
    Score(10, "text", any_word(P_OLIGO)),
    Score(5, "text", any_word(P_PRIMARY)),
    Score(8, "text", any_word(P_SAFETY), domain="toxicity"),
    Score(12, "text", P_RESULT, domain="toxicity"),
    Score(10, "text", any_word(P_OFFTARGET), domain="offtarget"),
    Score(18, "text", any_word(P_CONCRETE), domain="offtarget"),
    Score(12, "text", P_PROFILED, domain="offtarget"),
    Score(5, "text", any_word(P_WET), domain="offtarget"),
]
# 011: points per pattern, the window first.
SCORES_011 = [
    Score(35, "text", W_BESIDE_OLIGO),
    Score(25, "text", any_word(W_OFFTARGET), unless=W_BESIDE_OLIGO),
    Score(18, "text", W_PROFILED),
    Score(10, "text", any_word(W_OLIGO)),
    Score(8, "text", any_word(W_PRIMARY)),
    Score(6, "text", any_word(W_WET)),
    Score(-3, "text", any_word(W_COMPUTATIONAL)),
]
