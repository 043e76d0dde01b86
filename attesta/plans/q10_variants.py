"""Queries: the four shipped decision cascades, the three score tables and molecule names over whole sentences.

The test prose holds none of the vocabulary, so every sentence and title gets the words of one case appended; each
case was written to meet one rule. Sentences and titles stay whole.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import mining, rules
from attesta.operators.molecules import NAMES_009, NAMES_011, NAMES_012, Naming, modality_012, name_hints, name_molecule
from attesta.operators.rules import LEFT, RIGHT, Combined, Label, Reject, Score
from attesta.operators.windows import passage_window
from attesta.plans.q06_mining import SENT
from attesta.plans.registry import query
from attesta.sources.adapters import evidence_tables, text_table
from attesta.variants import SCORES_003, SCORES_009, SCORES_011, VARIANTS


@dataclass(frozen=True)
class Case:
    """Words to append, the place of the passage, and what the cascade says when nothing else is there."""

    reason: str  # without the common prefix; empty for accepted
    text: str | None = ""  # None: the passage has no text
    title: str = ""
    location: str = "Results paragraph 1"
    source_kind: str = "pmc_full_text"
    domain: str = "toxicity"
    article_type: str = ""
    scope: str = ""
    grade: str = ""


SAFE = "the antisense oligonucleotide was well tolerated in mice with no toxicity"
OFF = "we measured off-target silencing by the siRNA seed region"
OT, ABS = "offtarget", "pubmed_abstract"

CASES_003 = (
    Case("", SAFE, grade="A"),
    Case("", SAFE, location="Methods paragraph 2", grade="B"),
    Case("", SAFE, location="Abstract", source_kind=ABS, grade="B"),
    Case("", "we measured the aptamer and found low toxicity", location="Abstract", source_kind=ABS, grade="C"),
    Case("", OFF, domain=OT, grade="A"),
    Case("", OFF, location="Abstract", source_kind=ABS, domain=OT, grade="B"),
    Case("", "no unintended binding of the aptamer", domain=OT, grade="C"),
    Case("source location unsupported; no full-text anchor or PubMed abstract evidence", None),
    Case("safety endpoint belongs to non-oligonucleotide therapeutic", SAFE, "Onasemnogene in infants"),
    Case("safety endpoint belongs to non-oligonucleotide therapeutic", SAFE, "Cilostazol for stroke"),
    Case("mixed SMA therapy safety is not oligo-specific", SAFE, "Safety of risdiplam after nusinersen"),
    Case("chemotherapy co-delivery/efficacy study, not oligo safety evidence", SAFE, "Delivery of siRNA and doxorubicin"),
    Case("endogenous antisense/lncRNA biology, not therapeutic oligo evidence", SAFE, "A lncRNA in liver"),
    Case("disease-mechanism study using RNA perturbation, not oligo safety evidence", SAFE, "A kinase regulates growth"),
    Case("disease-mechanism study using RNA perturbation, not oligo safety evidence", OFF + " in atherosclerosis", domain=OT),
    Case("review or systematic review, not primary evidence", SAFE, article_type="Review-Article"),
    Case("review/meta-analysis, not primary evidence", SAFE, article_type="journal article; review"),
    Case("commentary/correction, not primary evidence", SAFE, article_type="correction"),
    Case("probiotic/genome safety study, not therapeutic oligonucleotide evidence", SAFE, "Kimchi isolates"),
    Case("probiotic/genome safety study, not therapeutic oligonucleotide evidence", SAFE + " fed with a probiotic"),
    Case("aptamer material/drug-delivery safety, not core ASO/siRNA therapeutic oligo evidence", SAFE, "Aptamer hydrogel"),
    Case("aptamer material/drug-delivery safety, not core ASO/siRNA therapeutic oligo evidence", SAFE + " on an aptamer with gold"),
    Case("mRNA delivery context, not ASO/siRNA/off-target evidence", SAFE, "mRNA-based therapy of the lung"),
    Case("mRNA delivery context, not ASO/siRNA/off-target evidence", "no toxicity of the aptamer after mRNA delivery"),
    Case("mRNA delivery context, not ASO/siRNA/off-target evidence", SAFE, "Messenger RNA in muscle"),
    Case("oligo used as experimental depletion tool, not safety evidence", SAFE, "A platelet depletion method"),
    Case("agricultural/plant/insect/non-therapeutic RNAi context", SAFE, "Feeding C.elegans"),
    Case("agricultural/plant/insect/non-therapeutic RNAi context", SAFE, "Spraying cotton"),
    Case("agricultural/plant/insect/non-therapeutic RNAi context", SAFE + " and in duck embryos"),
    Case("imaging/theranostic delivery study, not primary safety/off-target evidence", SAFE, "Imaging of the brain"),
    Case("physicochemical/fluorescence assay, not primary safety/off-target evidence", SAFE, "Spectral shifts"),
    Case("ASO is vascular disease abbreviation, not antisense oligonucleotide", SAFE, "ASO of the femoral vessels"),
    Case("review/guidance/protocol rather than primary safety/off-target evidence", SAFE, "Points to consider"),
    Case("review/guidance/protocol rather than primary safety/off-target evidence", SAFE, "Recommendations of a panel"),
    Case("review/guidance/protocol rather than primary safety/off-target evidence", OFF + " and future directions", domain=OT),
    Case("environmental/diagnostic toxicity assay, not therapeutic oligo safety evidence", SAFE, "Lead-caused harm"),
    Case("diagnostic or assay-development article, not therapeutic oligo safety evidence", SAFE, "Quantification in plasma"),
    Case("diagnostic or assay-development article, not therapeutic oligo safety evidence", SAFE, "Genotyping of donors"),
    Case("viral/gene-editing/shRNA modality outside core therapeutic oligo evidence", SAFE, "CRISPR in muscle"),
    Case("toxicity endpoint belongs to non-oligonucleotide drug or exposure", SAFE, "A natural product"),
    Case("out-of-scope modality or source context", SAFE, "Mikania leaves"),
    Case("computational/design-only off-target prediction without observed evidence", OFF + " in silico", domain=OT),
    Case("delivery/efficacy specificity rather than oligo off-target evidence", OFF + " with a nanocarrier", domain=OT),
    Case("delivery/efficacy specificity rather than oligo off-target evidence", "we measured siRNA in melanoma", domain=OT),
    Case("no ASO/siRNA/oligonucleotide molecule support in source text", "no toxicity was observed"),
    Case("source text is background/narrative rather than primary result", "siRNA toxicity is a topic"),
    Case("introduction/background anchor without primary safety/off-target result", SAFE, location="Introduction paragraph 1"),
    Case("cytotoxicity appears to be efficacy/cancer-killing readout, not safety evidence", "siRNA increased cytotoxicity and apoptosis"),
    Case("cytotoxicity appears to be efficacy/cancer-killing readout, not safety evidence", "siRNA decreased invasion", domain=OT),
    Case("no primary safety/toxicity endpoint in verified source text", "siRNA increased expression"),
    Case("PubMed abstract does not report a direct oligo/product safety result", "siRNA increased cytokine levels", location="Abstract", source_kind=ABS),
    Case("toxicity belongs to disease/toxin model where oligo is a perturbation tool", "siRNA decreased toxicity of cadmium"),
    Case("toxicity belongs to disease/toxin model where oligo is a perturbation tool", "silencing by siRNA decreased renal injury"),
    Case("safety/toxicity endpoint is not linked to the oligo molecule or delivery product", "pmo was given and increased mortality"),
    Case("no off-target/seed/mismatch/transcriptome evidence in verified source text", "we measured siRNA levels", domain=OT),
)

CASES_009 = (
    Case("", SAFE, grade="A"),
    Case("", SAFE, location="Methods paragraph 1", grade="B"),
    Case("", SAFE, location="Abstract", source_kind=ABS, grade="B"),
    Case("", "siRNA with body weight loss", location="Abstract", source_kind=ABS, grade="C"),
    Case("", SAFE, location="Discussion paragraph 1", grade="C"),
    Case("", OFF + " by RNA-seq", domain=OT, grade="A"),
    Case("", OFF + " of a model", domain=OT, grade="C"),
    Case("review/background article, not primary release evidence", SAFE, "Recent advances"),
    Case("review/background article, not primary release evidence", SAFE, article_type="journal article; review"),
    Case("out-of-scope organism or non-therapeutic oligonucleotide context", SAFE, scope="cockroach siRNA"),
    Case("non-therapeutic oligonucleotide method/tool source", SAFE, "A web server"),
    Case("mRNA-only source, not ASO/siRNA/oligonucleotide safety or off-target evidence", SAFE, "mRNA vaccines"),
    Case("source text unavailable for curator verification", None),
    Case("no therapeutic oligonucleotide/siRNA/ASO safety modality supported by source context", "no adverse findings"),
    Case("source location does not contain a toxicity or safety endpoint", "siRNA in the lung"),
    Case("source support is introduction/background only", SAFE, location="Background paragraph 1"),
    Case("source support is introduction/background only", OFF, location="Key Summary Points", domain=OT),
    Case("safety-like term is part of disease efficacy/cell-killing readout", "siRNA was toxic and reduced cell viability rescues"),
    Case("safety endpoint is too generic or unsupported", "siRNA safety is needed"),
    Case("no oligonucleotide modality linked to off-target evidence", "we measured mismatch effects", domain=OT),
    Case("source location does not support specific off-target evidence", "we measured siRNA specificity", domain=OT),
    Case("source location is discussion-only generic off-target support", OFF, location="Conclusion", domain=OT),
    Case("methods source location is not an off-target assay result", OFF, location="Materials paragraph 1", domain=OT),
    Case("computational source lacks concrete off-target evidence", "siRNA design against an unintended gene", domain=OT),
    Case("off-target mention is not supported by primary analysis", "siRNA mismatch is known", domain=OT),
)

ANY = "the siTTR-1 siRNA had measured off-target effects by RNA-seq in cells"
CASES_011 = (
    Case("", ANY, grade="B"),
    Case("", "we found off-target effects of the TTR-2-ASO", grade="C"),
    Case("review/background article, not primary off-target evidence", ANY, "A roadmap"),
    Case("review/background article, not primary off-target evidence", ANY, article_type="Review"),
    Case("out-of-scope organism or non-therapeutic oligonucleotide context", ANY + " of zebrafish"),
    Case("non-oligonucleotide editing/silencing modality", "we measured dCas13 off-target cuts"),
    Case("non-therapeutic oligonucleotide method/tool source", ANY, "A scoring system"),
    Case("delivery/PK source without title-level off-target assay", ANY, "Polymeric carriers"),
    Case("source text lacks concrete off-target evidence", None),
    Case("no oligonucleotide modality linked to off-target evidence", "we measured off-target effects"),
    Case("source location does not support specific off-target evidence", "we measured siRNA levels"),
    Case("off-target claim is about non-oligonucleotide therapy", "siRNA and off-target toxicity of an inhibitor were measured"),
    Case("off-target mention is a generic delivery/development obstacle", "siRNA is hampered by off-target effects as measured"),
    Case("abstract does not report an off-target result or assay", "siRNA and off-target effects"),
    Case("off-target mention is not supported by primary analysis", "siRNA shows off-target effects"),
    Case("generic computational method/tool without molecule-specific evidence", "our siRNA off-target analysis shows model output", "A therapeutic database"),
    Case("no explicit molecule, target, or cohort for verified release evidence", "we measured siRNA off-target effects"),
)

CASES_012 = (
    Case("", "we measured TTR-1 off-target effects of the siRNA", location="Fulltext"),
    Case("", "we measured off-target effects of siCD46 duplex"),
    Case("no explicit molecule name in verified source context", "we measured siRNA off-target effects"),
    Case("generic off-target statement without molecule-specific result", "we observed that siRNA can cause seed match effects", location="Fulltext"),
    Case("off-target statement is not supported by primary result text", "siRNA with off-target effects", location="Fulltext"),
    Case("anchor text lacks specific off-target evidence", "the siRNA is long", location="Fulltext"),
    Case("full-text anchor is background/discussion rather than primary evidence", "it was long", location="Discussion paragraph 1"),
    Case("anchor text lacks explicit ASO/siRNA/oligonucleotide context", "it was long"),
    Case("method/tool article, not molecule-specific release evidence", "it was long", "A prediction tool"),
    Case("review/background article, not primary off-target evidence", "it was long", "An overview"),
    Case("out-of-scope organism or non-therapeutic oligonucleotide context", "it was yeast"),
    Case("PMC full-text anchor could not be verified", None),
)
CASES = {"003": CASES_003, "009": CASES_009, "011": CASES_011, "012": CASES_012}
FIELDS = ("text", "title", "location", "source_kind", "domain", "article_type", "scope")


# --- the rows -------------------------------------------------------------------------------------------


def contexts(spark, sf_dir: str, variant: str, named: bool = True) -> DataFrame:
    """Every sentence of documents with the words of case (row_id + position) mod n appended."""
    docs = text_table(spark, sf_dir, "documents", "doc_id")
    titles = evidence_tables(spark, sf_dir)["source_document"].select(F.col("id").alias("doc_id"), F.col("title").alias("_title"))
    cases = CASES[variant]
    table = F.array(*[F.struct(*[F.lit(getattr(c, f)).cast("string").alias(f) for f in FIELDS]) for c in cases])
    rows = mining.sentences(docs, keep=("doc_id",)).join(titles, "doc_id")
    rows = rows.withColumn("_c", F.get(table, (F.pmod(F.col("doc_id") + F.col("position"), F.lit(len(cases)))).cast("int")))
    rows = rows.select(
        F.col("doc_id").alias("row_id"), "position",
        F.coalesce(F.concat("sentence", F.lit(" "), F.col("_c.text")), F.lit("")).alias("text"),
        F.trim(F.concat("_title", F.lit(" "), F.col("_c.title"))).alias("title"),
        F.col("_c.location").alias("location"), F.col("_c.source_kind").alias("source_kind"), F.col("_c.domain").alias("evidence_domain"),
        F.col("_c.article_type").alias("article_type"), F.col("_c.scope").alias("_scope"), (F.col("position") == 1).alias("hash_exact"),
    )
    return prepared(rows, variant, named)


NAMING = {"011": NAMES_011, "012": NAMES_012}


def molecule(variant: str, hints: str | None = None) -> dict[str, Column]:
    """The molecule where the variant reads it, from the text named `_named`."""
    if variant not in NAMING:
        return {}
    modality = F.lit("siRNA") if variant == "011" else modality_012("_named")
    return {"molecule": name_molecule(NAMING[variant], "_named", modality, hints=hints)}


def prepared(rows: DataFrame, variant: str, named: bool = True) -> DataFrame:
    """Add scope and window where the variant reads them, and the molecule, or only the text that names it."""
    if variant == "009":
        rows = rows.withColumn("scope", F.concat_ws(" ", "title", "_scope"))
    elif variant == "011":
        rows = rows.join(rules.scope_text(rows, "row_id"), "row_id", "left").withColumn("scope", F.concat_ws(" ", "title", "first_passages"))
        rows = rows.withColumn("_named", F.concat_ws(" ", "title", "text"))
    elif variant == "012":
        rows = passage_window(rows, "row_id").withColumn("passage", F.col("text"))
        # A row without a passage of its own has no window either.
        rows = rows.withColumn("text", F.when(F.col("passage") == "", "").otherwise(F.col("window_text")))
        rows = rows.withColumn("_named", F.concat_ws(" ", "title", "text"))
    if named:
        rows = rows.withColumns(molecule(variant)).drop("_named")
    return rules.rule_fields(rows.drop("_scope", "first_passages", "window_text"))


# --- the same in SQL ------------------------------------------------------------------------------------


WORD = r"\p{L}\p{N}_"


def quoted(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def pattern_sql(pattern: str) -> str:
    return pattern.replace(LEFT, "(?:^|[^A-Za-z0-9])").replace(RIGHT, "(?:[^A-Za-z0-9]|$)")


def match_sql(field: str, pattern: str) -> str:
    return f"regexp_matches({field}, {quoted('(?i)' + pattern_sql(pattern))})"


def test_sql(t) -> str:
    if isinstance(t, Combined):
        inner = "(" + (" AND " if t.all_of else " OR ").join(test_sql(x) for x in t.tests) + ")"
    else:
        inner = match_sql(t.field, t.pattern)
    return inner if t.present else f"NOT {inner}"


def rule_sql(rule: Reject | Label) -> str:
    parts = [test_sql(t) for t in rule.tests]
    if getattr(rule, "domain", ""):
        parts.insert(0, f"evidence_domain = '{rule.domain}'")
    return " AND ".join(parts)


def contexts_sql(variant: str) -> str:
    cases = CASES[variant]
    values = ", ".join(f"({i}, {', '.join(quoted(getattr(c, f)) for f in FIELDS)})" for i, c in enumerate(cases))
    rows = f"""{SENT}, cs(i, c_text, c_title, c_location, c_kind, c_domain, c_type, c_scope) AS (VALUES {values}),
      raw AS (SELECT s.doc_id AS row_id, position, coalesce(sentence || ' ' || c_text, '') AS text, trim(so.title || ' ' || c_title) AS title, c_location AS location,
        c_kind AS source_kind, c_domain AS evidence_domain, c_type AS article_type, c_scope, (position = 1)::VARCHAR AS hash_exact
        FROM snt s JOIN source_document so ON so.id = s.doc_id JOIN cs ON cs.i = (s.doc_id + position) % {len(cases)} WHERE sentence <> '')"""
    scope, text, molecule = "title || ' ' || text", "text", "''"
    source = "raw"
    if variant == "009":
        scope = "title || ' ' || c_scope"
    elif variant == "011":
        rows += ", firsts AS (SELECT row_id, string_agg(text, ' ' ORDER BY position) AS p FROM raw WHERE position <= 4 GROUP BY row_id)"
        source, scope = "raw LEFT JOIN firsts USING (row_id)", "concat_ws(' ', title, p)"
        molecule = name_sql(NAMES_011, "title || ' ' || text", "'siRNA'")
    elif variant == "012":
        rows += """, win AS (SELECT * EXCLUDE (text), text AS own, CASE WHEN text = '' THEN '' ELSE concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) END AS text
          FROM raw WINDOW w AS (PARTITION BY row_id ORDER BY position))"""
        source, text = "win", r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
        both = "title || ' ' || text"
        modality = rf"CASE WHEN regexp_matches({both}, '(?i)\bASO|antisense oligonucleotide|gapmer|AON\b') THEN 'ASO' WHEN regexp_matches({both}, '(?i)\bshRNA|short hairpin\b') THEN 'shRNA' ELSE 'siRNA' END"
        molecule = name_sql(NAMES_012, both, modality)
    passage = "own" if variant == "012" else "text"
    return f"""{rows}, ctx AS (SELECT row_id, position, title, {text} AS text, {passage} AS passage, title || ' ' || text AS combined, trim(regexp_replace(title || '. ' || text, '\\s+', ' ', 'g')) AS joined,
        {scope} AS scope, location, source_kind, article_type, evidence_domain, hash_exact, {molecule} AS molecule FROM {source})"""


def first_sql(text: str, pattern: str, group: int) -> str:
    r"""First match between Unicode word boundaries: \b is ASCII-only in the check engine."""
    flags = "(?i)" if pattern.startswith("(?i)") else ""
    body = pattern.removeprefix("(?i)").removeprefix(r"\b").removesuffix(r"\b")
    return f"regexp_extract({text}, {quoted(flags + '(?:^|[^' + WORD + '])(' + body + ')(?:[^' + WORD + ']|$)')}, {group + 1})"


def name_sql(naming: Naming, text: str, modality: str) -> str:
    """The name in SQL, tried in the same order."""
    bad = ", ".join(quoted(b.lower()) for b in naming.bad) or "''"

    def tidied(name: str) -> str:
        if not naming.tidy:
            return f"nullif({name}, '')"
        bare = rf"trim(regexp_replace(trim({name}), '(?i)^(?:the|a|an)\s+', ''), ' ;,.:()[]')"
        return f"(SELECT CASE WHEN n <> '' AND NOT regexp_matches(n, {quoted(naming.starts)}) AND NOT regexp_matches(n, {quoted(naming.holds)}) AND lower(n) NOT IN ({bad}) THEN n END FROM (SELECT {bare} AS n))"

    tries = []
    for token in naming.known:
        name = token + ("" if not naming.known_suffix or any(m in token.lower() for m in ("sirna", "aso", "aon", "shrna", "nusinersen")) else naming.known_suffix)
        tries.append(f"CASE WHEN regexp_matches({text}, {quoted('(?i)' + chr(92) + 'b' + token + chr(92) + 'b')}) THEN {quoted(name)} END")
    for p in naming.patterns:
        needs = f" AND regexp_matches(m, {quoted(naming.needs)}) AND lower(m) NOT IN ({bad})" if naming.needs else ""
        refuses = f" AND NOT regexp_matches(m, {quoted(naming.refuses)})" if naming.refuses else ""
        tries.append(f"(SELECT CASE WHEN m <> ''{needs}{refuses} THEN m END FROM (SELECT {tidied(first_sql(text, p, 0))} AS m))")
    if naming.targets:
        first = "coalesce(" + ", ".join(f"nullif({first_sql(text, p, 1)}, '')" for p in naming.targets) + ", NULL)"
        whole = f"{first} || ' ' || {modality}"
        tries.append(tidied(f"({whole})"))
    if naming.unspecified:
        tries.append(f"'unspecified ' || {modality}")
    return "coalesce(" + ", ".join(tries) + ", '')"


def cascade_sql(variant: str) -> str:
    v = VARIANTS[variant]
    reason = "CASE " + " ".join(f"WHEN {rule_sql(r)} THEN {quoted(r.reason)}" for r in v.rejects) + " ELSE '' END"
    grade = "CASE " + " ".join(f"WHEN {rule_sql(g)} THEN '{g.value}'" for g in v.grades) + f" ELSE '{v.default_grade}' END" if v.grades else f"'{v.default_grade}'"
    return f"""WITH {contexts_sql(variant)}, d AS (SELECT *, {reason} AS reason FROM ctx)
      SELECT row_id, position, CASE WHEN reason = '' THEN 'accept' ELSE 'reject' END AS decision, reason, CASE WHEN reason = '' THEN {grade} ELSE '' END AS grade FROM d"""


def score_sql(score: Score) -> str:
    if score.terms:
        hits = [f"(contains(lower({score.field}), {quoted(t.lower())}) AND {match_sql(f'lower({score.field})', rules.words([t.lower()]))})::INT" for t in score.terms]
        value = f"{score.weight} * ({' + '.join(hits)})"
    else:
        hit = match_sql(score.field, score.pattern) + (f" AND NOT {match_sql(score.field, score.unless)}" if score.unless else "")
        value = f"CASE WHEN {hit} THEN {score.weight} ELSE {score.otherwise} END"
    return f"CASE WHEN evidence_domain = '{score.domain}' THEN {value} ELSE 0 END" if score.domain else value


def scores_sql(variant: str, scores: list[Score]) -> str:
    total = " + ".join(f"({score_sql(s)})" for s in scores)
    return f"WITH {contexts_sql(variant)} SELECT row_id, position, evidence_domain, {total} AS score FROM ctx"


# --- the queries ----------------------------------------------------------------------------------------


def decided(rows: DataFrame, variant: str) -> DataFrame:
    """Decisions; where rows come without a molecule, it is named only for those that the other rules leave."""
    v = VARIANTS[variant]
    late = {}
    if "_named" in rows.columns:
        late = {"late": molecule(variant, "_hints"), "hints": partial(name_hints, NAMING[variant]), "hinted": "_named"}
    return rules.decision_cascade(rows, v.rejects, v.grades, v.default_grade, linear=True, **late).select("row_id", "position", "decision", "reason", "grade")


def plain_rows(spark, variant: str) -> DataFrame:
    """One row per case, its words alone, and the outcome it was written for."""
    cases = [(1000 * i, 1, *astuple(c)) for i, c in enumerate(CASES[variant])]
    columns = "row_id long, position int, want string, text string, title string, location string, source_kind string, evidence_domain string, article_type string, _scope string, want_grade string"
    return prepared(spark.createDataFrame(cases, columns).withColumn("text", F.coalesce("text", F.lit(""))), variant)


def _register() -> None:
    for variant in VARIANTS:

        @query(f"decision_cascade_{variant}", cascade_sql(variant))
        def _(spark, sf_dir, variant=variant):
            return decided(contexts(spark, sf_dir, variant, named=False), variant)

    for name, variant, scores in (("a", "003", SCORES_003), ("b", "009", SCORES_009), ("c", "011", SCORES_011)):

        @query(f"context_score_{name}", scores_sql(variant, scores))
        def _(spark, sf_dir, variant=variant, scores=scores):
            return mining.context_score(contexts(spark, sf_dir, variant), scores).select("row_id", "position", "evidence_domain", "score")

    @query("molecule_names_009", f"""WITH {contexts_sql("011")} SELECT row_id, position, {name_sql(NAMES_009, "combined", "'siRNA'")} AS molecule FROM ctx""")
    def _(spark, sf_dir):
        rows = contexts(spark, sf_dir, "011")
        return rows.select("row_id", "position", name_molecule(NAMES_009, "combined", F.lit("siRNA")).alias("molecule"))

    for variant in ("011", "012"):

        @query(f"molecule_names_{variant}", f"WITH {contexts_sql(variant)} SELECT row_id, position, molecule FROM ctx")
        def _(spark, sf_dir, variant=variant):
            return contexts(spark, sf_dir, variant).select("row_id", "position", "molecule")


_register()
