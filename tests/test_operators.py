"""Hand-made rows: blanks, ties, empty input, short sequences, nested JSON, and published result numbers."""

from __future__ import annotations

import hashlib
import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from attesta.functions import sequence, text
from attesta.functions.queries import parse_terms, query_terms
from attesta.functions.redaction import redact_value, sensitive_columns
from attesta.lexicons import OFFTARGET_CLASSES, QUESTION_TERMS, SEARCH_SYNONYMS
from attesta.operators import curation, genes, metrics, mining, redact, rules, search, spelling, stats, triage, windows
from attesta.sources import tables as io
from attesta.sources.schema import TABLES
from attesta.streaming.append import append_stream, document_stream


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "seq", "seed", "bad"),
    [
        ("augc uuN-x1", "ATGCTTN", "", ["-", "X", "1"]),
        ("ACGTACGTACGT", "ACGTACGTACGT", "CGTACGT", []),
        ("", "", "", []),
        (None, "", "", []),
        ("ÄCG", "CG", "", ["Ä"]),
    ],
)
def test_sequence_functions(spark, raw, seq, seed, bad):
    df = spark.createDataFrame([(raw,)], "s string").withColumn("c", sequence.canonical_sequence("s"))
    r = df.select("c", sequence.seed_2_8("c").alias("seed"), sequence.invalid_characters("s").alias("bad")).first()
    assert (r["c"], r["seed"], r["bad"]) == (seq, seed, bad)


def test_kmers_are_first_seen_distinct(spark):
    def brute(s, k=7, m=12):
        seen = []
        for i in range(len(s) - k + 1):
            if s[i : i + k] not in seen:
                seen.append(s[i : i + k])
        return seen[:m]

    rng = random.Random(5)
    values = ["", "ACGTAC", "ACGTACG", "A" * 3000 + "CGT" * 9, "AC" * 400 + "ACGTTGCA" * 3]
    values += ["".join(rng.choice("AC") for _ in range(n)) for n in (8, 40, 900)]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = {r["s"]: r["k"] for r in df.select("s", sequence.kmer_windows("s").alias("k")).collect()}
    assert got == {v: brute(v) for v in values}


def test_helm(spark):
    assert one(spark, sequence.sequence_from_helm("h"), h="RNA1{R(A)P.[mR](c)P.R(U)}$$$$") == "ACU"


def test_text_functions(spark):
    assert one(spark, text.split_terms("a", "b"), a="Liver; KIDNEY|liver", b="x/ Kidney ,GalNAc") == ["Liver", "KIDNEY", "GalNAc"]
    assert one(spark, text.normalize_pmcid("a"), a=" pmc123x") == "PMC123"
    assert one(spark, text.year_from_pubdate("a", "digits"), a="Epub 12-2019/03") == 2019
    assert one(spark, text.year_from_pubdate("a", "blanks"), a="12-2019 Mar") is None
    assert one(spark, text.node_id("n", "a"), a="--é/") == "n:--"
    assert one(spark, text.node_id("n", "a"), a="///") == "n:unknown"
    assert one(spark, text.strip_name_suffix("a"), a="X (V1 extraction artefact, pending source re-verification) ") == "X"
    assert one(spark, text.nonblank("a"), a=" N/A ") is False


def test_query_terms_column_and_driver_agree(spark):
    questions = ["Show off target SEED evidence", "liver hepatic with x", "the of", "", "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10", "Off-Target off target"]
    df = spark.createDataFrame([(q,) for q in questions], "q string")
    got = [r["t"] for r in df.select(query_terms("q").alias("t")).collect()]
    assert got == [parse_terms(q) for q in questions]
    assert got[1] == [SEARCH_SYNONYMS["liver"]]


def test_limit_clamp():
    assert [search.limit_clamp(x) for x in ("abc", "0", "7", "99999", "", 12)] == [250, 1, 7, 1000, 250, 12]


def test_question_plan_toxicity_wins_and_target(spark):
    df = spark.createDataFrame(
        [("1", "Show GalNAc liver toxicity Grade A/B evidence"), ("2", "siRNA seed off-target in TTR grade c"), ("3", "seed safety")],
        "question_id string, question string",
    )
    got = {r["question_id"]: r for r in search.question_plan(df, QUESTION_TERMS).collect()}
    assert (got["1"]["domain"], got["1"]["grades"], got["1"]["target"]) == ("toxicity", ["A", "B"], "")
    assert [g["key"] for g in got["1"]["term_groups"]] == ["galnac", "liver", "lna"]  # "galnac" holds "lna"
    assert (got["2"]["domain"], got["2"]["grades"], got["2"]["modalities"], got["2"]["target"]) == ("offtarget", ["C"], ["siRNA"], "ttr")
    assert got["3"]["domain"] == "toxicity"


def test_offtarget_class_first_match_and_fallback(spark):
    df = spark.createDataFrame([("mismatch in the seed",), ("rnaseq",), ("nothing",)], "t string")
    got = [r["c"] for r in df.select(stats.offtarget_class(F.col("t"), OFFTARGET_CLASSES).alias("c")).collect()]
    assert got == ["seed_mediated", "transcriptome_level", "general_offtarget"]


def test_published_false_accept_rate(spark):
    """66 of 90 machine accepts were rejected on review: 0.73, Wilson interval 0.63 to 0.81."""
    data = [("accept", "reject")] * 66 + [("accept", "accept")] * 23 + [("accept", "uncertain")] + [("reject", "reject")] * 35 + [("reject", "accept")]
    r = metrics.false_accept_rate(spark.createDataFrame(data, "a string, b string"), "a", "b").first()
    assert (r["accepts"], r["false_accepts"]) == (90, 66)
    assert [round(r[c], 4) for c in ("rate", "ci_low", "ci_high")] == [0.7333, 0.6338, 0.8138]


def test_kappa_edges(spark):
    def kappa(data):
        return metrics.cohen_kappa(spark.createDataFrame(data, "a string, b string"), "a", "b").first()["kappa"]

    assert kappa([]) is None
    assert kappa([("accept", "accept")] * 3) is None
    assert kappa([("accept", "accept"), ("reject", "reject")]) == 1.0
    assert kappa([("accept", "reject"), ("reject", "accept")]) == -1.0


def test_baselines_first_seen_tie_and_unseen_group(spark):
    data = [
        ("t", "train", "x", 1, "b", "m1", "A", "g1"), ("t", "train", "x", 2, "a", "m1", "A", None), ("t", "train", "x", 3, "a", "m2", "B", ""),
        ("t", "train", "x", 4, "b", "m2", "B", "g1"), ("t", "test", "x", 5, "b", "m9", "A", "g1"), ("t", "test", "x", 6, "a", "m2", "A", "gz"),
    ]
    df = spark.createDataFrame(
        data, "task_name string, split_name string, entity_table string, entity_id long, category string, modality string, evidence_grade string, target_gene_symbol string"
    )
    got = {r["baseline_model"]: r for r in metrics.baseline_eval(df).collect()}
    assert {r["majority_label"] for r in got.values()} == {"b"}
    assert got["train_majority_class"]["accuracy"] == 0.5
    assert got["modality_prior_class"]["coverage"] == 0.5
    assert got["modality_prior_class"]["accuracy"] == 1.0
    assert got["target_prior_class"]["coverage"] == 0.5
    assert got["train_majority_class"]["macro_f1"] == pytest.approx(1 / 3)


def test_latest_audit_ties(spark):
    df = spark.createDataFrame(
        [(1, "t", 1, "2024-01-01"), (2, "t", 1, "2024-01-01"), (3, "t", 1, None), (4, "t", 2, None)],
        "id long, entity_table string, entity_id long, audited_at string",
    ).withColumns({"validation_status": F.lit("curator_verified"), "curator_decision": F.lit("accept"), "curator_id": F.lit("c")})
    assert sorted(r["id"] for r in windows.latest_accept_audit(df).collect()) == [2, 4]
    mine = windows.latest_status_by_curator(df.withColumn("curator_decision", F.col("id").cast("string")), "c")
    assert sorted(r["curator_decision"] for r in mine.collect()) == ["1", "4"]


def test_ordinal_split_group_counts(spark):
    data = [("one", "g")] * 3 + [("two", "a"), ("two", "b")] + [("three", g) for g in "cabc"]
    got = set(rows(windows.ordinal_group_split(spark.createDataFrame(data, "task_name string, leakage_group string"))))
    assert got == {("one", "g", "train"), ("two", "a", "test"), ("two", "b", "train"), ("three", "a", "test"), ("three", "b", "validation"), ("three", "c", "train")}


@pytest.mark.parametrize("target", [5, 40, 200])
def test_stratified_sample_against_brute_force(spark, target):
    import hashlib

    rng = random.Random(target)
    data = [(f"r{i}", rng.choice("aaaaaaabbc")) for i in range(120)]

    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    groups = {}
    for rid, s in data:
        groups.setdefault(s, []).append(rid)
    chosen = []
    for s in sorted(groups):
        quota = min(len(groups[s]), max(3, round(len(groups[s]) / len(data) * target)))
        chosen += sorted(groups[s], key=lambda r: sha(f"{s}:{r}"))[:quota]
    if len(chosen) < target:
        chosen += [r for r in sorted((r for r, _ in data), key=lambda r: sha(f"fill:{r}")) if r not in chosen][: target - len(chosen)]
    df = spark.createDataFrame(data, "rid string, stratum string")
    got = [r["rid"] for r in windows.stratified_sample(df, "stratum", "rid", target).collect()]
    assert sorted(got) == sorted(chosen[:target])


def test_redaction_of_nested_values():
    note = json.dumps({"source_pmid": "1", "quote": "secret", "inner": {"quote_sha256": "aa"}})
    record = {
        "id": 1, "auditNote": note, "abstract": "text", "quote": "", "list": [{"passage": "p", "keep": 2}], "payload": json.dumps({"a": [{"rawQuote": "q"}]}),
    }
    out = redact_value(record)
    assert "abstract" not in out and out["abstract_withheld"] is True
    assert "quote_sha256" not in out
    assert set(out["audit_note_meta"]) == {"source_pmid", "quote_sha256", "quote_withheld", "note_sha256", "note_withheld"}
    assert out["list"][0]["passage_withheld"] is True and out["list"][0]["keep"] == 2
    assert "rawQuote" not in out["payload"] and "raw_quote_withheld" in out["payload"]


def test_identifiers_inside_nested_json():
    inner = json.dumps({"pmcid": " pmc12;", "canonical_name": "X (v1 extraction artefact, pending source re-verification)", "sequence_status": "needs_curator_sequence_curation", "note": ["[]", "{bad"]})
    out = redact_value({"details": inner, "pmcid": "none", "list": [{"source_pmcid": "PMC3 "}]})
    assert json.loads(out["details"]) == {"pmcid": "PMC12", "canonical_name": "X", "sequence_status": "sequence_not_available", "note": ["[]", "{bad"]}
    assert out["pmcid"] == "" and out["list"] == [{"source_pmcid": "PMC3"}]
    assert redact_value({"quote": {"a": [1, {"abstract": "t"}]}})["quote_sha256"] == hashlib.sha256(json.dumps({"a": [1, {"abstract": "t"}]}).encode()).hexdigest()


def test_redact_columns_and_scan(spark):
    df = spark.createDataFrame([("x", "secret", "n", "pmc7;"), ("y", "", None, "")], "id string, evidence_quote string, reviewerNote string, pmcid string")
    assert sensitive_columns(df.columns) == ["evidence_quote", "reviewerNote"]
    out = redact.redact_columns(df)
    assert out.columns == ["id", "evidence_quote_sha256", "evidence_quote_withheld", "reviewer_note_meta", "pmcid"]
    first, second = rows(out)
    assert first[2] is True and json.loads(first[3])["note_withheld"] is True and first[4] == "PMC7"
    assert second[1:] == ("", False, "", "")
    assert redact.leak_scan({"t": out}, ["secret"]).count() == 0
    assert {r["problem"] for r in redact.leak_scan({"t": df}, ["secret"]).collect()} == {"free_text_column", "forbidden_text", "bad_pmcid"}


def test_identifier_repair_rejects(spark):
    df = spark.createDataFrame([(1, "pmc1 "), (2, "PMC1"), (3, "none"), (4, ""), (5, None)], "id long, pmcid string")
    fixed, rejected = redact.identifier_repair(df)
    assert {r["id"]: r["changed"] for r in fixed.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    assert set(rows(rejected.select("id", "reason"))) == {(1, "duplicate identifier"), (2, "duplicate identifier"), (3, "invalid identifier")}


def test_csv_round_trip(spark, tmp_path):
    path = f"{tmp_path}/modality.csv"
    with open(path, "w", encoding="utf-8") as out:
        out.write('id,name,in_core_scope,scope_note\n1,"a ""b"", c",1,"two\nlines"\n2,x,,\n')
    df = io.load_table(spark, path, TABLES["modality"], multi_line=True)
    assert rows(df.orderBy("id")) == [(1, 'a "b", c', 1, "two\nlines"), (2, "x", None, None)]
    assert df.schema == TABLES["modality"]
    with open(f"{tmp_path}/c.jsonl", "w", encoding="utf-8") as out:
        out.write('{"id": 3, "name": "n"}\n')
    assert rows(io.read_jsonl(spark, f"{tmp_path}/c.jsonl", TABLES["modality"])) == [(3, "n", None, None)]


def test_csv_folder_and_formats(spark, tmp_path):
    made = spark.createDataFrame([(1, 'a "b"', 1, None), (2, "x, y", None, "z")], TABLES["modality"])
    made.write.option("header", True).option("escape", '"').csv(f"{tmp_path}/folder")
    assert rows(io.load_table(spark, f"{tmp_path}/folder", TABLES["modality"], form="csv").orderBy("id")) == rows(made.orderBy("id"))


def test_every_concern_of_a_design_is_ranked(spark):
    states = spark.createDataFrame([(1, f"c{i:03d}", "x", i, 0) for i in range(130)], "design_id long, concern string, evidence_state string, release_records long, candidate_records long")
    ranked = triage.risk_matrix(states)
    assert ranked.count() == 130 and ranked.agg({"position": "max"}).first()[0] == 130


def test_promotion_loses_no_review(spark):
    tables = {
        "curation_candidate": spark.createDataFrame([(i, 7, "pending", "pending") for i in range(1, 7)], "id long, source_document_id long, validation_status string, curator_decision string"),
        "molecule": spark.createDataFrame([(5, "Old", 1, None, None, None, None)], "id long, canonical_name string, modality_id long, target_gene_symbol string, disease_context string, therapeutic_status string, external_ids string"),
        "modality": spark.createDataFrame([(1, "ASO", 1, None)], "id long, name string, in_core_scope long, scope_note string"),
    }
    base = dict(curator_decision="accept", validation_status="curator_verified", evidence_grade="A", audit_note="seen", verified_entity_table="toxicity_endpoint", endpoint_name="n", endpoint_category="c",
                source_location_verified="p. 1", assay_type="", molecule_id="", molecule_canonical_name="", molecule_name="", modality_name="", candidate_modality="", molecule_modality="", target_gene_symbol="",
                target_gene_symbol_verified="", disease_context="", therapeutic_status="", external_ids="")
    made = [
        (1, {"molecule_id": "5"}), (2, {"molecule_id": "999"}), (3, {"molecule_name": "New", "molecule_modality": "ASO", "disease_context": "d", "target_gene_symbol_verified": "TTR", "external_ids": '{"a":1}'}),
        (4, {"molecule_canonical_name": "No modality"}), (88, {"molecule_id": "5"}), (5, {"molecule_id": "x"}),
    ]
    reviews = spark.createDataFrame([{"candidate_id": i, **base, **more} for i, more in made])
    valid, invalid = curation.validate_review(reviews, tables)
    assert valid.columns == reviews.columns and sorted(r["candidate_id"] for r in valid.collect()) == [1, 3]
    assert {r["candidate_id"]: r["errors"] for r in invalid.collect()} == {
        2: ["unknown molecule_id"], 4: ["modality is missing"], 5: ["molecule_id is no number"], 88: ["unknown candidate_id"],
    }
    resolved, modality, molecule = curation.resolved_reviews(tables, reviews)
    ids = {r["candidate_id"]: r["molecule_id"] for r in resolved.collect()}
    new = molecule.filter("id <> 5").collect()
    assert modality.count() == 1 and len(new) == 1 and ids == {1: 5, 3: new[0]["id"]}
    assert (new[0]["canonical_name"], new[0]["target_gene_symbol"], new[0]["disease_context"], new[0]["external_ids"]) == ("New", "TTR", "d", '{"a":1}')


def test_names_and_codes_in_titles(spark):
    titles = {"IONIS-TTRRx in patients": "IONIS-TTRRX", "IONIS TTR": "IONIS-TTR", "Study of ALN-TTR02": "ALN-TTR02", "about Inclisiran": "inclisiran", "AZD8601 dose": "AZD8601", "nothing": None}
    df = spark.createDataFrame([(t,) for t in titles], "title string").select("title", curation.name_from_title().alias("name"))
    assert {r["title"]: r["name"] for r in df.collect()}["nothing"] is None
    assert {r["title"]: r["name"] for r in df.collect()} | {"IONIS-TTRRx in patients": None} == titles | {"IONIS-TTRRx in patients": None}


def test_json_leaks_are_found_in_any_column(spark):
    df = spark.createDataFrame([("1", ' {"a": [{"rawQuote": "q"}]}', "{not json"), ("2", "plain", None)], "id string, details string, other string")
    assert [(r["column_name"], r["problem"], r["violations"]) for r in redact.leak_scan({"t": df}, []).collect()] == [("details", "free_text_in_json", 1)]


def test_exports(spark, tmp_path):
    sources = spark.createDataFrame([(1, "7", "T"), (2, "", "U\nV")], "id long, pmid string, title string").withColumns(
        {c: F.lit("") for c in ("source_type", "journal_or_agency", "publication_year", "reuse_category", "license_status")}
    )
    io.refresh_exports({"source_document": sources}, str(tmp_path), ["source_document"])
    got = spark.read.option("header", True).csv(f"{tmp_path}/source_manifest_csv")
    assert sorted(r["source_key"] for r in got.collect()) == ["pmid_7", "source_2"]


def test_best_location_first_max_and_title(spark):
    docs = spark.createDataFrame(
        [(1, "Plain", "No. A toxic risk. A toxic safety!  Safe"), (2, "toxic risk safety", "toxic"), (3, "none", "nothing"), (4, "toxic", "toxic here.")],
        "source_document_id long, title string, text string",
    )
    got = {r["source_document_id"]: (r["source_location"], r["terms"]) for r in mining.best_location(docs, {"toxicity": ["toxic", "risk", "safety"]}).collect()}
    assert got == {
        1: ("PubMed abstract sentence 2", ["toxic", "risk"]),
        2: ("PubMed title", ["toxic", "risk", "safety"]),
        3: ("source title", []),
        4: ("PubMed abstract sentence 1", ["toxic"]),
    }


def test_term_matching_modes(spark):
    assert one(spark, rules.match_terms("t", ["alt", "off-target"], "substring"), t="Salt off-targets") == ["alt", "off-target"]
    assert one(spark, rules.match_terms("t", ["alt", "off-target"], "word"), t="Salt, off-target. ALT2") == ["off-target"]


def test_grounding_join_against_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "é", "of"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30, 300])))) for i in range(40)]
    quotes = [(i, docs[i][1][rng.randrange(3) : rng.choice([13, 25, 60, 500])].upper().replace(" ", "  ")) for i in range(0, 40, 2)] + [(99, "too short")]

    def norm(s):
        return " ".join(s.split()).lower()

    want = {(q, d) for q, t in quotes for d, p in docs if len(norm(t)) >= 12 and norm(t) in norm(p)}
    got = mining.grounding_join(
        spark.createDataFrame(quotes, "q long, text string"), spark.createDataFrame(docs, "d long, text string"), "q", "d"
    )
    assert sorted(rows(got)) == sorted(want)


def test_grounding_rules(spark):
    data = [(1, "accept", "A short"), (2, "accept", "NONE"), (3, "accept", "the whole  QUOTE"), (4, "reject", "zzz"), (5, "accept", "the whole other")]
    df = spark.createDataFrame(data, "row_id long, decision string, quote string").withColumns({"grade": F.lit("B"), "reason": F.lit("r")})
    passages = spark.createDataFrame([(i, "Here is the whole\nquote.") for i in range(1, 6)], "row_id long, passage string")
    got = {r["row_id"]: (r["decision"], r["grade"]) for r in mining.verify_grounding(df, passages).collect()}
    assert got == {1: ("reject", "NA"), 2: ("reject", "NA"), 3: ("accept", "B"), 4: ("reject", "B"), 5: ("reject", "NA")}


# Published quotes with the decided symbols.
GENE_ROWS = [
    ("devoid of off-target AMPAR interaction and CNS toxicity while preserving the potency against the on-target miR-17.", [], "AMPAR", "explicit"),
    ("The effects on off-target genes were validated by microarray and RT-qPCR analyses.", ["VIM"], "transcriptome-wide", "tx_wide"),
    ("The greatest impact of SNA modification was observed when included at position g7 in si-50, with a relative off-target IC50 increase of ~260-fold over the parent si-47.", ["TTR"], "unspecified", "no_match"),
    ("", [], "unspecified", "no_quote"),
    ("NONE", [], "unspecified", "no_quote"),
    ("ASO targeting MAPT reduced GAS2 and polA2 expression", [], "GAS2;POLA2", "explicit"),
]


def test_gene_symbols(spark):
    df = spark.createDataFrame([(i, q, t) for i, (q, t, _, _) in enumerate(GENE_ROWS)], "i int, quote string, intended array<string>")
    got = {r["i"]: (set(r["offtarget_gene_symbol"].split(";")), r["decision_rule"]) for r in genes.gene_symbol_decide(df).collect()}
    assert got == {i: (set(s.split(";")), rule) for i, (_, _, s, rule) in enumerate(GENE_ROWS)}


def test_gene_vocabularies_are_whole(spark):
    words = genes.GeneLexicon()
    assert (len(set(words.known)), len({*words.noise, *words.prose})) == (75, 393)
    df = spark.createDataFrame([(1, "siF7", None), (2, "AR", None), (3, None, "TGF;TTR"), (4, None, "CRISPR")], "id long, canonical_name string, target_gene_symbol string")
    got = {r["id"]: set(r["t"]) for r in df.select("id", genes.intended_targets().alias("t")).collect()}
    assert got == {1: {"F7", "FVII"}, 2: {"AR"}, 3: {"TTR"}, 4: set()}


def test_wording_that_names_targets(spark):
    cases = {
        "The intended target gene is MAPT here": ["MAPT"], "The intended target is HTT.": ["HTT"], "MAPT is the only differential transcript": ["MAPT"],
        "MAPT are the only differentially changed": ["MAPT"], "off-target HTT silencing was seen": [], "unintended MAPT knockdown": [],
        "HTT knockdown and MAPT fell": ["HTT"], "anti-MAPT and siHTT": ["MAPT"], "against the on-target miR-17 only": ["MIR-17"], "BCL-XL ASO": ["BCL-XL"],
        "effects on HTT, HTT HTT": ["HTT"], "potential off-targets MAPT": [], "MAPT, HTT, MCL-1": [], "": [],
    }
    known = tuple(k for k in genes.GeneLexicon().known if len(k) >= 3)
    assert {"MAPT", "HTT", "MIR-17", "BCL-XL", "MCL-1"} <= set(known)
    df = spark.createDataFrame([(q,) for q in cases], "q string").select("q", genes.targets_by_wording(F.col("q"), known).alias("t"))
    assert {r["q"]: sorted(r["t"]) for r in df.collect()} == {q: sorted(t) for q, t in cases.items()}


def test_names_with_hyphens_and_two_affixes(spark):
    names = [("a", "BCL-XL", ["BCL-XL"]), ("b", "anti-MCL-1", ["MCL-1"]), ("c", "siIGF1R-1", ["IGF1R"]), ("d", "ASO-siHTT", ["HTT"]), ("e", "TNRC6; GW182; AGO2", []), ("f", "siF12", ["F12", "FXII"])]
    df = spark.createDataFrame([(i, n) for i, n, _ in names], "id string, canonical_name string").withColumn("target_gene_symbol", F.lit(None).cast("string"))
    got = {r["id"]: set(r["t"]) for r in df.select("id", genes.intended_targets().alias("t")).collect()}
    known = set(genes.GeneLexicon().known)
    assert got == {i: {x for x in t if x in known or x in ("F12", "FXII")} for i, _, t in names} and got["a"] == {"BCL-XL"} and got["b"] == {"MCL-1"}


def test_intended_targets(spark):
    df = spark.createDataFrame(
        [(1, "TTR; f12", "x"), (2, None, "siIGF1R-1"), (3, "", "TNRC6; GW182; AGO2"), (4, "", "TMEM16a"), (5, "", "ARL4C-targeting ASO")],
        "id int, target_gene_symbol string, canonical_name string",
    )
    got = {r["id"]: set(r["t"]) for r in df.select("id", genes.intended_targets().alias("t")).collect()}
    assert got == {1: {"TTR", "F12", "FXII"}, 2: {"IGF1R"}, 3: set(), 4: {"TMEM16A"}, 5: {"ARL4C"}}


def test_accessions(spark):
    assert one(spark, genes.accession_extract("q"), q="NM_001.2, ENST0001; NM_001.2 and XNM_1") == ["NM_001.2", "ENST0001"]


def test_change_diff_null_safe(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "")], "id long, p string, q string")
    new = spark.createDataFrame([(1, "a", None), (2, None, "x"), (4, "d", None)], "id long, p string, q string")
    got = set(rows(curation.change_diff(old, new, "id", ["p", "q"])))
    assert got == {(2, "p", "b", None), (3, "p", "c", None), (3, "q", "", None), (4, "p", None, "d")}


def test_overlay_and_resume(spark):
    base = spark.createDataFrame([("1", "a; no_machine_full_text_anchor", "old"), ("2", "b", "old")], "candidate_id string, risk_flags string, article_type string")
    ckpt = spark.createDataFrame([("1", "h", "new"), ("2", "", "new")], "candidate_id string, source_anchor_hash string, article_type string")
    out = {r["candidate_id"]: (r["risk_flags"], r["article_type"]) for r in io.overlay_checkpoint(base, ckpt).collect()}
    assert out == {"1": ("a", "new"), "2": ("b", "old")}
    done = spark.createDataFrame([("1", "accept"), ("2", "llm_error")], "candidate_id string, decision string")
    assert rows(io.resume_anti(base, done, "candidate_id").select("candidate_id")) == [("2",)]


def test_evidence_states(spark):
    plans = spark.createDataFrame([("d", c, c, "toxicity") for c in "abcx"], "design_id string, concern_id string, concern string, domain string")
    release = spark.createDataFrame([("d", "a", "B"), ("d", "a", "C"), ("d", "b", "C")], "design_id string, concern_id string, evidence_grade string")
    gaps = spark.createDataFrame([("d", "c"), ("d", "b")], "design_id string, concern_id string")
    got = {r["concern_id"]: triage.STATES.index(r["evidence_state"]) for r in triage.evidence_state(plans, release, gaps).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "x": 3}


def test_spelling_index_equals_plain_search(spark):
    draw = random.Random(7)
    words = ["ab", "a", "abc", "bca", "é", "x-1", "cab c", "b", "", "zz", "abcab", "日本"]
    texts = [(i, *(" ".join(draw.choice(words) for _ in range(draw.randint(0, 4))) for _ in range(2))) for i in range(120)]
    plans = [(f"p{i}", [[draw.choice(words) for _ in range(draw.randint(1, 3))] for _ in range(draw.randint(0, 3))]) for i in range(40)]
    data = spark.createDataFrame(texts + [(500, None, None)], "id long, t string, u string")
    asked = spark.createDataFrame(plans, "p string, groups array<array<string>>")
    index = spelling.spelling_index(data, [F.coalesce(c, F.lit("")) for c in ("t", "u")], spelling.spellings_of(asked, "groups"))
    got = sorted(rows(index.rows_of(asked, "p", "groups", ["id"])))
    want = sorted((p, i) for p, groups in plans for i, t, u in [*texts, (500, "", "")] if all(any(s in t or s in u for s in g) for g in groups))
    assert got == want and 500 in {i for _, i in got}
    many = spark.createDataFrame([(f"q{i}", f"w{i}") for i in range(2500)], "query_id string, q string")
    numbered = spark.createDataFrame([(i, f"x w{i} y") for i in range(2500)], "id long, t string")
    hits = search.synonym_search(numbered, ["t"], many, ["id"])
    assert hits.count() == sum(str(i).startswith(str(j)) for i in range(2500) for j in range(2500) if i // 10 ** max(0, len(str(i)) - len(str(j))) == j)


def test_fingerprints_tell_rows_apart(spark):
    mark = lambda rows, schema="a string, b string": io.table_fingerprint(spark.createDataFrame(rows, schema)).first()
    assert mark([("a|b", "c")]) != mark([("a", "b|c")]) and mark([("a", None)]) != mark([("a", "")]) and mark([("1", "1")]) != mark([("1", 1)], "a string, b int")
    assert mark([("a", "b"), ("c", "d")]) == mark([("c", "d"), ("a", "b")]) != mark([("a", "b")] * 2)
    assert tuple(mark([])) == (0, "0:0")


def test_failed_refresh_leaves_the_published_export(spark, monkeypatch):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    made = {n: spark.createDataFrame([tuple(1 if f.dataType.simpleString() in ("bigint", "int") else 'x "y",\nz' for f in TABLES[n].fields)], TABLES[n]) for n in io.EXPORTED}
    first = io.publish_exports(made, base)
    assert io.current_export(spark, base) == first and rows(io.read_export(spark, first, "curation_queue", "csv")) == rows(made["curation_queue"])
    monkeypatch.setattr(io, "read_export", lambda spark, at, name, form: made[name].limit(0))
    with pytest.raises(ValueError, match="differ"):
        io.publish_exports(made, base)
    assert io.current_export(spark, base) == first


def test_streaming_append_is_incremental(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    docs = spark.createDataFrame([(i, f"Title {i}", "siRNA toxic risk seen. More.") for i in range(6)], "source_document_id long, title string, text string")
    sources = spark.createDataFrame([(i, "journal", str(100 + i), "") for i in range(6)], "id long, source_type string, pmid string, doi string")
    docs.filter("source_document_id < 4").repartition(2).write.parquet(f"{base}/in")
    lexicon = {"toxicity": ["toxic", "risk"], "offtarget": ["seed"]}

    def run():
        stream = document_stream(spark, f"{base}/in", docs.schema)
        append_stream(stream, sources, f"{base}/out", f"{base}/state", lexicon, ["sirna"]).awaitTermination()
        return sorted(r["source_document_id"] for r in spark.read.parquet(f"{base}/out").collect())

    assert run() == [0, 1, 2, 3]
    docs.filter("source_document_id >= 2").write.mode("append").parquet(f"{base}/in")
    assert run() == [0, 1, 2, 3, 4, 5]
