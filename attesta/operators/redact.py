"""Publication: withhold free text, normalize identifiers, scan for leaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.redaction import (
    identifier_value,
    is_audit_note,
    is_free_text,
    json_exposes,
    normalize_key,
    note_metadata,
    redact_json,
)
from attesta.functions.text import STATUS_WORDING, as_col, map_status, normalize_pmcid, strip_name_suffix, text_or_empty


def redact_columns(df: DataFrame) -> DataFrame:
    """Free-text columns become hash and withheld flag, audit notes a metadata record; order is kept.

    Blank values stay blank. Identifier columns and status wording get their published form.
    """
    out: list[Column] = []
    for field in df.schema:
        c, key = field.name, normalize_key(field.name)
        if not is_free_text(c):
            value = identifier_value(c)
            if isinstance(field.dataType, T.StringType):
                value = map_status(value, STATUS_WORDING)
            out.append(value.alias(c))
        elif is_audit_note(c):
            out.append(note_metadata(c).alias(f"{key}_meta"))
        else:
            filled = text_or_empty(c) != ""
            out.append(F.when(filled, F.sha2(as_col(c).cast("string"), 256)).otherwise("").alias(f"{key}_sha256"))
            out.append(filled.alias(f"{key}_withheld"))
    return df.select(*out)


def redact_json_column(df: DataFrame, col: str) -> DataFrame:
    """Apply the redaction rules inside a JSON text column; texts without free text are unchanged."""
    return df.withColumn(col, redact_json(F.col(col)))


def identifier_repair(df: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Repair PMCIDs, names and status words.

    Returns (rows with a `changed` flag, rejected rows): rejected are rows whose PMCID is not blank and
    has no PMC number, and rows whose repaired PMCID another row has as well.
    """
    repaired: dict[str, Column] = {}
    for c in df.columns:
        k = normalize_key(c)
        if k == "pmcid":
            repaired[c] = F.when(text_or_empty(c) == "", F.col(c)).otherwise(normalize_pmcid(c))
        elif k == "canonical_name":
            repaired[c] = strip_name_suffix(c)
        elif k.endswith("_status"):
            repaired[c] = map_status(c)
    changed = reduce(lambda a, b: a | b, [~v.eqNullSafe(F.col(c)) for c, v in repaired.items()], F.lit(False))
    invalid = (text_or_empty("pmcid") != "") & (normalize_pmcid("pmcid") == "") if "pmcid" in df.columns else F.lit(False)
    flagged = df.withColumns({"changed": changed, "_invalid": invalid}).withColumns(repaired)
    if "pmcid" not in df.columns:
        return flagged.drop("_invalid"), flagged.limit(0).select(F.col(key), F.lit("").alias("reason"))
    shared = (
        flagged.filter("NOT _invalid").filter(text_or_empty("pmcid") != "").groupBy("pmcid").agg(F.count("*").alias("_n")).filter("_n > 1")
    )
    collide = flagged.join(shared.select("pmcid"), "pmcid", "left_semi").select(F.col(key), F.lit("duplicate identifier").alias("reason"))
    bad = flagged.filter("_invalid").select(F.col(key), F.lit("invalid identifier").alias("reason"))
    return flagged.drop("_invalid"), bad.unionByName(collide)


def leak_scan(tables: dict[str, DataFrame], forbidden: list[str], nested: bool = True) -> DataFrame:
    """Violations per published table and column: (table_name, column_name, problem, violations).

    One pass per table: all checks are sums of one aggregation, unpivoted afterwards.
    """
    reports = []
    for name, df in tables.items():
        checks: dict[tuple[str, str], Column] = {}
        for field in df.schema:
            if not isinstance(field.dataType, T.StringType):
                continue
            c = field.name
            value = text_or_empty(c)
            if is_free_text(c):
                checks[(c, "free_text_column")] = value != ""
            if normalize_key(c) in ("pmcid", "source_pmcid"):
                checks[(c, "bad_pmcid")] = (value != "") & ~value.rlike(r"^PMC\d+$")
            low = F.lower(value)
            checks[(c, "forbidden_text")] = reduce(
                lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in forbidden], F.lit(False)
            )
            if nested:  # only texts that look like JSON are parsed, whatever the column is called
                checks[(c, "free_text_in_json")] = F.coalesce(json_exposes(F.when(value.rlike(r"^\s*[\[{]"), F.col(c))), F.lit(False))
        if not checks:
            continue
        marked = df.select(*[v.cast("bigint").alias(f"c{i}") for i, v in enumerate(checks.values())])
        sums = marked.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in marked.columns])
        rows = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), F.lit(problem).alias("problem"),
                F.col(f"c{i}").alias("violations"),
            )
            for i, (c, problem) in enumerate(checks)
        ]
        reports.append(sums.select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, reports).filter("violations > 0")
