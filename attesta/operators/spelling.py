"""Find many spellings in many texts at once: an inverted list of rare n-grams, then equi joins.

The texts of rows are lists of field values. Distinct values are far fewer than rows, so spellings are looked
up in distinct values: each spelling is filed under the rarest n-gram it holds, each value asks for its own
n-grams, and only pairs that share one are compared. The spellings found in a row's values are its signature;
rows get it by a join for each group of fields that vary together, so neither texts nor values of rows are shuffled.
Whatever is asked of a row's text depends on its signature alone, so plans meet distinct signatures, by an equi join
on a spelling, and rows take part only at the end, by their signature.

A spelling is found if one of the values contains it; the empty spelling is in every text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import let
from attesta.session import store

#: Spellings of at least this length are filed under a piece of this length, shorter ones under themselves.
GRAM = 3
BREAK = "\u0001"
#: Up to this many pieces are searched for in every value, before values list their own.
FEW_GRAMS = 256


def _pieces(letters: Column, length: int) -> Column:
    """All pieces of `length` characters, from an array of letters; linear in its size."""
    out = letters
    for n in range(1, length):
        out = F.zip_with(out, F.slice(letters, n + 1, F.greatest(F.size(letters) - n, F.lit(0))), lambda a, b: F.concat(a, b))
    return F.array_compact(out)


def value_grams(value: Column) -> Column:
    """Distinct pieces of 1 to GRAM characters."""
    return let(F.split(value, ""), lambda c: F.array_distinct(F.concat(*[_pieces(c, n) for n in range(1, GRAM + 1)])))


def spelling_grams(spelling: Column) -> Column:
    """The pieces that any value with the spelling must hold."""
    pieces = let(F.split(spelling, ""), lambda c: F.array_distinct(_pieces(c, GRAM)))
    return F.when(F.length(spelling) > GRAM, pieces).otherwise(F.array(spelling))


def spellings_in_values(values: DataFrame, spellings: DataFrame) -> DataFrame:
    """value and the array of all spellings it contains, for distinct `values` and `spellings`; values without any are left out."""
    asked = spellings.where("spelling <> ''").select("spelling", F.explode_outer(spelling_grams(F.col("spelling"))).alias("gram"))
    wanted = store(asked.select("gram").distinct())
    few = [r["gram"] for r in wanted.limit(FEW_GRAMS + 1).collect()]
    if len(few) <= FEW_GRAMS:
        # Searching a value for a few pieces is cheaper than listing all of its own.
        listed = F.array(*[F.lit(g) for g in few]) if few else F.array().cast("array<string>")
        values = values.where(F.exists(listed, lambda g: F.contains("value", g)))
    # Outer: for an inner explode Spark infers a filter on its input and pushes it below `distinct`, to every row.
    by_gram = store(values).select("value", F.explode_outer(value_grams(F.col("value"))).alias("gram"))
    often = by_gram.join(wanted, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # A spelling with a piece that no value holds is in no value; otherwise its rarest piece stands for it.
    rated = asked.join(often, "gram", "left").groupBy("spelling").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("n"), F.min_by("gram", F.struct("n", "gram")).alias("gram")
    )
    filed = store(rated.where("n > 0").select("spelling", "gram"))
    pairs = by_gram.join(filed, "gram").where(F.contains("value", F.col("spelling")))
    return pairs.groupBy("value").agg(F.collect_set("spelling").alias("spellings"))


def key_source(rows: DataFrame) -> DataFrame:
    """Rows that are read once more, for their distinct combinations."""
    return rows


def signed_rows(rows: DataFrame, values: Sequence[Column | Sequence[Column]], spellings: DataFrame, normal: Callable[[Column], Column] = lambda v: v, among: Sequence[DataFrame | None] = ()) -> DataFrame:
    """`rows` with `found`, those of `spellings` (spelling) that their `values` contain, and `_sig`, the key of `found`.

    Values that vary together, such as those of one dimension, are given as one list: its distinct combinations are looked
    up once and meet the rows by a join on their key. `normal` is applied to the distinct values only. `among` names for each
    list a table with all its combinations, if there is one, such as the dimension itself: then `rows` are not read for them.
    """
    parts = [F.array(*([v] if isinstance(v, Column) else v)) for v in values] if any(not isinstance(v, Column) for v in values) else [F.array(*values)]

    def key(raw: Column) -> Column:
        return F.unhex(F.md5(F.to_json(raw)))

    tables = [*among, *[None] * (len(parts) - len(among))]
    own = [p for p, table in zip(parts, tables, strict=True) if table is None]
    read = [table.select(p.alias("raw")) for p, table in zip(parts, tables, strict=True) if table is not None]
    raw = reduce(DataFrame.unionByName, [*([key_source(rows).select(F.explode(F.array(*own)).alias("raw"))] if own else []), *read]).distinct()
    shown = F.array_distinct(F.filter(F.transform("raw", normal), lambda v: v != ""))
    each = store(raw.select(key(F.col("raw")).alias("_part"), F.explode(shown).alias("value")))
    hits = store(spellings_in_values(each.select("value").distinct(), store(spellings.distinct())))
    held = store(each.join(hits, "value").groupBy("_part").agg(F.array_distinct(F.flatten(F.collect_list("spellings"))).alias("_held")))
    out = rows
    for n, part in enumerate(parts):
        out = out.withColumn("_part", key(part)).join(held.withColumnRenamed("_held", f"_held{n}"), "_part", "left").drop("_part")
    none = F.array().cast("array<string>")
    found = F.concat(F.array(F.lit("")), *[F.coalesce(F.col(f"_held{n}"), none) for n in range(len(parts))])
    return (
        out.withColumn("found", F.array_sort(F.array_distinct(found)))
        .withColumn("_sig", F.md5(F.concat_ws(BREAK, "found")))
        .drop(*[f"_held{n}" for n in range(len(parts))])
    )


class SpellingIndex:
    """rows with `_sig` and `found`, read more than once and so kept by the caller; signatures (_sig, found)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.drop("found")
        self.signatures = store(rows.groupBy("_sig").agg(F.first("found").alias("found")))

    def holding(self, plans: DataFrame, groups: str) -> DataFrame:
        """The columns of `plans` and `_sig` for each signature that has a spelling of each of the plan's groups.

        A plan meets signatures through its rarest group only; the other groups are looked up in the signature.
        """
        numbered = plans.withColumn("_plan", F.md5(F.to_json(F.struct(groups))))
        same = numbered.select("_plan", F.col(groups).alias("_groups")).distinct()
        often = self.signatures.select(F.explode("found").alias("spelling")).groupBy("spelling").agg(F.count(F.lit(1)).alias("n"))
        each = same.select("_plan", F.posexplode(F.concat("_groups", F.array(F.array(F.lit("")))))).select("_plan", F.col("pos").alias("g"), F.explode("col").alias("spelling"))
        sized = each.join(often, "spelling", "left").groupBy("_plan", "g").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.collect_set("spelling").alias("spellings"))
        rarest = sized.groupBy("_plan").agg(F.min_by("spellings", F.struct("n", "g")).alias("spellings")).join(same, "_plan")
        asked = rarest.select("_plan", "_groups", F.col("spellings").alias("_first"), F.explode("spellings").alias("spelling"))
        met = asked.join(self.signatures.select("_sig", "found", F.explode("found").alias("spelling")), "spelling")
        # A signature with several spellings of the group meets the plan several times; the least of them counts.
        once = F.array_min(F.array_intersect("_first", "found")) == F.col("spelling")
        good = met.where(once & F.forall("_groups", lambda g: F.arrays_overlap(g, F.col("found")))).select("_plan", "_sig")
        return numbered.join(good, "_plan").drop("_plan")

    def sharing(self, plans: DataFrame, key: str, spellings: str) -> DataFrame:
        """key, _sig and found for each signature that has at least one of the plan's spellings."""
        asked = plans.select(key, F.explode(F.array_distinct(spellings)).alias("spelling"))
        met = asked.join(self.signatures.select("_sig", F.explode("found").alias("spelling")), "spelling")
        return met.select(key, "_sig").distinct().join(self.signatures, "_sig")

    def rows_of(self, plans: DataFrame, key: str, groups: str, columns: list[str], condition: Column | None = None) -> DataFrame:
        """key and `columns` of the rows that hold a plan's groups and meet `condition` over row and plan; equal plans are matched once."""
        same = [c for c in plans.columns if c != key]
        numbered = plans.withColumn("_asked", F.md5(F.to_json(F.struct(*same))))
        joined = self.rows.join(store(self.holding(numbered.drop(key).distinct(), groups)), "_sig")
        matched = joined if condition is None else joined.where(condition)
        return matched.select("_asked", *columns).join(store(numbered.select(key, "_asked")), "_asked").select(key, *columns)


def spelling_index(rows: DataFrame, values: Sequence[Column | Sequence[Column]], spellings: DataFrame) -> SpellingIndex:
    """Index `rows` by which of `spellings` (spelling) their `values` contain; the rows are kept, so give the columns needed."""
    return SpellingIndex(store(signed_rows(rows, values, spellings)))


def spellings_of(plans: DataFrame, groups: str) -> DataFrame:
    """The spellings of all groups of a table of plans."""
    return plans.select(F.explode(F.flatten(groups)).alias("spelling"))
