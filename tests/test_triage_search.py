"""The search for designs: every stage of the query has rows of its own."""

import __spark_entry__ as entry
from tests.checks import compare, duck

SF = "/root/testdata/sf0.001"


def test_designs_without_a_hit_are_searched_by_target(spark):
    df = entry.queries()["sequence_search"](spark, SF)
    assert compare(df, duck(SF), entry.oracle_sql()["sequence_search"])[0] is None
    ways = {r["design_id"].split(" ")[-1] for r in df.where("kind = 'release'").select("design_id").distinct().collect()}
    # "whole" asks for all fields and a seed word: most such designs have rows by their target alone.
    assert ways == {"whole", "chemistry", "target", "modification", "nothing"}  # on larger tables "sequence" too
    sql = entry.oracle_sql()["sequence_search"]
    at = sql.rindex("SELECT * FROM (SELECT design_id, 'release'")
    first, second = (duck(SF).execute(f"{sql[:at]} SELECT count(DISTINCT design_id) FROM h WHERE stage = {n}").fetchone()[0] for n in (1, 2))
    listed = df.where("kind = 'release'").select("design_id").distinct().count()
    assert first < listed <= first + second
