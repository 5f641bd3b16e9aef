"""How plans grow: what is shuffled, held and written; and texts of the catalogue as SQL has them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quadweave.functions import resolution as R
from quadweave.functions.resolution import Strategy
from quadweave.operators import entities as E
from quadweave.operators import mapping as M
from quadweave.plans import catalogue
from quadweave.plans.fusion import FusionJob, Policy
from quadweave.schema import QUAD
from quadweave.session import Table

SMALL = "/root/testdata/sf0.001"


def exchanges(df):
    """Exchanges of the plan, each with the columns by which it deals rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("Exchange ", 1)[1] for line in plan.splitlines() if " Exchange " in line and "Reused" not in line]


def test_quality_as_text_is_that_of_sql(spark):
    numbers = [0.0, 1.0, 0.5, 0.307188, 0.000578, 0.001, 0.0001, 0.00005, 0.000012, 0.000003, 0.1234567]
    got = spark.createDataFrame([(x,) for x in numbers], "x double").select(catalogue._six_digits(F.col("x"))).collect()
    assert [r[0] for r in got] == [duckdb.sql(f"select cast(round({x}::double, 6) as varchar)").fetchall()[0][0] for x in numbers]


@pytest.mark.parametrize("name", ["conflict_clusters", "resolve_vote", "resolve_all", "resolve_topn"])
def test_claims_are_shuffled_once_before_they_are_made(spark, name):
    dealt = [x for x in exchanges(catalogue.QUERIES[name](spark, SMALL)) if "(g#" not in x]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]


def test_mappings_are_not_broadcast_for_their_small_files(spark):
    names = spark.range(150_000).select(F.concat(F.lit("a/"), F.col("id").cast("string")).alias("uri"), F.concat(F.lit("b/"), (F.col("id") % 99).cast("string")).alias("canonical"))
    quads = spark.createDataFrame([("a/7", "iri", "p", "a/8", "iri", None, None, "g")], QUAD)
    for rows, held in ((150_000, False), (1000, True)):
        out = M.canonicalise(quads, Table(names.limit(rows)).df)
        joins = [x for x in out._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x and "__uri" in x]
        assert bool(joins) == held
        row = out.select("cs", "co").first()
        assert (row.cs, row.co) == ("b/7", "b/8")


def test_distances_are_taken_once_for_each_value_of_a_group(spark):
    rows = [("e\u0001a", "p", "1", "literal", None, None, "g1", 1.0, "e"), ("e\u0001b", "p", "1", "literal", None, None, "g2", 1.0, "e"), ("e\u0001c", "p", "3", "literal", None, None, "g1", 1.0, "e")]
    statements = spark.createDataFrame(rows, "cs string, cp string, co string, o_kind string, o_dt string, o_lang string, g string, score double, __conflict string")
    got = {r.cs[-1]: round(r.quality, 6) for r in R.values(statements, True).collect()}
    assert got == {"a": round(2 / 3, 6), "b": round(2 / 3, 6), "c": round(1 / 3, 6)}


def test_order_lines_are_shuffled_before_statements_are_made(spark):
    lines = [x for x in exchanges(catalogue.V.orders(spark, SMALL)) if "l_orderkey" in x]
    assert lines and all("REPARTITION_BY_NUM" in x for x in lines)


def test_members_of_a_class_are_looked_for_in_their_range_only(spark):
    out = catalogue.QUERIES["required_class"](spark, SMALL)
    assert '>= order/' in out._jdf.queryExecution().optimizedPlan().toString()
    assert E.within(catalogue._plain(catalogue.V.orders(spark, SMALL)), spark.createDataFrame([], "cs string")).count() == 0


def test_only_entities_within_the_limit_are_resolved_for_output(spark):
    rows = [(f"s{i:03}", "iri", "p", f"{v}", "literal", None, None, "g") for i in range(50) for v in range(2)]
    job = FusionJob(max_output=5)
    out = job.run(spark.createDataFrame(rows, QUAD))
    assert sorted((r.s, r.o) for r in out.collect()) == [("s000", "0"), ("s000", "1"), ("s001", "0"), ("s001", "1")]
    assert not [t for t in job.tables if "result_graph" in t.df.columns]


def test_nested_resources_are_written_once_under_short_names(spark):
    rows = [("s", "iri", "nrd", "n1", "iri", None, None, "g1"), ("n1", "iri", "v", "1", "literal", None, None, "g1"), ("n1", "iri", "v", "1", "literal", None, None, "g1")]
    job = FusionJob(Policy(properties={"nrd": Strategy("DEPENDENT_RESOURCE")}))
    out = job.run(spark.createDataFrame(rows, QUAD)).collect()
    held = [r for t in job.tables if "quality" in t.df.columns for r in t.df.collect()]
    assert [(r.cs, r.cp, r.co, r.quality) for r in held] == [("s\u0002nrd", "v", "1", 0.5)]
    assert len([r for r in out if r.p == "v" and r.s.startswith("urn:quadweave:result:nested:")]) == 1
