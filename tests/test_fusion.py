"""The fusion golden, policies, mapping, filters, parsers and sinks on small inputs."""

import pytest
from pyspark.sql import functions as F

from quadweave import sinks
from quadweave.functions.resolution import IGNORE, MANY, RETURN_ALL, SINGLE, Strategy, function
from quadweave.operators import entities as E
from quadweave.operators import mapping as M
from quadweave.plans.fusion import FusionJob, Policy
from quadweave.schema import QUAD, XSD_DOUBLE
from quadweave.sources import rdf

#: Links, quads and the quality of the golden case.
LINKS = [("sa", "sx"), ("sb", "sa"), ("px", "pa"), ("pb", "pa"), ("ox", "oa"), ("oa", "ob"), ("ob", "ox"), ("ga", "gx"), ("gb", "gx")]


def quad(s, p, o, g, kind="iri"):
    return (s, "bnode" if s.startswith("_:") else "iri", p, o, "bnode" if o.startswith("_:") else kind, None, None, g)


def frame(spark, rows):
    return spark.createDataFrame(rows, QUAD)


def test_fused_average_and_canonical_names(spark):
    rows = [quad("sa", "pa", "oa", "g1"), quad("sb", "pb", "ob", "g1"), quad("sx", "n1", "12.5", "ga", "literal"), quad("sa", "n1", "13.5", "gb", "literal"), quad("sb", "n1", "a", "gb", "literal"), quad("s2", "p2", "o1", "g1"), quad("s2", "p2", "o2", "g2"), quad("_:x1", "p1", "_:x1", "g1")]
    preferred = spark.createDataFrame([("sx",), ("px",), ("ox",), ("gx",)], "uri string")
    policy = Policy(Strategy("ALL", MANY, RETURN_ALL), {"n1": Strategy("AVG", SINGLE, IGNORE)})
    out = FusionJob(policy, spark.createDataFrame(LINKS, "s string, o string"), preferred).run(frame(spark, rows))
    got = {(r.s, r.p, r.o, r.quality, tuple(r.sources)) for r in out.collect()}
    assert got == {
        ("sx", "px", "ox", 0.5, ("g1",)),
        ("sx", "n1", "13.0", 0.32050807744481435, ("ga", "gb")),
        ("s2", "p2", "o1", 0.5, ("g1",)),
        ("s2", "p2", "o2", 0.5, ("g2",)),
        ("_:x1", "p1", "_:x1", 0.5, ("g1",)),
    }
    assert out.where("p = 'n1'").first().o_dt == XSD_DOUBLE


def test_exact_choice_follows_link_order(spark):
    links = spark.createDataFrame([(0, "b", "a"), (1, "c", "b")], "seq int, s string, o string")
    assert {r.uri: r.canonical for r in M.build_mapping_exact(links, "seq").collect()} == {"a": "c", "b": "c", "c": "c"}
    assert {r.uri: r.canonical for r in M.build_mapping_exact(links, "seq", ["a"]).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_conflicts_need_different_graphs(spark):
    rows = [quad("s2", "p2", "o1", "g1"), quad("s2", "p2", "o2", "g2"), quad("s3", "p2", "o2", "g5"), quad("s3", "p2", "o3", "g5")]
    got = {r.cs for r in E.only_conflicts(M.canonicalise(frame(spark, rows), None)).collect()}
    assert got == {"s2"}


def test_dependent_properties_come_from_one_subject(spark):
    rows = [quad("a1", "d1", "x", "good"), quad("a2", "d1", "y", "bad"), quad("a2", "d2", "z", "bad"), quad("a1", "d3", "w", "bad")]
    links = spark.createDataFrame([("a1", "a2")], "s string, o string")
    scores = spark.createDataFrame([("good", 0.9), ("bad", 0.2)], "g string, score double")
    policy = Policy(properties={"d1": Strategy(depends_on="d2"), "d2": Strategy()})
    got = {(r.s, r.p, r.o) for r in FusionJob(policy, links, scores=scores).run(frame(spark, rows)).collect()}
    assert got == {("a1", "d1", "x"), ("a1", "d3", "w")}


def test_nested_resource(spark):
    rows = [quad("s", "nrd", "n1", "g1"), quad("s", "nrd", "n2", "g2"), quad("n1", "v", "1", "g1", "literal"), quad("n2", "v", "1", "g2", "literal"), quad("s", "nrd", "text", "g3", "literal")]
    out = FusionJob(Policy(properties={"nrd": Strategy("DEPENDENT_RESOURCE")})).run(frame(spark, rows)).collect()
    top = [r for r in out if r.p == "nrd" and r.o_kind == "iri"]
    assert len(top) == 1 and top[0].sources == ["g1", "g2"] and top[0].quality == pytest.approx(0.5625)
    assert {(r.p, r.o) for r in out if r.s == top[0].o} == {("v", "1")}
    assert {r.o for r in out if r.p == "nrd" and r.o_kind == "literal"} == {"text"}
    assert {(r.s, r.o) for r in out if r.p == "v"} >= {("n1", "1"), ("n2", "1")}


def test_nested_resources_are_not_filtered(spark):
    rdf_type = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
    rows = [quad("s", rdf_type, "C", "g1"), quad("s", "nrd", "n1", "g1"), quad("n1", "v", "1", "g1", "literal"), quad("t", "nrd", "n1", "g1")]
    out = FusionJob(Policy(properties={"nrd": Strategy("DEPENDENT_RESOURCE")}), required_class="C").run(frame(spark, rows)).collect()
    top = [r for r in out if r.p == "nrd"]
    assert len(top) == 1 and top[0].quality == 0.5 and {(r.p, r.o) for r in out if r.s == top[0].o} == {("v", "1")} and len(out) == 3


def test_nested_as_default(spark):
    rows = [quad("s", "nrd", "n1", "g1"), quad("s", "plain", "n1", "g1"), quad("n1", "v", "1", "g1", "literal")]
    out = FusionJob(Policy(Strategy("DEPENDENT_RESOURCE"), {"plain": Strategy("ALL")})).run(frame(spark, rows)).collect()
    assert {(r.s, r.p, r.o) for r in out if r.o == "n1"} == {("s", "plain", "n1")}
    assert len([r for r in out if r.s == "s" and r.p == "nrd" and r.o.startswith("urn:")]) == 1


def test_nested_member_of_a_group(spark):
    rows = [quad("a1", "nrd", "n1", "good"), quad("a1", "d", "x", "good"), quad("a2", "nrd", "n2", "bad"), quad("n1", "v", "1", "good", "literal"), quad("n2", "v", "2", "bad", "literal")]
    links = spark.createDataFrame([("a1", "a2")], "s string, o string")
    scores = spark.createDataFrame([("good", 0.9), ("bad", 0.2)], "g string, score double")
    policy = Policy(properties={"nrd": Strategy("DEPENDENT_RESOURCE", depends_on="d"), "d": Strategy()})
    out = FusionJob(policy, links, scores=scores).run(frame(spark, rows)).collect()
    top = [r for r in out if r.p == "nrd"]
    assert len(top) == 1 and {r.o for r in out if r.s == top[0].o} == {"1"} and ("a1", "d", "x") in {(r.s, r.p, r.o) for r in out}


def test_other_subjects_conflict(spark):
    rows = [quad("a1", "d1", "10", "good", "literal"), quad("a2", "d1", "20", "bad", "literal"), quad("a1", "d2", "z", "good")]
    links = spark.createDataFrame([("a1", "a2")], "s string, o string")
    scores = spark.createDataFrame([("good", 0.9), ("bad", 0.2)], "g string, score double")
    policy = Policy(properties={"d1": Strategy(cardinality=SINGLE, depends_on="d2"), "d2": Strategy()})
    got = {r.o: r.quality for r in FusionJob(policy, links, scores=scores).run(frame(spark, rows)).collect()}
    assert got["10"] == pytest.approx(0.6)
    average = Policy(properties={"d1": Strategy("AVG", SINGLE, depends_on="d2"), "d2": Strategy()})
    got = {r.o: r.quality for r in FusionJob(average, links, scores=scores).run(frame(spark, rows)).collect()}
    assert got["10.0"] == pytest.approx(0.6)


def test_order_of_rows_does_not_matter(spark):
    rows = [quad("a1", "d1", "v", "g"), quad("a2", "d1", "v", "g"), quad("a2", "d2", "z", "g"), quad("a1", "d2", "y", "g")]
    links = spark.createDataFrame([("a1", "a2")], "s string, o string")
    policy = Policy(properties={"d1": Strategy(depends_on="d2"), "d2": Strategy()})
    run = lambda rows: {(r.s, r.p, r.o) for r in FusionJob(policy, links).run(frame(spark, rows)).collect()}
    assert run(rows) == run(rows[::-1]) == {("a1", "d1", "v"), ("a1", "d2", "y")}


def test_only_mapped_without_links_keeps_nothing(spark):
    assert FusionJob(only_mapped=True).run(frame(spark, [quad("a", "p", "b", "g")])).count() == 0


def test_result_graphs_are_unique_and_stable(spark):
    rows = [quad("a", "p", "b", "g1"), quad("a", "p", "b", "g2"), quad("a", "p", "b", "g3", "literal")]
    run = lambda: sorted(r.result_graph for r in FusionJob(Policy(Strategy("NONE"))).run(frame(spark, rows)).collect())
    assert len(set(run())) == 3 and run() == run()


def test_limit_counts_nested_resources_with_their_parents(spark):
    rows = [quad("s", "nrd", "n1", "g1"), *[quad("n1", f"v{i}", "1", "g1", "literal") for i in range(2)], quad("z", "p", "o", "g1")]
    run = lambda n: {(r.s[:3], r.p) for r in FusionJob(Policy(properties={"nrd": Strategy("DEPENDENT_RESOURCE")}), max_output=n).run(frame(spark, rows)).collect()}
    assert run(3) == {("n1", "v0"), ("n1", "v1")}
    assert run(5) == {("n1", "v0"), ("n1", "v1"), ("s", "nrd"), ("urn", "v0"), ("urn", "v1")}


def test_seeds(spark):
    links = spark.createDataFrame([("a1", "a2")], "s string, o string")
    rows = [quad("a1", "p", "x", "g"), quad("a2", "p", "y", "g"), quad("b", "p", "z", "g")]
    job = FusionJob(links=links, seeds=spark.createDataFrame([("a2",), ("a2",)], "uri string"))
    assert {(r.s, r.o) for r in job.run(frame(spark, rows)).collect()} == {("a1", "x"), ("a1", "y")}
    assert job.tables
    job.release()
    assert not job.tables


def test_pairs_of_many_values_in_blocks(spark, monkeypatch):
    from quadweave.functions import resolution

    rows = [quad("a", "p", str(i), f"g{i % 3}", "literal") for i in range(1, 40)]
    run = lambda: {r.o: round(r.quality, 12) for r in FusionJob(Policy(Strategy(cardinality=SINGLE))).run(frame(spark, rows)).collect()}
    whole = run()
    monkeypatch.setattr(resolution, "BLOCK", 4)
    assert run() == whole and len(whole) == 39


def test_other_functions(spark):
    rows = [quad("a", "p", "x", "g1"), quad("a", "p", "y", "g2"), quad("a", "p", "y", "g3"), quad("a", "t", "b", "g1", "literal"), quad("a", "t", "a", "g2", "literal")]
    run = lambda name, p="p", **params: [r.o for r in FusionJob(Policy(Strategy(name, on_error=IGNORE, params=params))).run(frame(spark, rows)).collect() if r.p == p]
    assert run("TOPN", n="1") == ["y"] and run("CHOOSE_SOURCE", source="g1") == ["x"] and run("CONCAT", "t") == ["a; b"] and run("CONCAT", "t", separator="+") == ["a+b"]
    assert run("RANDOM") == run("RANDOM") and len(run("RANDOM")) == 1 and run("CERTAIN") == []


def test_preferred_names(spark):
    label = "http://www.w3.org/2000/01/rdf-schema#label"
    links = spark.createDataFrame([("http://a/label", label), ("zz", "aa"), ("q", "r")], "s string, o string")
    rows = [quad("s", "http://a/label", "x", "g"), quad("s", "aa", "y", "g"), quad("s", "q", "z", "g")]
    out = FusionJob(Policy(properties={"zz": Strategy("ALL")}), links, spark.createDataFrame([("r",)], "uri string")).run(frame(spark, rows))
    assert {r.p for r in out.collect()} == {label, "zz", "r"}


def test_links_and_uri_lists(spark, tmp_path):
    rows = [quad("a", "http://www.w3.org/2002/07/owl#sameAs", "b", "g"), quad("a", "p", "c", "g"), quad("a", "p", "d", "g", "literal")]
    assert [tuple(r) for r in M.same_as_links(frame(spark, rows)).collect()] == [("a", "b")] and M.same_as_links(frame(spark, rows), None).count() == 2
    (tmp_path / "u.txt").write_text("http://a\n\nhttp://b\n")
    assert rdf.read_uri_list(spark, str(tmp_path / "u.txt")).count() == 3 and rdf.read_uri_list(spark, str(tmp_path / "none")).count() == 0


def test_every_output_gets_every_statement(spark):
    seen = []
    resolved = FusionJob().run(frame(spark, [quad("a", "p", "b", "g")]))
    sinks.write_all(resolved, [lambda d: seen.append(d.count()), lambda d: seen.append(d.count())])
    assert seen == [1, 1]


def test_escapes_and_iris(spark):
    lines = [r'<s\u00e9> <p> "\U0001F600 \uD83D\uDE00 \\n \t\\"@en-GB .', '<s> <p> "a\x01\\\\b" <g> .', "<s> <p> <o>@en .", r'<s> <p> "\uD83Dx" .']
    d = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = rdf.parse_lines(d).collect()
    assert [(r.s, r.o, r.o_lang) for r in rows] == [("sé", "😀 😀 \\n \t\\", "en-GB"), ("s", "a\x01\\b", None), ("s", "\ufffdx", None)]
    assert [r.value for r in rdf.bad_lines(d).collect()] == [lines[2]]


def test_limit_drops_whole_entities(spark):
    rows = [quad(s, "p", f"o{i}", "g") for s, n in (("a", 3), ("b", 2), ("c", 4)) for i in range(n)]
    job = lambda n: {r.s for r in FusionJob(max_output=n).run(frame(spark, rows)).collect()}
    assert job(5) == {"a", "b"} and job(4) == {"a"} and job(2) == set() and job(None) == {"a", "b", "c"}


def test_discovery_never_stops_short(spark):
    quads = frame(spark, [quad(f"n{i}", "p", f"n{i + 1}", "g") for i in range(4)])
    seeds = spark.createDataFrame([("n0",)], "cs string")
    follow = lambda f: quads.join(f.withColumnRenamed("cs", "s"), "s", "left_semi")
    assert E.discover(follow, seeds).count() == 4
    with pytest.raises(RuntimeError):
        E.discover(follow, seeds, max_rounds=2)


def test_lines_round_trip_and_bad_lines(spark):
    text = ['<s> <p> "a\\"b\\n\\u00e9"@en <g> .', "# comment", "", "_:b1 <p> <o> .", "bad line", '<s> <p> "1"^^<http://www.w3.org/2001/XMLSchema#int> . # end']
    lines = spark.createDataFrame([(t,) for t in text], "value string")
    rows = rdf.parse_lines(lines).collect()
    assert [(r.s, r.s_kind, r.o, r.o_kind, r.o_lang, r.g) for r in rows][:2] == [("s", "iri", 'a"b\né', "literal", "en", "g"), ("b1", "bnode", "o", "iri", None, None)]
    assert rows[2].o_dt.endswith("int")
    again = rdf.parse_lines(sinks.nquad_lines(rdf.parse_lines(lines))).collect()
    assert again == rows
    with pytest.raises(Exception, match="not a statement"):
        rdf.parse_lines(lines, mode="FAILFAST").collect()


def test_tuples_and_formats(spark):
    lines = spark.createDataFrame([('<a> _:b "c" <d> .',), ("nonsense",)], "value string")
    assert [[t.value for t in r.terms] for r in rdf.parse_tuples(lines).collect()] == [["a", "b", "c", "d"]]
    assert rdf.Format.parse("N-Quads") is rdf.Format.NQUADS and rdf.Format.parse("x") is None
    assert lines.select(rdf.leading_resource(F.col("value")).alias("x")).collect()[0].x == "a"


def test_unknown_function():
    with pytest.raises(ValueError, match="unknown resolution function"):
        function("NOPE")
