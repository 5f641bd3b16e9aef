"""Query catalogue: every registered query with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadweave import sinks
from quadweave.functions import quality as Q
from quadweave.functions.resolution import GLOBAL_DEFAULT, IGNORE, MANY, SINGLE, REGISTRY, Strategy
from quadweave.operators import entities as E
from quadweave.operators import mapping as M
from quadweave.plans import views as V
from quadweave.plans.fusion import DEPENDENT, FusionJob, Policy, resolve_clusters
from quadweave.sources import rdf

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    return M.canonicalise(df, None)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return Q.source_scores(_plain(V.claims(spark, sf)), V.scores(spark, sf))


def _shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Resolved clusters with sources as text and rounded quality."""
    return df.select("cs", "cp", "co", F.round("quality", digits).alias("quality"), F.array_join("sources", "|").alias("sources"))


def _six_digits(x: Column) -> Column:
    """A quality (0 to 1) at six digits as text, as SQL casts it: no exponent from 0.0001 on, two digits of it below."""
    v = F.round(x, 6)
    plain = F.regexp_replace(F.regexp_replace(v.cast("decimal(20,6)").cast("string"), "0+$", ""), r"\.$", ".0")
    millionths = F.round(v * 1e6).cast("int")
    tens = F.concat(F.regexp_replace((millionths / 10).cast("string"), r"\.0$", ""), F.lit("e-05"))
    return F.when((v == 0) | (v >= 0.0001), plain).when(millionths >= 10, tens).otherwise(F.concat(millionths.cast("string"), F.lit("e-06")))


CLAIMS_SCORED = f"claims AS ({V.CLAIMS}), scores AS ({V.SCORES}), q AS (SELECT claims.*, coalesce(score, 0.5) AS score FROM claims LEFT JOIN scores USING (g))"
#: Values of a cluster with quality as a deciding function sees it, not single-valued.
VALUES = f"""{CLAIMS_SCORED}, v AS (SELECT s AS cs, p AS cp, o AS co, max(score) + (1 - max(score)) * least(1, (sum(score) - max(score)) / 4) AS quality,
string_agg(g, '|' ORDER BY g) AS sources, count(*) AS n, sum(score) AS total, max(score) AS top FROM q GROUP BY s, p, o)"""
_DIST = """CASE WHEN a.co = b.co THEN 0.0 WHEN try_cast(a.co AS DOUBLE) IS NOT NULL AND try_cast(b.co AS DOUBLE) IS NOT NULL THEN
CASE WHEN a.co::DOUBLE = b.co::DOUBLE THEN 0.0 WHEN a.co::DOUBLE + b.co::DOUBLE = 0 THEN 1.0 ELSE least(1.0, abs(a.co::DOUBLE - b.co::DOUBLE) / abs((a.co::DOUBLE + b.co::DOUBLE) / 2)) END
WHEN try_cast(a.co AS DOUBLE) IS NOT NULL OR try_cast(b.co AS DOUBLE) IS NOT NULL THEN 1.0
ELSE levenshtein(a.co, b.co) / greatest(length(a.co), length(b.co), 1)::DOUBLE END"""


@query("fuse_supplier_claims", f"""WITH {VALUES}, x AS (SELECT * FROM q WHERE p <> 'returnflag'),
m AS (SELECT s AS cs, p AS cp, avg(o::DOUBLE) AS co, avg(score) AS sc, string_agg(DISTINCT g, '|' ORDER BY g) AS sources FROM x GROUP BY s, p),
d AS (SELECT cs, cp, avg(CASE WHEN co = o::DOUBLE THEN 0.0 WHEN co + o::DOUBLE = 0 THEN 1.0 ELSE least(1.0, abs(co - o::DOUBLE) / abs((co + o::DOUBLE) / 2)) END) AS far FROM m JOIN x ON x.s = cs AND x.p = cp GROUP BY cs, cp)
SELECT cs AS s, cp AS p, round(quality, 6) AS quality, sources, NULL::DOUBLE AS number, co AS flag FROM v WHERE cp = 'returnflag'
UNION ALL SELECT m.cs, m.cp, round(sc * (1 - far), 6), sources, round(co + 1e-9, 6), NULL FROM m JOIN d USING (cs, cp)""")  # fmt: skip
def fuse_supplier_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The whole plan: averages for numbers, all values for flags."""
    average = Strategy("AVG", SINGLE, IGNORE)
    job = FusionJob(Policy(properties={"discount": average, "tax": average}), scores=V.scores(spark, sf))
    out = job.run(V.claims(spark, sf))
    number = F.col("p") != "returnflag"
    return out.select("s", "p", F.round("quality", 6).alias("quality"), F.array_join("sources", "|").alias("sources"), F.when(number, F.round(F.col("o").try_cast("double") + 1e-9, 6)).alias("number"), F.when(~number, F.col("o")).alias("flag"))


@query("scan_default_graph", f"SELECT s, p, o, CASE WHEN g LIKE '%7' THEN 'urn:default' ELSE g END AS g FROM ({V.CLAIMS})")
def scan_default_graph(spark, sf):
    """Missing graphs filled with the source's default."""
    q = V.claims(spark, sf).withColumn("g", F.when(~F.col("g").endswith("7"), F.col("g")))
    return E.fill_graph(q, "urn:default").select("s", "p", "o", "g")


@query("union_sources", f"SELECT s, p, o, g FROM ({V.CLAIMS}) UNION ALL SELECT s, p, o, g FROM ({V.CUSTOMERS})")
def union_sources(spark, sf):
    return E.union_sources(V.claims(spark, sf), V.customers(spark, sf)).select("s", "p", "o", "g")


@query("graph_restriction", f"SELECT s, p, o, g FROM ({V.CLAIMS}) WHERE g IN ('supplier/1', 'supplier/5')")
def graph_restriction(spark, sf):
    return E.restrict_graphs(V.claims(spark, sf), "g in ('supplier/1', 'supplier/5')").select("s", "p", "o", "g")


@query("parse_nquads", f"SELECT s, p, o, g FROM ({V.CLAIMS})")
def parse_nquads(spark, sf):
    """Written as N-Quads lines and parsed again."""
    lines = sinks.nquad_lines(V.claims(spark, sf))
    return rdf.parse_lines(lines).select("s", "p", "o", "g")


@query("sameas_components", f"SELECT uri, canonical FROM ({V.COPY_MAPPING})")
def sameas_components(spark, sf):
    return M.build_mapping(V.copy_links(spark, sf))


@query("sameas_chain_components", f"SELECT uri, canonical FROM ({V.CUSTOMER_MAPPING})")
def sameas_chain_components(spark, sf):
    return M.build_mapping(V.customer_links(spark, sf))


@query("preferred_canonical", f"""WITH m AS ({V.CUSTOMER_MAPPING})
SELECT uri, arg_min(uri, (CASE WHEN uri LIKE '%7' THEN 0 ELSE 1 END, uri)) OVER (PARTITION BY canonical) AS canonical FROM m""")
def preferred_canonical(spark, sf):
    links = V.customer_links(spark, sf)
    liked = links.select(F.explode(F.array("s", "o")).alias("uri")).where("uri like '%7'").distinct()
    return M.build_mapping(links, liked)


@query("alternatives", f"SELECT canonical, count(*) AS n, canonical || coalesce('|' || string_agg(uri, '|' ORDER BY uri) FILTER (WHERE uri <> canonical), '') AS uris FROM ({V.CUSTOMER_MAPPING}) GROUP BY canonical")
def alternatives(spark, sf):
    return M.alternatives(M.build_mapping(V.customer_links(spark, sf))).select("canonical", "n", F.array_join("uris", "|").alias("uris"))


@query("canonicalise_quads", f"SELECT s, p, o, g, coalesce(canonical, s) AS cs FROM ({V.COPIES}) LEFT JOIN ({V.COPY_MAPPING}) ON uri = s")
def canonicalise_quads(spark, sf):
    return M.canonicalise(V.copies(spark, sf), M.build_mapping(V.copy_links(spark, sf))).select("s", "p", "o", "g", "cs")


@query("dedupe_quads", f"SELECT DISTINCT coalesce(canonical, s) AS cs, p AS cp, o AS co, g FROM ({V.COPIES}) LEFT JOIN ({V.COPY_MAPPING}) ON uri = s")
def dedupe_quads(spark, sf):
    return E.dedupe(M.canonicalise(V.copies(spark, sf), M.build_mapping(V.copy_links(spark, sf)))).select("cs", "cp", "co", "g")


@query("conflict_clusters", f"SELECT s AS cs, p AS cp, count(*) AS n_statements, count(DISTINCT o) AS n_values, count(DISTINCT g) AS n_graphs FROM ({V.CLAIMS}) GROUP BY s, p")
def conflict_clusters(spark, sf):
    return E.clusters(_plain(V.claims(spark, sf)))


#: Statements about documents under the names of the first document with the same text.
MERGED = f"""m AS MATERIALIZED ({V.COPY_MAPPING}), c AS MATERIALIZED (SELECT DISTINCT coalesce(canonical, s) AS s, p, o, g FROM ({V.COPIES}) LEFT JOIN m ON uri = s)"""


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return E.dedupe(M.canonicalise(V.copies(spark, sf), M.build_mapping(V.copy_links(spark, sf))))


@query("only_conflicts", f"""WITH {MERGED}, v AS (SELECT s, p, o, string_agg(DISTINCT g, '|' ORDER BY g) AS gs FROM c GROUP BY s, p, o)
SELECT s, p, o, g FROM c WHERE (s, p) IN (SELECT (s, p) FROM v GROUP BY s, p HAVING count(DISTINCT gs) > 1)""")
def only_conflicts(spark, sf):
    """Statements of clusters in which sources differ; most clusters have none."""
    return E.only_conflicts(_merged(spark, sf)).select(F.col("cs").alias("s"), F.col("cp").alias("p"), F.col("co").alias("o"), "g")


@query("only_mapped", f"SELECT s, p, o, g FROM ({V.COPIES}) WHERE s IN (SELECT uri FROM ({V.COPY_MAPPING}))")
def only_mapped(spark, sf):
    m = M.build_mapping(V.copy_links(spark, sf))
    return E.only_mapped(M.canonicalise(V.copies(spark, sf), m), m).select("s", "p", "o", "g")


@query("required_class", f"WITH o AS MATERIALIZED ({V.ORDERS}), k AS (SELECT DISTINCT s FROM o WHERE p = 'type' AND o = 'class/1-URGENT') SELECT s, p, o, g FROM o SEMI JOIN k USING (s)")
def required_class(spark, sf):
    return E.required_class(_plain(V.orders(spark, sf)), "class/1-URGENT", "type").select("s", "p", "o", "g")


@query("source_quality", f"WITH {CLAIMS_SCORED} SELECT s, p, o, g, round(score, 6) AS score FROM q")
def source_quality(spark, sf):
    return _scored(spark, sf).select("s", "p", "o", "g", F.round("score", 6).alias("score"))


@query("strategy_policy", f"SELECT p, CASE p WHEN 'discount' THEN 'AVG' WHEN 'tax' THEN 'BEST' ELSE 'ALL' END AS fn, CASE p WHEN 'discount' THEN 'SINGLEVALUED' ELSE 'MANYVALUED' END AS cardinality, count(*) AS n FROM ({V.CLAIMS}) GROUP BY 1, 2, 3")
def strategy_policy(spark, sf):
    policy = Policy(properties={"discount": Strategy("AVG", SINGLE), "tax": Strategy("BEST")}).effective()
    rows = [(p, s.function, s.cardinality) for p, s in policy.properties.items()]
    known = F.broadcast(spark.createDataFrame(rows, "p string, fn string, cardinality string"))  # one row per configured property
    default = policy.default
    out = V.claims(spark, sf).groupBy("p").agg(F.count("*").alias("n")).join(known, "p", "left")
    return out.select("p", F.coalesce("fn", F.lit(default.function)).alias("fn"), F.coalesce("cardinality", F.lit(default.cardinality)).alias("cardinality"), "n")


def _resolve(name: str, strategy: Strategy):
    return lambda spark, sf: _shown(resolve_clusters(_scored(spark, sf), Policy(strategy).effective()))


_BEST = "SELECT cs, cp, co, round(quality, 6) AS quality, sources FROM (SELECT *, row_number() OVER (PARTITION BY cs, cp ORDER BY {order}, co) AS rn FROM v{where}) WHERE rn = 1"

QUERIES["resolve_none"] = _resolve("NONE", Strategy("NONE"))
ORACLES["resolve_none"] = f"WITH {CLAIMS_SCORED} SELECT s AS cs, p AS cp, o AS co, round(score, 6) AS quality, g AS sources FROM q"
QUERIES["resolve_all"] = _resolve("ALL", Strategy("ALL"))
ORACLES["resolve_all"] = f"WITH {VALUES} SELECT cs, cp, co, round(quality, 6) AS quality, sources FROM v"
for _name, _order, _where in (
    ("best", "round(quality, 12) DESC", ""),
    ("vote", "n DESC", ""),
    ("weighted_vote", "round(total, 12) DESC", ""),
    ("best_source", "top DESC", ""),
    ("shortest", "length(co)", ""),
    ("longest", "length(co) DESC", ""),
    ("any", "1", ""),
    ("min", "try_cast(co AS DOUBLE)", " WHERE try_cast(co AS DOUBLE) IS NOT NULL"),
    ("max", "try_cast(co AS DOUBLE) DESC", " WHERE try_cast(co AS DOUBLE) IS NOT NULL"),
):
    QUERIES[f"resolve_{_name}"] = _resolve(_name.upper(), Strategy(_name.upper(), MANY, IGNORE))
    ORACLES[f"resolve_{_name}"] = f"WITH {VALUES} " + _BEST.format(order=_order, where=_where)


@query("resolve_certain", f"""WITH {MERGED}, v AS (SELECT s, p, o, 0.5 + 0.5 * least(1, (count(*) - 1) * 0.5 / 4) AS quality, string_agg(g, '|' ORDER BY g) AS sources FROM c GROUP BY s, p, o)
SELECT s AS cs, p AS cp, o AS co, round(quality, 6) AS quality, sources FROM v WHERE (s, p) IN (SELECT (s, p) FROM v GROUP BY s, p HAVING count(*) = 1)""")
def resolve_certain(spark, sf):
    """Values of clusters that have only one."""
    return _shown(resolve_clusters(Q.source_scores(_merged(spark, sf), None), Policy(Strategy("CERTAIN")).effective()))


QUERIES["resolve_threshold"] = _resolve("THRESHOLD", Strategy("THRESHOLD", params={"threshold": "0.7"}))
ORACLES["resolve_threshold"] = f"WITH {VALUES} SELECT cs, cp, co, round(quality, 6) AS quality, sources FROM v WHERE quality >= 0.7"
QUERIES["resolve_filter"] = _resolve("FILTER", Strategy("FILTER", params={"min": "0.03", "max": "0.05"}))
QUERIES["resolve_topn"] = _resolve("TOPN", Strategy("TOPN", params={"n": "2"}))
ORACLES["resolve_topn"] = f"WITH {VALUES} SELECT cs, cp, co, round(quality, 6) AS quality, sources FROM (SELECT *, row_number() OVER (PARTITION BY cs, cp ORDER BY quality DESC, co) AS rn FROM v) WHERE rn <= 2"
QUERIES["resolve_choose_source"] = _resolve("CHOOSE_SOURCE", Strategy("CHOOSE_SOURCE", params={"source": "supplier/1"}))
ORACLES["resolve_choose_source"] = f"WITH {VALUES} SELECT cs, cp, co, round(quality, 6) AS quality, sources FROM v WHERE list_contains(string_split(sources, '|'), 'supplier/1')"
ORACLES["resolve_filter"] = f"WITH {VALUES} SELECT cs, cp, co, round(quality, 6) AS quality, sources FROM v WHERE try_cast(co AS DOUBLE) BETWEEN 0.03 AND 0.05"
QUERIES["fquality_singlevalued"] = _resolve("ALL", Strategy("ALL", SINGLE))
ORACLES["fquality_singlevalued"] = f"""WITH {VALUES}, f AS (SELECT a.cs, a.cp, a.co, sum(b.n * {_DIST}) / sum(b.n) AS far FROM v a JOIN v b ON a.cs = b.cs AND a.cp = b.cp GROUP BY 1, 2, 3)
SELECT cs, cp, co, round(top * (1 - far) + (1 - top * (1 - far)) * least(1, (total - top) / 4), 6) AS quality, sources FROM v JOIN f USING (cs, cp, co)"""


def _numbers(name: str):
    def run(spark, sf):
        out = resolve_clusters(_scored(spark, sf), Policy(Strategy(name, MANY, IGNORE)).effective())
        return out.select("cs", "cp", F.round(F.col("co").cast("double") + 1e-9, 6).alias("number"), F.round("quality", 6).alias("quality"), F.array_join("sources", "|").alias("sources"))

    return run


for _name, _agg in (("avg", "avg(o::DOUBLE)"), ("sum", "sum(o::DOUBLE)"), ("median", "median(o::DOUBLE)")):
    QUERIES[f"resolve_{_name}"] = _numbers(_name.upper())
    ORACLES[f"resolve_{_name}"] = f"WITH {CLAIMS_SCORED} SELECT s AS cs, p AS cp, round({_agg} + 1e-9, 6) AS number, round(avg(score), 6) AS quality, string_agg(DISTINCT g, '|' ORDER BY g) AS sources FROM q WHERE p <> 'returnflag' GROUP BY s, p"


@query("depends_on_best_subject", f"""WITH q AS (SELECT DISTINCT coalesce(canonical, s) AS e, s, p, o, g FROM ({V.CUSTOMERS}) LEFT JOIN ({V.CUSTOMER_MAPPING}) ON uri = s WHERE NOT (p = 'name' AND s LIKE '%3')),
k AS (SELECT e, s, sum(0.1 + 0.2 * (right(g, 1)::INT)) / 2 AS score FROM q GROUP BY e, s),
b AS (SELECT e, s FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(score, 9) DESC, s) AS rn FROM k) WHERE rn = 1)
SELECT q.e AS s, p, o, round(0.1 + 0.2 * (right(g, 1)::INT), 6) AS quality FROM q JOIN b ON b.e = q.e AND b.s = q.s""")  # fmt: skip
def depends_on_best_subject(spark, sf):
    """Balance and name from the one customer of a component whose values are best; some lack a name."""
    q = V.customers(spark, sf).where("not (p = 'name' and s like '%3')")
    scores = spark.createDataFrame([(f"src/{i}", round(0.1 + 0.2 * i, 1)) for i in range(5)], "g string, score double")
    policy = Policy(properties={"acctbal": Strategy(depends_on="name"), "name": Strategy()})
    out = FusionJob(policy, links=V.customer_links(spark, sf), scores=scores).run(q)
    return out.select("s", "p", "o", F.round("quality", 6).alias("quality"))


@query("attribute_index_join", f"WITH o AS ({V.ORDERS}) SELECT a.s AS entity, b.s, b.p, b.o, b.g FROM (SELECT DISTINCT s, o FROM o WHERE p = 'hasLine') a JOIN o b ON b.s = a.o")
def attribute_index_join(spark, sf):
    q = _plain(V.orders(spark, sf))
    return E.merge_index(q, E.attribute_index(q, ["hasLine"])).select("entity", "s", "p", "o", "g")


@query("describe_entities", f"WITH o AS ({V.ORDERS}) SELECT s AS entity, s, p, o, g FROM o UNION ALL SELECT a.s, b.s, b.p, b.o, b.g FROM (SELECT DISTINCT s, o FROM o WHERE p = 'hasLine') a JOIN o b ON b.s = a.o")
def describe_entities(spark, sf):
    return E.describe(_plain(V.orders(spark, sf)), ["hasLine"]).select("entity", "s", "p", "o", "g")


@query("nested_dependent_resource", f"""WITH o AS ({V.ORDERS}), l AS (SELECT DISTINCT s AS parent, o AS line FROM o WHERE p = 'hasLine'),
i AS (SELECT DISTINCT parent, p, o, g FROM l JOIN o ON o.s = line),
v AS (SELECT parent, p, o, 0.5 + 0.5 * least(1, (count(*) - 1) * 0.5 / 4) AS quality FROM i GROUP BY 1, 2, 3),
s AS (SELECT parent, string_agg(DISTINCT g, '|' ORDER BY g) AS sources FROM i GROUP BY parent)
SELECT parent AS s, round(avg(quality), 6) AS quality, any_value(sources) AS sources, count(*) AS n_values FROM v JOIN s USING (parent) GROUP BY parent""")
def nested_dependent_resource(spark, sf):
    """Each order's lines resolved as one nested resource; its content is counted back."""
    q = V.orders(spark, sf)
    out = FusionJob(Policy(properties={"hasLine": Strategy(DEPENDENT)})).run(q)
    top = out.where("p = 'hasLine' and o like 'urn:quadweave:result:nested:%'").select("s", "o", F.round("quality", 6).alias("quality"), F.array_join("sources", "|").alias("sources"))
    inner = out.where("s like 'urn:quadweave:result:nested:%'").groupBy(F.col("s").alias("o")).agg(F.count("*").alias("n_values"))
    return top.join(inner, "o").select("s", "quality", "sources", "n_values")


_NESTED = f"""o AS MATERIALIZED ({V.ORDERS}), l AS (SELECT DISTINCT s AS parent, o AS line FROM o WHERE p = 'hasLine'),
i AS (SELECT DISTINCT parent, p, o, g FROM l JOIN o ON o.s = line),
v AS MATERIALIZED (SELECT parent, p, o, 0.5 + 0.5 * least(1, (count(*) - 1) * 0.5 / 4) AS quality FROM i GROUP BY 1, 2, 3),
src AS (SELECT parent, string_agg(DISTINCT g, '|' ORDER BY g) AS sources FROM i GROUP BY parent),
n AS (SELECT parent AS s, round(avg(quality), 6) AS quality, any_value(sources) AS sources, count(*) AS n_values FROM v JOIN src USING (parent) GROUP BY parent)"""


def _nested_shown(out: DataFrame) -> DataFrame:
    nested = "urn:quadweave:result:nested:%"
    top = out.where(f"p = 'hasLine' and o like '{nested}'").select("s", "o", F.round("quality", 6).alias("quality"), F.array_join("sources", "|").alias("sources"))
    return top.join(out.where(f"s like '{nested}'").groupBy(F.col("s").alias("o")).agg(F.count("*").alias("n_values")), "o").select("s", "quality", "sources", "n_values")


def _typed_orders(spark: SparkSession, sf: str) -> DataFrame:
    return V.orders(spark, sf).withColumn("p", F.when(F.col("p") == "type", E.RDF_TYPE).otherwise(F.col("p")))


@query("nested_with_required_class", f"WITH {_NESTED} SELECT n.* FROM n SEMI JOIN (SELECT s FROM o WHERE p = 'type' AND o = 'class/1-URGENT') USING (s)")
def nested_with_required_class(spark, sf):
    """Only entities of a class are resolved, but their nested resources, of no class, keep what they hold."""
    job = FusionJob(Policy(properties={"hasLine": Strategy(DEPENDENT)}), required_class="class/1-URGENT")
    return _nested_shown(job.run(_typed_orders(spark, sf)))


@query("nested_in_group", f"WITH {_NESTED}, t AS (SELECT DISTINCT s, o AS type FROM o WHERE p = 'type') SELECT n.*, type FROM n LEFT JOIN t USING (s)")
def nested_in_group(spark, sf):
    """A nested property that depends on another."""
    policy = Policy(properties={"hasLine": Strategy(DEPENDENT, depends_on="type"), "type": Strategy()})
    out = FusionJob(policy).run(V.orders(spark, sf))
    return _nested_shown(out).join(out.where("p = 'type'").select("s", F.col("o").alias("type")), "s", "left")


@query("depends_on_conflicts", f"""WITH q AS MATERIALIZED (SELECT DISTINCT coalesce(canonical, s) AS e, s, p, o, g, 0.1 + 0.2 * (right(g, 1)::INT) AS score FROM ({V.CUSTOMERS}) LEFT JOIN ({V.CUSTOMER_MAPPING}) ON uri = s),
far AS (SELECT a.e, a.s, a.p, avg(CASE WHEN a.o::DOUBLE = b.o::DOUBLE THEN 0.0 WHEN a.o::DOUBLE + b.o::DOUBLE = 0 THEN 1.0
        ELSE least(1.0, abs(a.o::DOUBLE - b.o::DOUBLE) / abs((a.o::DOUBLE + b.o::DOUBLE) / 2)) END) AS far FROM q a JOIN q b ON a.e = b.e AND a.p = b.p WHERE a.p = 'acctbal' GROUP BY 1, 2, 3),
r AS (SELECT q.*, score * (1 - coalesce(far, 0)) AS quality FROM q LEFT JOIN far USING (e, s, p)),
k AS (SELECT e, s, sum(quality) / 2 AS score FROM r GROUP BY e, s),
b AS (SELECT e, s FROM (SELECT *, row_number() OVER (PARTITION BY e ORDER BY round(score, 9) DESC, s) AS rn FROM k) WHERE rn = 1)
SELECT r.e AS s, p, o, round(quality, 6) AS quality FROM r JOIN b ON b.e = r.e AND b.s = r.s""")  # fmt: skip
def depends_on_conflicts(spark, sf):
    """Values of one subject, with the values of the entity's other subjects as conflicts."""
    scores = spark.createDataFrame([(f"src/{i}", round(0.1 + 0.2 * i, 1)) for i in range(5)], "g string, score double")
    policy = Policy(properties={"acctbal": Strategy(cardinality=SINGLE, depends_on="name"), "name": Strategy()})
    out = FusionJob(policy, links=V.customer_links(spark, sf), scores=scores).run(V.customers(spark, sf))
    return out.select("s", "p", "o", F.round("quality", 6).alias("quality"))


@query("result_graphs", f"SELECT count(*) AS n, count(*) AS graphs FROM ({V.CLAIMS})")
def result_graphs(spark, sf):
    """Every fused statement has a graph of its own, also those of equal values."""
    out = FusionJob(Policy(Strategy("NONE"))).run(V.claims(spark, sf))
    return out.agg(F.count("*").alias("n"), F.countDistinct("result_graph").alias("graphs"))


@query("seeds_with_limit", f"""WITH {_NESTED}, c AS (SELECT s, 1 AS n FROM o WHERE p = 'type' AND o = 'class/2-HIGH' UNION ALL SELECT s, n_values + 1 FROM n),
e AS (SELECT s, sum(n) AS n FROM c WHERE s IN (SELECT s FROM o WHERE p = 'type' AND o = 'class/2-HIGH') GROUP BY s),
r AS (SELECT s, n, sum(n) OVER (ORDER BY s) AS total FROM e) SELECT s, n::BIGINT AS n FROM r WHERE total <= 3000""")
def seeds_with_limit(spark, sf):
    """Seed entities alone, whole ones up to a number of statements; nested resources count with their parents."""
    q = V.orders(spark, sf)
    seeds = E.seed_subjects(q, seed_predicate="p = 'type' and o = 'class/2-HIGH'")
    out = FusionJob(Policy(properties={"hasLine": Strategy(DEPENDENT)}), seeds=seeds, max_output=3000).run(q)
    top = out.where("s not like 'urn:%'").select("s", F.when(F.col("o").startswith("urn:"), F.col("o")).alias("inner"))
    inner = out.where("s like 'urn:%'").groupBy(F.col("s").alias("inner")).agg(F.count("*").alias("k"))
    return top.join(inner, "inner", "left").groupBy("s").agg((F.count("*") + F.coalesce(F.sum("k"), F.lit(0))).alias("n"))


@query("max_output_triples", f"""WITH {VALUES}, c AS (SELECT cs, count(*) AS n FROM v GROUP BY cs), r AS (SELECT cs, sum(n) OVER (ORDER BY cs) AS total FROM c)
SELECT cs AS s, cp AS p, co AS o FROM v WHERE cs IN (SELECT cs FROM r WHERE total <= 5000)""")
def max_output_triples(spark, sf):
    return FusionJob(scores=V.scores(spark, sf), max_output=5000).run(V.claims(spark, sf)).select("s", "p", "o")


@query("seed_subjects", f"SELECT DISTINCT s FROM ({V.ORDERS}) WHERE p = 'type' AND o = 'class/2-HIGH'")
def seed_subjects(spark, sf):
    return E.seed_subjects(V.orders(spark, sf), seed_predicate="p = 'type' and o = 'class/2-HIGH'")


@query("transitive_discovery", f"""WITH o AS ({V.ORDERS}), a AS (SELECT DISTINCT s FROM o WHERE p = 'type' AND o = 'class/2-HIGH'),
b AS (SELECT s FROM a UNION SELECT o FROM o WHERE s IN (SELECT s FROM a) AND o_kind = 'iri') SELECT DISTINCT s, p, o FROM o WHERE s IN (SELECT s FROM b)""")
def transitive_discovery(spark, sf):
    """Entities of a class, and whatever their resolved statements lead to."""
    q = _plain(V.orders(spark, sf))
    seeds = E.seed_subjects(q, seed_predicate="p = 'type' and o = 'class/2-HIGH'").select(F.col("s").alias("cs"))
    job = FusionJob()
    return E.discover(lambda f: job.run(E.by_seeds(q, f).drop("cs", "cp", "co")), seeds).select("s", "p", "o")


@query("metadata_quads", f"WITH {VALUES} SELECT 'quality' AS kind, cs, cp, co, CAST(round(quality, 6) AS VARCHAR) AS value FROM v UNION ALL SELECT 'source', cs, cp, co, unnest(string_split(sources, '|')) FROM v UNION ALL SELECT 'data', cs, cp, co, co FROM v")
def metadata_quads(spark, sf):
    """Data, quality and source statements, told back to the data quad by its graph."""
    out = FusionJob(scores=V.scores(spark, sf)).run(V.claims(spark, sf))
    all_ = sinks.with_metadata(out, "urn:meta")
    name = out.select("result_graph", F.col("s").alias("cs"), F.col("p").alias("cp"), F.col("o").alias("co"))
    data = all_.where("g <> 'urn:meta'").select(F.lit("data").alias("kind"), F.col("s").alias("cs"), F.col("p").alias("cp"), F.col("o").alias("co"), F.col("o").alias("value"))
    meta = all_.where("g = 'urn:meta'").select(F.col("s").alias("result_graph"), F.element_at(F.split("p", ":"), -1).alias("kind"), F.col("o").alias("value")).join(name, "result_graph")
    number = _six_digits(F.col("value").try_cast("double"))
    return data.unionByName(meta.select("kind", "cs", "cp", "co", F.when(F.col("kind") == "quality", number).otherwise(F.col("value")).alias("value")))


@query("sameas_dump", f"SELECT uri AS s, 'http://www.w3.org/2002/07/owl#sameAs' AS p, canonical AS o FROM ({V.CUSTOMER_MAPPING}) WHERE uri <> canonical")
def sameas_dump(spark, sf):
    return M.link_dump(M.build_mapping(V.customer_links(spark, sf)))


@query("canonical_dump", f"SELECT DISTINCT canonical FROM ({V.CUSTOMER_MAPPING})")
def canonical_dump(spark, sf):
    return M.canonical_uris(M.build_mapping(V.customer_links(spark, sf)))


@query("latest_value", "SELECT 'user/' || user_id AS cs, event_type AS cp, max(ts) AS latest FROM events GROUP BY 1, 2")
def latest_value(spark, sf):
    """The latest time stated for each user and event type (extension)."""
    from quadweave.schema import quads

    e = V.table(spark, sf, "events")
    q = quads(e, F.concat(F.lit("user/"), F.col("user_id").cast("string")), F.col("event_type"), F.col("ts").cast("string"), F.lit("events"))
    out = REGISTRY["LATEST"](Q.source_scores(E.dedupe(_plain(q)), None), Strategy("LATEST", MANY, IGNORE).over(GLOBAL_DEFAULT))
    return out.select("cs", "cp", F.col("co").cast("timestamp_ntz").alias("latest"))
