"""Quad views over the test tables, in Spark and as DuckDB SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quadweave.schema import quads
from quadweave.session import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' claims about parts: discount, tax, returnflag. Lines are dealt by part before claims are made of them."""
    lines = table(spark, sf_dir, "lineitem")
    by_part = dealt(lines.select(_id("part/", "l_partkey").alias("s"), "l_suppkey", "l_discount", "l_tax", "l_returnflag"), lines, "s")
    each = by_part.select("s", "l_suppkey", F.expr("stack(3, 'discount', cast(l_discount as string), 'tax', cast(l_tax as string), 'returnflag', l_returnflag) as (p, o)"))
    return quads(each, F.col("s"), F.col("p"), F.col("o"), _id("supplier/", "l_suppkey")).distinct()


CLAIMS = """SELECT DISTINCT 'part/' || l_partkey AS s, p, o, 'supplier/' || l_suppkey AS g FROM (
SELECT l_partkey, l_suppkey, 'discount' AS p, CAST(l_discount AS VARCHAR) AS o FROM lineitem
UNION ALL SELECT l_partkey, l_suppkey, 'tax', CAST(l_tax AS VARCHAR) FROM lineitem
UNION ALL SELECT l_partkey, l_suppkey, 'returnflag', l_returnflag FROM lineitem)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two thirds of the suppliers, from their balance."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0")
    return s.select(_id("supplier/", "s_suppkey").alias("g"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("s_acctbal") / 9973.7)).alias("score"))


SCORES = "SELECT 'supplier/' || s_suppkey AS g, least(1.0, greatest(0.0, s_acctbal / 9973.7)) AS score FROM supplier WHERE s_suppkey % 3 <> 0"


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and size of documents, by source."""
    d = table(spark, sf_dir, "documents")
    each = d.select("doc_id", "source", F.expr("stack(3, 'lang', lang, 'source', source, 'n_chars', cast(n_chars as string)) as (p, o)"))
    return quads(each, _id("doc/", "doc_id"), F.col("p"), F.col("o"), _id("source/", "source"))


COPIES = """SELECT 'doc/' || doc_id AS s, p, o, 'source/' || source AS g FROM (
SELECT doc_id, source, 'lang' AS p, lang AS o FROM documents UNION ALL SELECT doc_id, source, 'source', source FROM documents
UNION ALL SELECT doc_id, source, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents)"""


def copy_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links (s, o) between documents of one text: each to the first."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first"))
    return d.join(first, "h").where("doc_id <> first").select(_id("doc/", "doc_id").alias("s"), _id("doc/", "first").alias("o"))


COPY_MAPPING = """SELECT 'doc/' || doc_id AS uri, min('doc/' || doc_id) OVER (PARTITION BY text) AS canonical FROM documents
WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    each = c.select("c_custkey", F.expr("stack(2, 'acctbal', cast(c_acctbal as string), 'name', c_name) as (p, o)"))
    return quads(each, _id("customer/", "c_custkey"), F.col("p"), F.col("o"), F.concat(F.lit("src/"), (F.col("c_custkey") % 5).cast("string")))


CUSTOMERS = """SELECT 'customer/' || c_custkey AS s, p, o, 'src/' || (c_custkey % 5) AS g FROM (
SELECT c_custkey, 'acctbal' AS p, CAST(c_acctbal AS VARCHAR) AS o FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer)"""


def customer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains: each customer of a nation and segment is linked to the one before."""
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("before", F.lag("c_custkey").over(w)).where("before is not null")
    return c.select(_id("customer/", "c_custkey").alias("s"), _id("customer/", "before").alias("o"))


CUSTOMER_MAPPING = """SELECT 'customer/' || c_custkey AS uri, min('customer/' || c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS canonical FROM customer
WHERE (c_nationkey, c_mktsegment) IN (SELECT (c_nationkey, c_mktsegment) FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1)"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested resources; line ids are made of all keys. Lines are dealt by order before statements are made of them."""
    lines = table(spark, sf_dir, "lineitem")
    line = F.concat_ws("-", F.lit("line/"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    g = _id("supplier/", "l_suppkey")
    by_order = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), lines, "l_orderkey")
    named = by_order.select("l_orderkey", _id("order/", "l_orderkey").alias("order"), line.alias("line"), g.alias("g"))
    has = quads(named.distinct(), F.col("order"), F.lit("hasLine"), F.col("line"), F.col("g"), o_kind="iri")
    each = by_order.select("l_orderkey", line.alias("line"), g.alias("g"), F.expr("stack(2, 'quantity', cast(l_quantity as string), 'price', cast(l_extendedprice as string)) as (p, o)"))
    own = quads(each.distinct(), F.col("line"), F.col("p"), F.col("o"), F.col("g"))
    o = table(spark, sf_dir, "orders")
    kind = quads(o, _id("order/", "o_orderkey"), F.lit("type"), F.concat(F.lit("class/"), F.col("o_orderpriority")), F.lit("graph/orders"), o_kind="iri")
    return has.unionByName(own).unionByName(kind.distinct())


_LINE = "'line/-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
ORDERS = f"""SELECT 'order/' || l_orderkey AS s, 'hasLine' AS p, {_LINE} AS o, 'iri' AS o_kind, 'supplier/' || l_suppkey AS g FROM lineitem
UNION SELECT {_LINE}, 'quantity', CAST(l_quantity AS VARCHAR), 'literal', 'supplier/' || l_suppkey FROM lineitem
UNION SELECT {_LINE}, 'price', CAST(l_extendedprice AS VARCHAR), 'literal', 'supplier/' || l_suppkey FROM lineitem
UNION SELECT 'order/' || o_orderkey, 'type', 'class/' || o_orderpriority, 'iri', 'graph/orders' FROM orders"""
