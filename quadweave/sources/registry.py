"""Sources by type: files, SPARQL endpoints and databases that speak SPARQL over JDBC."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadweave.config import Output, Source, SourceType
from quadweave.errors import Code, FusionError
from quadweave.operators.mapping import same_as_links
from quadweave.schema import COLUMNS
from quadweave.sources import sparql, turtle
from quadweave.sources.rdf import Format

JDBC_DRIVER = "virtuoso.jdbc4.Driver"
JDBC_PORT = 1111


def endpoint(source: Source) -> sparql.Endpoint:
    p = source.params
    return sparql.Endpoint(p.required("endpointUrl"), username=p.text("username"), password=p.text("password"), min_interval=(p.integer("minQueryInterval", 0) or 0) / 1000.0)


def jdbc_options(source: Source) -> dict[str, str]:
    p = source.params
    return {"url": f"jdbc:virtuoso://{p.required('host')}:{p.integer('port', JDBC_PORT)}/CHARSET=UTF-8", "user": p.required("username"), "password": p.required("password"), "driver": JDBC_DRIVER}


def jdbc_query(prefixes: Mapping[str, str], pattern: str = "", variable: str = "g") -> str:
    """All quads as a table of the quad model's columns, told by the server's own functions."""
    restriction = f" {{ {pattern} }}" if pattern else ""
    kind = lambda t: f"IF(isBlank(?{t}), 'bnode', IF(isLiteral(?{t}), 'literal', 'iri'))"
    text = f"SELECT (str(?s) AS ?s_) ({kind('s')} AS ?s_kind) (str(?p) AS ?p_) (str(?o) AS ?o_) ({kind('o')} AS ?o_kind) (str(datatype(?o)) AS ?o_dt) (lang(?o) AS ?o_lang) (str(?{variable}) AS ?g_) WHERE {{ GRAPH ?{variable} {{ ?s ?p ?o }}{restriction} }}"
    return "SPARQL " + sparql.with_prefixes(text, prefixes)


def _file(spark: SparkSession, source: Source, prefixes: Mapping[str, str]) -> DataFrame:
    p = source.params
    given = p.text("format")
    kind = Format.parse(given) if given else None
    if given and kind is None:
        raise FusionError(Code.REPOSITORY_CONFIG, f"unknown format '{given}' of source {source}")
    return turtle.read_files(spark, p.required("path"), kind, base=p.text("baseUri") or "")


def _sparql(spark: SparkSession, source: Source, prefixes: Mapping[str, str]) -> DataFrame:
    p, r = source.params, source.restriction
    return sparql.scan(spark, endpoint(source), prefixes, r.pattern, r.variable, p.integer("sparqlResultMaxRows", sparql.PAGE_ROWS), p.text("baseUri"))


def _jdbc(spark: SparkSession, source: Source, prefixes: Mapping[str, str]) -> DataFrame:
    r = source.restriction
    table = spark.read.format("jdbc").options(**jdbc_options(source)).option("dbtable", f"({jdbc_query(prefixes, r.pattern, r.variable)}) quads").load()
    names = dict(zip([c.lower().rstrip("_") for c in table.columns], table.columns, strict=True))
    out = table.select(*[F.col(f"`{names[c]}`").cast("string").alias(c) for c in COLUMNS])
    return out.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in ("o_dt", "o_lang")})


#: Readers by type; register more by adding to it.
READERS: dict[SourceType, Callable[[SparkSession, Source, Mapping[str, str]], DataFrame]] = {SourceType.FILE: _file, SourceType.SPARQL: _sparql, SourceType.VIRTUOSO: _jdbc}


def read(spark: SparkSession, source: Source, prefixes: Mapping[str, str] | None = None) -> DataFrame:
    """All quads of a data source."""
    reader = READERS.get(source.type)
    if reader is None:
        raise FusionError(Code.REPOSITORY_UNSUPPORTED, f"no reader for source {source}")
    return reader(spark, source, prefixes or {})


def _statements(spark: SparkSession, source: Source, prefixes: Mapping[str, str]) -> DataFrame:
    if source.type is SourceType.SPARQL and source.construct:
        return sparql.constructed(spark, endpoint(source), source.construct, prefixes)
    return read(spark, source, prefixes)


def links(spark: SparkSession, sources: list[Source], prefixes: Mapping[str, str] | None = None) -> DataFrame | None:
    """(s, o, seq) of equivalence links: of files their links of that type, of queries every statement. Files come first."""
    ordered = [s for s in sources if s.type is SourceType.FILE] + [s for s in sources if s.type is not SourceType.FILE]
    out = None
    for k, source in enumerate(ordered):
        found = _statements(spark, source, prefixes or {})
        one = (same_as_links(found) if source.type is SourceType.FILE else same_as_links(found, None)).withColumn("seq", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def metadata(spark: SparkSession, sources: list[Source], prefixes: Mapping[str, str] | None = None) -> DataFrame | None:
    """Statements about graphs."""
    out = None
    for source in sources:
        one = _statements(spark, source, prefixes or {})
        out = one if out is None else out.unionByName(one)
    return out


def insert_statements(quads: DataFrame) -> DataFrame:
    """(value): an SPARQL INSERT over JDBC for each quad."""
    rows = sparql.insert_rows(quads)
    return rows.select(F.concat(F.lit("SPARQL INSERT INTO GRAPH <"), F.col("graph"), F.lit("> { "), F.col("triple"), F.lit(" }")).alias("value"))


def write_jdbc(quads: DataFrame, output: Output) -> int:
    """Quads inserted over JDBC by the driver, row after row from a local iterator; returns how many failed.

    The driver class must be on Spark's class path. Rows that the database refuses are counted, not raised.
    """
    spark = quads.sparkSession
    options = jdbc_options(Source(SourceType.VIRTUOSO, output.params, output.name))
    jvm, failed = spark._jvm, 0
    try:
        jvm.java.lang.Class.forName(options["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(options["url"], options["user"], options["password"])
    except Exception as e:
        raise FusionError(Code.REPOSITORY_JDBC, f"cannot connect to {options['url']}: {e}", e) from e
    try:
        statement = connection.createStatement()
        for r in insert_statements(quads).toLocalIterator():
            try:
                statement.executeUpdate(r["value"])
            except Exception:
                failed += 1
    finally:
        connection.close()
    return failed
