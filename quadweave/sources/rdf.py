"""RDF sources: line formats as native expressions."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadweave.schema import COLUMNS

_IRI = r"<(?:[^<>\"{}|^`\\\s]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>"
_BNODE = r"_:[^\s<>\"]*[^\s<>\".]"
_LITERAL = r'"(?:[^"\\]|\\.)*+"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^' + _IRI + ")?"
#: Groups: subject, predicate, object without datatype and language, datatype, language, graph.
_TEXT = r'"(?:[^"\\\n]|\\.)*+"'
_LINE = rf"^\s*({_IRI}|{_BNODE})\s*({_IRI})\s*({_IRI}|{_BNODE}|{_TEXT})(?:(?<=\")(?:\^\^({_IRI})|(@[A-Za-z]+(?:-[A-Za-z0-9]+)*)))?\s*({_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"
_TERM = rf"(?:{_IRI}|{_BNODE}|{_LITERAL})"
_TUPLE = rf"^\s*(?:{_TERM}\s*)+\.\s*(?:#.*)?$"


class Format(Enum):
    """Serialisations by name; html is for output only."""

    RDF_XML = ("rdf/xml", "rdfxml")
    N3 = ("ntriples", "n3")
    TRIG = ("trig",)
    NQUADS = ("nquads", "n-quads")
    HTML = ("html",)

    @classmethod
    def parse(cls, name: str | None) -> Format | None:
        low = (name or "").strip().lower()
        return next((f for f in cls if low in f.value), None)

    @classmethod
    def of_path(cls, path: str) -> Format:
        low = path.lower().removesuffix(".gz")
        ends = {".nq": cls.NQUADS, ".nt": cls.N3, ".n3": cls.N3, ".ttl": cls.N3, ".trig": cls.TRIG}
        return next((f for e, f in ends.items() if low.endswith(e)), cls.RDF_XML)


def _unescape(text: Column) -> Column:
    """Escapes of literals and IRIs; texts without a backslash are left alone.

    The text is cut at its backslashes. Every piece but the first begins with an escape, unless the
    piece before it is a backslash of its own: a doubled one leaves an empty piece, and the piece after that is plain.
    """
    pieces = F.split(text, r"\\")
    plain = F.create_map(*[F.lit(x) for pair in (("n", "\n"), ("r", "\r"), ("t", "\t"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'")) for x in pair])
    # code points are kept as UTF-16 units until all pieces are joined, so that pairs written as two escapes make one character
    units = lambda hex_: F.decode(F.unhex(hex_), "UTF-16BE")
    wide = lambda hex_: F.decode(F.unhex(hex_), "UTF-32")

    def piece(x: Column) -> Column:
        kind, rest = F.substring(x, 1, 1), F.substring(x, F.lit(2), F.length(x))
        short, long = F.substring(x, F.lit(6), F.length(x)), F.substring(x, F.lit(10), F.length(x))
        lone = (kind == "u") & F.upper(F.substring(x, 2, 2)).rlike("^D[89A-F]")  # half of a pair without the other
        return F.when(lone, F.concat(F.lit("\ufffd"), short)).when(kind == "u", F.concat(units(F.substring(x, 2, 4)), short)).when(kind == "U", F.concat(wide(F.substring(x, 2, 8)), long)).otherwise(F.concat(F.coalesce(F.element_at(plain, kind), kind), rest))

    # the state: text so far, whether the piece before was an escaped backslash, and a high surrogate that waits for its other half
    none = F.lit("")
    start = F.struct(F.get(pieces, F.lit(0)).alias("t"), F.lit(False).alias("plain"), none.alias("high"))

    def step(a: Column, x: Column) -> Column:
        hex4 = F.when(x.startswith("u"), F.upper(F.substring(x, 2, 4)))
        high, low = hex4.rlike("^D[89AB]") & (F.length(x) == 5), hex4.rlike("^D[C-F]")
        escaped = F.when(low & (a["high"] != ""), F.concat(units(F.concat(a["high"], hex4)), F.substring(x, F.lit(6), F.length(x)))).otherwise(piece(x))
        added = F.when(a["plain"], x).when(x == "", F.lit("\\")).when(F.coalesce(high, F.lit(False)), none).otherwise(escaped)
        return F.struct(F.concat(a["t"], added).alias("t"), (~a["plain"] & (x == "")).alias("plain"), F.when(~a["plain"] & F.coalesce(high, F.lit(False)), hex4).otherwise(none).alias("high"))

    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(F.contains(text, F.lit("\\")), F.aggregate(rest, start, step, lambda a: a["t"])).otherwise(text)


def _kind(t: Column) -> Column:
    return F.when(t.startswith("<"), "iri").when(t.startswith("_:"), "bnode").when(t.startswith('"'), "literal")


def _value(t: Column) -> Column:
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    return F.when(t.startswith("<"), _unescape(inner)).when(t.startswith("_:"), F.substring(t, F.lit(3), F.length(t))).when(t.startswith('"'), _unescape(F.regexp_extract(t, r'^"((?:[^"\\]|\\.)*+)"', 1)))


def parse_lines(lines: DataFrame, column: str = "value", mode: str = "PERMISSIVE", bnode_scope: str = "") -> DataFrame:
    """Quads of N-Triples or N-Quads lines. Blank and comment lines are skipped; bad lines fail the query (FAILFAST)
    or are skipped (PERMISSIVE; bad_lines() has them). bnode_scope keeps the blank nodes of several files apart.

    A line is matched once, into an array of its groups.
    """
    src = lines.select(F.col(column).alias("v")).where(~F.col("v").rlike(r"^\s*(#.*)?$"))
    # one match: the groups, put apart by the sign that no line can hold
    cut = F.split(F.regexp_replace("v", _LINE, "$1\n$2\n$3\n$4\n$5\n$6"), "\n")
    src = src.select("v", cut.alias("x"))
    ok = F.size("x") == 6
    if mode == "PERMISSIVE":
        src = src.where(ok)
    else:
        src = src.withColumn("x", F.when(ok, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not a statement: "), F.col("v"))).cast("array<string>")))
    parts = src.select(*[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(("s", "p", "o", "dt", "lang", "g"))])
    node = lambda c: F.when(F.col(c).startswith("_:"), F.concat(F.lit(bnode_scope), _value(F.col(c)))).otherwise(_value(F.col(c)))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return parts.select(
        node("s").alias("s"),
        _kind(F.col("s")).alias("s_kind"),
        _value(F.col("p")).alias("p"),
        node("o").alias("o"),
        _kind(F.col("o")).alias("o_kind"),
        _value(given("dt")).alias("o_dt"),
        F.substring(given("lang"), F.lit(2), F.length("lang")).alias("o_lang"),
        F.when(F.col("g").startswith("_:"), F.col("g")).otherwise(_value(given("g"))).alias("g"),
    ).select(*COLUMNS)


def bad_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """The lines that parse_lines() leaves out in PERMISSIVE mode."""
    return lines.where(~F.col(column).rlike(r"^\s*(#.*)?$") & ~F.col(column).rlike(_LINE))


def parse_tuples(lines: DataFrame, column: str = "value", mode: str = "PERMISSIVE") -> DataFrame:
    """(terms array<struct<kind,value>>) of lines with any number of terms before a full stop."""
    src = lines.select(F.col(column).alias("v")).where(~F.col("v").rlike(r"^\s*(#.*)?$"))
    ok = F.col("v").rlike(_TUPLE)
    src = src.where(ok) if mode == "PERMISSIVE" else src.withColumn("v", F.when(ok, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("not a tuple: "), F.col("v")))))
    found = F.regexp_extract_all("v", F.lit(f"({_TERM})"), F.lit(1))
    return src.select(F.transform(found, lambda t: F.struct(_kind(t).alias("kind"), _value(t).alias("value"))).alias("terms"))


def leading_resource(line: Column) -> Column:
    """The IRI or blank node that a line begins with, or null."""
    return _value(F.nullif(F.regexp_extract(line, rf"^\s*({_IRI}|{_BNODE})", 1), F.lit("")))


def read_lines(spark: SparkSession, path: str, default_graph: str | None = None, mode: str = "FAILFAST", bnode_scope: str = "") -> DataFrame:
    """A file or folder of N-Triples or N-Quads, also gzipped. Missing graphs get default_graph, else the path. A bad line is an error."""
    return parse_lines(spark.read.text(path), mode=mode, bnode_scope=bnode_scope).withColumn("g", F.coalesce("g", F.lit(default_graph or path)))


def read_uri_list(spark: SparkSession, path: str) -> DataFrame:
    """(uri) of a file with one IRI per line; an absent file is an empty list."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "uri string")
    return spark.read.text(path).select(F.col("value").alias("uri"))
