"""The quad model: one row per statement, terms as flat columns.

s, s_kind      subject and its kind: iri or bnode
p              predicate IRI
o, o_kind      object and its kind: iri, bnode or literal
o_dt, o_lang   datatype and language of a literal, or null
g              graph the statement came from (null until a default is filled in)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

COLUMNS = ["s", "s_kind", "p", "o", "o_kind", "o_dt", "o_lang", "g"]
QUAD = StructType([StructField(c, StringType()) for c in COLUMNS])

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SAME_AS = "http://www.w3.org/2002/07/owl#sameAs"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSD_DOUBLE = XSD + "double"

TERM = ["o", "o_kind", "o_dt", "o_lang"]
RESOLVED = ["s", "s_kind", "p", *TERM, "quality", "sources", "result_graph"]


def quads(df: DataFrame, s: Column, p: Column, o: Column, g: Column, s_kind: str = "iri", o_kind: str = "literal") -> DataFrame:
    """A quad view over any table."""
    none = F.lit(None).cast("string")
    return df.select(s.alias("s"), F.lit(s_kind).alias("s_kind"), p.alias("p"), o.alias("o"), F.lit(o_kind).alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"), g.alias("g"))


def term_key(value: str = "o", prefix: str = "o") -> Column:
    """A term as one comparable value: kind, text, datatype, language."""
    none = F.lit("")
    return F.struct(F.col(f"{prefix}_kind"), F.col(value), F.coalesce(F.col(f"{prefix}_dt"), none), F.coalesce(F.col(f"{prefix}_lang"), none))
