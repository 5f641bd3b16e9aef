"""Canonical identifiers: components of equivalence links, and their use on quads."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from quadweave.graph import connected_components
from quadweave.schema import SAME_AS
from quadweave.session import held_if_small

#: The exact, order-dependent choice replays links on the driver; beyond this many it is refused.
MAX_EXACT_LINKS = 1_000_000

_VOCABULARIES = {
    "http://www.w3.org/2000/01/rdf-schema#": ["label"],
    "http://www.w3.org/1999/02/22-rdf-syntax-ns#": ["type"],
    "http://www.w3.org/2002/07/owl#": ["sameAs", "Nothing", "Thing", "Class"],
    "http://purl.org/dc/terms/": ["title", "date", "source"],
    "http://purl.org/dc/elements/1.1/": ["creator", "source", "subject"],
}
#: Vocabulary terms that are preferred as canonical names.
DEFAULT_PREFERRED = [ns + name for ns, names in _VOCABULARIES.items() for name in names]


def same_as_links(quads: DataFrame, types: Iterable[str] | None = (SAME_AS,)) -> DataFrame:
    """(s, o) of links between IRIs. types None takes every statement, as for constructed links."""
    links = quads.where("s_kind = 'iri' and o_kind = 'iri'")
    if types is not None:
        links = links.where(F.col("p").isin(list(types)))
    return links.select("s", "o")


def build_mapping(links: DataFrame, preferred: DataFrame | None = None) -> DataFrame:
    """(uri, canonical) for every IRI in a link.

    The canonical IRI of a component is its preferred one, else the smallest;
    of several preferred ones the smallest.
    """
    parts = connected_components(links, "s", "o")
    if preferred is not None:
        marks = preferred.select(F.col("uri").alias("node"), F.lit(True).alias("__preferred")).distinct()
        parts = parts.join(marks, "node", "left")
    else:
        parts = parts.withColumn("__preferred", F.lit(None).cast("boolean"))
    choice = parts.groupBy("component").agg(F.min(F.struct(F.col("__preferred").isNull().alias("late"), F.col("node"))).alias("best"))
    return parts.join(held_if_small(choice), "component").select(F.col("node").alias("uri"), F.col("best.node").alias("canonical"))


def build_mapping_exact(links: DataFrame, order: str, preferred: Iterable[str] = ()) -> DataFrame:
    """(uri, canonical) by replaying links in order: of two roots the second wins if it is preferred, else the first."""
    spark, liked, parent = links.sparkSession, set(preferred), {}
    rows = links.orderBy(order).select("s", "o").limit(MAX_EXACT_LINKS + 1).collect()
    if len(rows) > MAX_EXACT_LINKS:
        raise ValueError("too many links for the exact order; use build_mapping")

    def root(x: str) -> str:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    for s, o in rows:
        a, b = root(s), root(o)
        parent.setdefault(s, s)
        parent.setdefault(o, o)
        if a != b:
            if b in liked:
                parent[a] = b
            else:
                parent[b] = a
    return spark.createDataFrame([(u, root(u)) for u in parent], "uri string, canonical string")


def alternatives(mapping: DataFrame) -> DataFrame:
    """(canonical, n, uris): members of each component, canonical first."""
    rest = F.array_sort(F.collect_list(F.when(F.col("uri") != F.col("canonical"), F.col("uri"))))
    return mapping.groupBy("canonical").agg(F.count("*").alias("n"), rest.alias("__rest")).select("canonical", "n", F.concat(F.array("canonical"), "__rest").alias("uris"))


def canonical_uris(mapping: DataFrame) -> DataFrame:
    return mapping.select("canonical").distinct()


def link_dump(mapping: DataFrame) -> DataFrame:
    """(s, p, o): every mapped IRI that isn't canonical, linked to its canonical one."""
    return mapping.where("uri <> canonical").select(F.col("uri").alias("s"), F.lit(SAME_AS).alias("p"), F.col("canonical").alias("o"))


def map_column(df: DataFrame, mapping: DataFrame, column: str, out: str, kind: str | None = None) -> DataFrame:
    """df with out: the canonical IRI of column, or column itself. kind names the column that must be 'iri'."""
    names = mapping.select(F.col("uri").alias("__uri"), F.col("canonical").alias("__to"))
    on = F.col(column) == F.col("__uri")
    if kind:
        on &= F.col(kind) == "iri"
    return df.join(names, on, "left").withColumn(out, F.coalesce("__to", column)).drop("__uri", "__to")


def canonicalise(quads: DataFrame, mapping: DataFrame | None) -> DataFrame:
    """quads with cs, cp, co: subject, predicate and object as canonical IRIs; graphs stay."""
    if mapping is None:
        return quads.withColumns({"cs": F.col("s"), "cp": F.col("p"), "co": F.col("o")})
    mapping = held_if_small(mapping)
    # few distinct predicates: they are mapped on their own, and joined as a small table
    out = map_column(quads, mapping, "s", "cs", "s_kind")
    predicates = map_column(quads.select("p").distinct(), mapping, "p", "cp")
    return map_column(out.join(predicates, "p"), mapping, "o", "co", "o_kind")
