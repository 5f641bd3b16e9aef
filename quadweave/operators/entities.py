"""Operators on canonical quads: descriptions, clusters, filters, seeds, limits.

Canonical quads have cs, cp, co beside the quad columns; the entity of a quad is cs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadweave.schema import RDF_TYPE
from quadweave.session import Table

# ---------------------------------------------------------------- sources as a whole


def fill_graph(quads: DataFrame, default: str) -> DataFrame:
    return quads.withColumn("g", F.coalesce("g", F.lit(default)))


def union_sources(*sources: DataFrame) -> DataFrame:
    """All sources as a bag."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def restrict_graphs(quads: DataFrame, predicate: Column | str) -> DataFrame:
    """Quads whose graph meets the predicate (a Column or SQL text on g)."""
    return quads.where(predicate)


# ---------------------------------------------------------------- clusters


def dedupe(mapped: DataFrame, by_subject: Iterable[str] = ()) -> DataFrame:
    """Canonical statements without repeats; one triple from two graphs is two statements.

    Statements with a predicate of by_subject are told apart by their original subject, too.
    """
    key = ["cs", "s_kind", "cp", "co", "o_kind", "o_dt", "o_lang", "g"]
    own = list(by_subject)
    if not own:
        return mapped.dropDuplicates(key)
    return mapped.withColumn("__by", F.when(F.col("cp").isin(own), F.col("s"))).dropDuplicates([*key, "__by"]).drop("__by")


def clusters(mapped: DataFrame) -> DataFrame:
    """(cs, cp, n_statements, n_values, n_graphs) for each conflict cluster.

    The first statement of each value and of each graph is marked, which counts both in one pass where the cluster lies.
    """
    value = ["co", "o_kind", F.coalesce("o_dt", F.lit("")), F.coalesce("o_lang", F.lit(""))]
    first_of_value = F.row_number().over(Window.partitionBy("cs", "cp", *value).orderBy("g")) == 1
    first_of_graph = F.row_number().over(Window.partitionBy("cs", "cp", "g").orderBy("co")) == 1
    marked = dedupe(mapped).select("cs", "cp", (first_of_value & F.col("co").isNotNull() & F.col("o_kind").isNotNull()).alias("__value"), (first_of_graph & F.col("g").isNotNull()).alias("__graph"))
    return marked.groupBy("cs", "cp").agg(F.count("*").alias("n_statements"), F.count_if("__value").alias("n_values"), F.count_if("__graph").alias("n_graphs"))


def conflicting_clusters(mapped: DataFrame) -> DataFrame:
    """(cs, cp) where not every value is claimed by the same graphs."""
    by_value = dedupe(mapped).groupBy("cs", "cp", "co", "o_kind", "o_dt", "o_lang").agg(F.sort_array(F.collect_set("g")).alias("__graphs"))
    return by_value.groupBy("cs", "cp").agg(F.min("__graphs").alias("a"), F.max("__graphs").alias("b")).where("a <> b").select("cs", "cp")


# ---------------------------------------------------------------- descriptions


def attribute_index(mapped: DataFrame, properties: Iterable[str]) -> DataFrame:
    """(k, entity): resources that hang on an entity by one of the (canonical) properties."""
    named = mapped.where(F.col("cp").isin(list(properties)) & F.col("o_kind").isin("iri", "bnode")).select(F.col("co").alias("k"), F.col("cs").alias("entity"))
    return named.repartition("k").distinct()  # dealt as merge_index needs it


def merge_index(mapped: DataFrame, index: DataFrame) -> DataFrame:
    """Quads of resources in the index, once for each entity that they hang on."""
    return mapped.join(index, mapped["cs"] == index["k"]).drop("k")


def describe(mapped: DataFrame, properties: Iterable[str] = ()) -> DataFrame:
    """Quads with entity: its own ones, and those of resources one hop away by properties."""
    own = mapped.withColumn("entity", F.col("cs"))
    properties = list(properties)
    return own.unionByName(merge_index(mapped, attribute_index(mapped, properties)).select(*own.columns)) if properties else own


# ---------------------------------------------------------------- filters


def within(mapped: DataFrame, keys: DataFrame, key: str = "cs") -> DataFrame:
    """mapped without what can't join with keys on cs, being less or greater than all of them.

    The range is looked up at once, so that filters on it reach the sources; resources of one kind mostly share a prefix.
    """
    least, most = keys.agg(F.min(key), F.max(key)).first()
    return mapped.where("false") if least is None else mapped.where(F.col("cs").between(least, most))


def of_class(mapped: DataFrame, cls: str, type_iri: str = RDF_TYPE) -> DataFrame:
    """(cs) of entities with a type statement for the class; both IRIs are canonical."""
    return mapped.where((F.col("cp") == type_iri) & F.col("o_kind").isin("iri", "bnode") & (F.col("co") == cls)).select("cs").distinct()


def required_class(mapped: DataFrame, cls: str, type_iri: str = RDF_TYPE) -> DataFrame:
    members = of_class(mapped, cls, type_iri)
    return within(mapped, members).join(members, "cs", "left_semi")


def only_mapped(mapped: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities that are IRIs with at least one other IRI in their component."""
    several = mapping.groupBy("canonical").agg(F.count("*").alias("n")).where("n > 1").select(F.col("canonical").alias("cs"))
    return mapped.where("s_kind = 'iri'").join(several, "cs", "left_semi")


def only_conflicts(mapped: DataFrame) -> DataFrame:
    return mapped.join(conflicting_clusters(mapped), ["cs", "cp"], "left_semi")


def apply_filters(mapped: DataFrame, filters: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """All filters, one after the other; none accepts everything."""
    for f in filters:
        mapped = f(mapped)
    return mapped


# ---------------------------------------------------------------- seeds


def seed_subjects(quads: DataFrame, graph_predicate: Column | str = "true", seed_predicate: Column | str = "true") -> DataFrame:
    """Distinct IRI subjects of statements that meet both restrictions (in one graph)."""
    return quads.where("s_kind = 'iri'").where(graph_predicate).where(seed_predicate).select("s").distinct()


def by_seeds(mapped: DataFrame, seeds: DataFrame) -> DataFrame:
    """Quads of the seed entities; seeds has cs, canonical."""
    return within(mapped, seeds).join(seeds.select("cs").distinct(), "cs", "left_semi")


def discover(resolve: Callable[[DataFrame], DataFrame], seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Transitive closure from seeds (cs): objects of resolved statements become new subjects.

    resolve(frontier) gives resolved statements of the entities in frontier; only what
    survives resolution is followed. Each round is written to the shared folder.
    Rounds go on until nothing new is found; more than max_rounds of them are an error.
    """
    frontier = Table(seeds.select("cs").distinct())
    visited, parts = frontier.df, []
    while True:
        if max_rounds is not None and len(parts) >= max_rounds:
            raise RuntimeError(f"entities left to resolve after {max_rounds} rounds")
        got = Table(resolve(frontier.df)).df
        parts.append(got)
        found = Table(got.where("o_kind = 'iri'").select(F.col("o").alias("cs")).distinct().join(visited, "cs", "left_anti"))
        if found.df.isEmpty():
            break
        frontier, visited = found, Table(visited.unionByName(found.df)).df
    return union_sources(*parts)


# ---------------------------------------------------------------- limit


def limit_entities(resolved: DataFrame, most: int | None, entity: str = "s") -> DataFrame:
    """Whole entities, in ascending order, as long as all statements up to them number no more than most.

    Statements are counted per entity, entities are summed in ranges of a
    distributed sort, and range totals are added: no single-task window over entities.
    """
    if most is None or most < 0:
        return resolved
    return resolved.join(first_entities(resolved.groupBy(entity).agg(F.count("*").alias("__n")), most, entity), entity, "left_semi")


def first_entities(counts: DataFrame, most: int, entity: str = "s") -> DataFrame:
    """The entities that limit_entities keeps, by counts of their statements (__n)."""
    counts = Table(counts).df  # dealing by ranges reads them twice
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = Table(counts.repartitionByRange(parts, entity).withColumn("__part", F.spark_partition_id())).df
    totals = ranged.groupBy("__part").agg(F.sum("__n").alias("__total"))
    before = totals.select("__part", F.coalesce(F.sum("__total").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    running = F.sum("__n").over(Window.partitionBy("__part").orderBy(entity).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__sum", running).join(before, "__part").where(F.col("__sum") + F.col("__before") <= most).select(entity)
