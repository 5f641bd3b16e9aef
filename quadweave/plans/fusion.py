"""The fusion plan: canonicalise, choose entities, resolve by policy, limit."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from quadweave.functions import quality as Q
from quadweave.functions.resolution import CONFLICT, GLOBAL_DEFAULT, OUT, Strategy, function
from quadweave.operators import entities as E
from quadweave.operators import mapping as M
from quadweave.schema import TERM
from quadweave.session import Table

DEPENDENT = "DEPENDENT_RESOURCE"


def _dependent(strategy: Strategy) -> bool:
    return (strategy.function or "").upper() == DEPENDENT


def _flat(strategy: Strategy) -> Strategy:
    """Where no resource can be nested, all values are kept."""
    return Strategy("ALL", strategy.cardinality, strategy.on_error) if _dependent(strategy) else strategy


@dataclass
class Policy:
    """A default strategy and strategies for properties."""

    default: Strategy = field(default_factory=Strategy)
    properties: dict[str, Strategy] = field(default_factory=dict)

    def effective(self, canonical: dict[str, str] | None = None) -> Policy:
        """Gaps filled from the defaults, properties under their canonical names."""
        default = self.default.over(GLOBAL_DEFAULT)
        names = canonical or {}
        plain = Strategy(default.function, default.cardinality, default.on_error, None, default.params)
        return Policy(default, {names.get(p, p): s.over(plain) for p, s in sorted(self.properties.items())})

    def groups(self, canonical: dict[str, str] | None = None) -> list[tuple[str, ...]]:
        """Groups of two or more properties that are resolved together."""
        names, parent = canonical or {}, {}

        def root(x: str) -> str:
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for p, s in self.properties.items():
            if s.depends_on:
                a, b = root(names.get(p, p)), root(names.get(s.depends_on, s.depends_on))
                if a != b:
                    parent[max(a, b)] = min(a, b)
        out: dict[str, list[str]] = {}
        for p in parent:
            out.setdefault(root(p), []).append(p)
        return sorted(tuple(sorted(g)) for g in out.values() if len(g) > 1)

    def dependent_properties(self) -> list[str]:
        """Properties whose objects are resolved as nested resources."""
        return [p for p, s in self.properties.items() if _dependent(s)]

    def is_nested(self) -> Column | None:
        """Whether cp is resolved as nested resources; None if no property is."""
        named = self.dependent_properties()
        if _dependent(self.default):
            others = [p for p in self.properties if p not in named]
            return ~F.col("cp").isin(others) if others else F.lit(True)
        return F.col("cp").isin(named) if named else None

    def flat(self) -> Policy:
        return Policy(_flat(self.default), {p: _flat(s) for p, s in self.properties.items()})


def _names(mapping: DataFrame | None, wanted: Iterable[str]) -> dict[str, str]:
    """Canonical names of the policy's own properties (as many as the policy has)."""
    wanted = sorted(set(wanted))
    if mapping is None or not wanted:
        return {}
    return {r["uri"]: r["canonical"] for r in mapping.where(F.col("uri").isin(wanted)).collect()}


def _branches(statements: DataFrame, policy: Policy) -> list[tuple[DataFrame, Strategy]]:
    """Statements by strategy; properties with equal strategies share a branch."""
    def key(s: Strategy) -> tuple:
        return (s.function, s.cardinality, s.on_error, tuple(sorted(s.params.items())))

    by: dict[tuple, tuple[Strategy, list[str]]] = {}
    for p, s in policy.properties.items():
        if key(s) != key(policy.default):
            by.setdefault(key(s), (s, []))[1].append(p)
    own = [p for _, ps in by.values() for p in ps]
    out = [(statements.where(F.col("cp").isin(ps)), s) for s, ps in by.values()]
    rest = statements.where(~F.col("cp").isin(own)) if own else statements
    return [(rest, policy.default), *out]


def resolve_clusters(statements: DataFrame, policy: Policy) -> DataFrame:
    """Resolved values of all clusters (cs, cp) by the policy's functions; none of them nested."""
    out = None
    for part, strategy in _branches(statements, policy.flat()):
        got = function(strategy.function)(part, strategy).select(*OUT)
        out = got if out is None else out.unionByName(got)
    return out


def resolve_nested(parents: DataFrame, everything: DataFrame, policy: Policy, prefix: str, written: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Objects of parents resolved as one new resource for each cluster, one level deep.

    Returns the parents' resolved values and the new resources' ones; the latter have parent, the
    cluster's cs. What nested resources hold is looked up in everything, which may have repeats. The new resource's IRI is
    made of a hash, so a repeated run mints the same one; until the end its cluster stands for it, which is shorter.
    Literal objects keep standing as values of the parent. written: writes a table that is read twice.
    """
    cs, cp = F.split_part("__n", F.lit("\u0002"), F.lit(1)), F.split_part("__n", F.lit("\u0002"), F.lit(2))
    minted = F.concat(F.lit(prefix), F.sha2(F.to_json(F.struct(cs.alias("cs"), cp.alias("cp"))), 256))
    resources = parents.where("o_kind <> 'literal'").select(F.concat_ws("\u0002", "cs", "cp").alias("__n"), F.col("co").alias("__of"))
    links = resources.repartition("__of").distinct()
    held = [c for c in everything.columns if c not in ("cs", CONFLICT, "s", "s_kind", "p", "o")]
    inner = E.within(everything, resources, "__of").join(links, F.col("cs") == F.col("__of")).select(F.col("__n").alias("cs"), *held)
    found = written(resolve_clusters(inner.repartition("cs").distinct(), policy).select(*OUT)).withColumnRenamed("cs", "__n")
    summed = found.groupBy("__n").agg(F.avg("quality").alias("quality"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"))
    none = F.lit(None).cast("string")
    top = resources.select("__n").distinct().join(summed, "__n", "left").select(
        cs.alias("cs"), cp.alias("cp"), minted.alias("co"), F.lit("iri").alias("o_kind"), none.alias("o_dt"), none.alias("o_lang"),
        F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
    )
    literals = function("ALL")(parents.where("o_kind = 'literal'"), GLOBAL_DEFAULT)
    return top.unionByName(literals.select(*OUT)), found.withColumn("parent", cs).withColumn("cs", minted).select(*OUT, "parent")


def resolve_dependent(statements: DataFrame, everything: DataFrame, policy: Policy, group: tuple[str, ...], prefix: str, written: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A group of properties, all from the one original subject whose values are best on the whole; with parent.

    A subject's score is the sum of its clusters' mean qualities over the size of the
    group, so a property that it lacks counts as 0; ties go to the smallest subject. Clusters are
    per subject, but the values of the entity's other subjects count as conflicts. written: writes a table that is read twice.
    """
    own = statements.where(F.col("cp").isin(list(group)))
    split = own.withColumn(CONFLICT, F.col("cs")).withColumn("cs", F.concat_ws("\u0001", "cs", "s"))
    nested = policy.is_nested()
    found = resolve_clusters(split if nested is None else split.where(~nested), policy)
    inner = None
    if nested is not None:
        top, inner = resolve_nested(split.where(nested), everything, policy, prefix, written)
        found = found.unionByName(top)
    found = written(found)
    entity = F.split_part("cs", F.lit("\u0001"), F.lit(1))
    score = found.groupBy("cs", "cp").agg(F.avg("quality").alias("q")).groupBy("cs").agg((F.sum("q") / len(group)).alias("score"))
    best = score.groupBy(entity.alias("__entity")).agg(F.min_by("cs", F.struct((-F.col("score")).alias("a"), F.col("cs").alias("b"))).alias("cs")).select("cs")
    out = found.join(best, "cs", "left_semi").withColumn("cs", entity).select(*OUT, F.col("cs").alias("parent"))
    if inner is not None:
        chosen = inner.join(best.select(F.col("cs").alias("parent")), "parent", "left_semi")
        out = out.unionByName(chosen.select(*OUT, F.split_part("parent", F.lit("\u0001"), F.lit(1)).alias("parent")))
    return out


def finish(resolved: DataFrame, result_prefix: str) -> DataFrame:
    """Resolved rows as quads with their entity; each gets a graph of its own, named after all that it holds.

    A repeated run names the same graphs; statements of one value that differ in their sources have two.
    """
    graph = F.concat(F.lit(result_prefix), F.sha2(F.to_json(F.struct("cs", "cp", "co", "o_kind", "o_dt", "o_lang", "sources")), 256))
    return resolved.select(F.col("cs").alias("s"), F.col("cp").alias("p"), F.col("co").alias("o"), *TERM[1:], "quality", "sources", graph.alias("result_graph"), F.col("parent").alias("entity"))


@dataclass
class FusionJob:
    """Everything a fusion run needs; steps can be overridden in subclasses.

    Filters choose what is resolved. What nested resources hold is not filtered. Intermediate
    tables lie in the shared folder until release() is called.
    """

    policy: Policy = field(default_factory=Policy)
    links: DataFrame | None = None
    preferred: DataFrame | None = None
    scores: DataFrame | None = None
    filters: list[Callable[[DataFrame, DataFrame | None], DataFrame]] = field(default_factory=list)
    required_class: str | None = None
    only_mapped: bool = False
    only_conflicts: bool = False
    seeds: DataFrame | None = None
    max_output: int | None = None
    result_prefix: str = "urn:quadweave:result:"
    unknown_score: float = Q.UNKNOWN_SCORE
    metadata: DataFrame | None = None
    tables: list[Table] = field(default_factory=list)

    def release(self) -> None:
        """Drop intermediate tables; results that aren't written by then can't be computed any more."""
        while self.tables:
            self.tables.pop().drop()

    def _written(self, df: DataFrame) -> DataFrame:
        self.tables.append(Table(df))
        return self.tables[-1].df

    def preferred_names(self) -> DataFrame | None:
        """Names preferred as canonical ones: those given, the policy's properties and the usual vocabulary terms."""
        if self.links is None:
            return None
        mentioned = [*self.policy.properties, *(s.depends_on for s in self.policy.properties.values() if s.depends_on)]
        known = sorted({*mentioned, *M.DEFAULT_PREFERRED})
        own = self.links.sparkSession.createDataFrame([(u,) for u in known], "uri string")
        return own if self.preferred is None else self.preferred.select("uri").unionByName(own)

    def mapping(self) -> DataFrame | None:
        return None if self.links is None else self._written(M.build_mapping(self.links, self.preferred_names()))

    def deduped(self, mapped: DataFrame, mapping: DataFrame | None, grouped: Iterable[str] = (), deal: bool = False) -> DataFrame:
        """Canonical statements without repeats; deal: by cluster, so that later steps leave them there. Those of grouped properties are told apart by their original subject, too."""
        if mapping is None:  # original terms are canonical
            names = ["s", "s_kind", "p", *TERM, "g"]
            plain = mapped.drop("cs", "cp", "co")
            return M.canonicalise((plain.repartition("s", "p") if deal else plain).dropDuplicates(names), None)
        return E.dedupe(mapped.repartition("cs", "cp") if deal else mapped, grouped)

    def scored(self, statements: DataFrame, policy: Policy) -> DataFrame:
        """Statements with the score of their graph, and with what metadata the policy asks for."""
        out = Q.source_scores(statements, self.scores, self.unknown_score)
        for name in sorted({s.params["property"] for s in (policy.default, *policy.properties.values()) if (s.function or "").upper() == "MAX_SOURCE_METADATA"}):
            out = Q.source_metadata(out, self.metadata, name)
        return out

    def limited(self) -> bool:
        return self.max_output is not None and self.max_output >= 0

    def filtered(self, mapped: DataFrame, mapping: DataFrame | None) -> DataFrame:
        """Statements to be resolved."""
        if self.seeds is not None:
            seeds = self.seeds.select(F.col(self.seeds.columns[0]).alias("s"))
            mapped = E.by_seeds(mapped, M.map_column(seeds, mapping, "s", "cs") if mapping is not None else seeds.select(F.col("s").alias("cs")))
        if self.required_class:
            names = _names(mapping, [self.required_class, E.RDF_TYPE])
            mapped = E.required_class(mapped, names.get(self.required_class, self.required_class), names.get(E.RDF_TYPE, E.RDF_TYPE))
        if self.only_mapped:
            mapped = mapped.where("false") if mapping is None else E.only_mapped(mapped, mapping)
        if self.only_conflicts:
            mapped = E.only_conflicts(mapped)
        return E.apply_filters(mapped, [lambda m, f=f: f(m, mapping) for f in self.filters])

    def resolve(self, statements: DataFrame, everything: DataFrame, policy: Policy, groups: list[tuple[str, ...]]) -> DataFrame:
        """(cs, cp, value, quality, sources, parent) of all entities in statements."""
        prefix = self.result_prefix + "nested:"
        grouped = [p for g in groups for p in g]
        plain = statements.where(~F.col("cp").isin(grouped)) if grouped else statements
        nested = policy.is_nested()
        parent = F.col("cs").alias("parent")
        out = resolve_clusters(plain if nested is None else plain.where(~nested), policy).select(*OUT, parent)
        for g in groups:
            out = out.unionByName(resolve_dependent(statements, everything, policy, g, prefix, self._written))
        if nested is not None:
            top, inner = resolve_nested(plain.where(nested), everything, policy, prefix, self._written)
            out = out.unionByName(top.select(*OUT, parent)).unionByName(inner)
        return out

    def run(self, quads: DataFrame) -> DataFrame:
        """Fused quads: s, p, o with its kind, datatype and language, quality, sources, result_graph.

        Statements are written once if more than one branch of the plan reads them. If the output is limited, statements
        are counted first, and only entities within the limit are resolved for output.
        """
        mapping = self.mapping()
        mentioned = [*self.policy.properties, *(s.depends_on for s in self.policy.properties.values() if s.depends_on)]
        names = _names(mapping, mentioned)
        policy, groups = self.policy.effective(names), self.policy.groups(names)
        grouped = [p for g in groups for p in g]
        narrowed = bool(self.required_class or self.only_mapped or self.seeds is not None)
        nested = policy.is_nested() is not None
        branches = len(_branches(quads.withColumn("cp", F.col("p")), policy)) + 2 * len(groups) + 2 * nested
        kept = narrowed or branches > 1 or self.limited()
        if kept:
            # narrow statements, of which canonical ones are made again wherever they are read
            quads = M.canonicalise(self._written(quads), None) if mapping is None else self._written(M.canonicalise(quads, mapping))
        else:
            quads = M.canonicalise(quads, mapping)
        everything = self.scored(quads, policy) if nested else None
        if self.filters or self.only_conflicts:
            statements = self.filtered(self.deduped(quads, mapping, grouped, kept), mapping)
        else:
            statements = self.deduped(self.filtered(quads, mapping), mapping, grouped, kept)
        if (narrowed or self.filters or self.only_conflicts) and (branches > 1 or self.limited()):
            statements = self._written(statements)
        resolve = lambda chosen: finish(self.resolve(self.scored(chosen, policy), everything, policy, groups), self.result_prefix)
        out = resolve(statements)
        if self.limited():
            counts = out.groupBy(F.col("entity").alias("cs")).agg(F.count("*").alias("__n"))
            within_limit = self._written(E.first_entities(counts, self.max_output, "cs"))
            out = resolve(E.by_seeds(statements, within_limit))
        return out.drop("entity")
