"""Resolution functions: from the statements of a conflict cluster to resolved values.

Every function is a builder of DataFrame plans, so a policy plans only the branches that
it uses. Input rows are deduplicated statements with cs, cp, co, term columns, g, score.
Output rows: cs, cp, co, o_kind, o_dt, o_lang, quality, sources.

Evidenced functions: ALL, NONE, BEST, AVG (and DEPENDENT_RESOURCE in plans.fusion).
All others are extensions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from quadweave.functions import quality as Q
from quadweave.schema import XSD_DOUBLE, term_key

KEY = ["cs", "cp"]
VALUE = ["co", "o_kind", "o_dt", "o_lang"]
OUT = [*KEY, *VALUE, "quality", "sources"]
#: An optional column of statements: where it stands, all statements that share it and cp are conflicts, not the cluster alone.
CONFLICT = "__conflict"
#: Distinct values of a cluster that one task compares with all others.
BLOCK = 512

SINGLE, MANY = "SINGLEVALUED", "MANYVALUED"
IGNORE, RETURN_ALL = "IGNORE", "RETURN_ALL"


@dataclass(frozen=True)
class Strategy:
    """How the values of a property are resolved. None means: as the default has it."""

    function: str | None = None
    cardinality: str | None = None
    on_error: str | None = None
    depends_on: str | None = None
    params: dict[str, str] = field(default_factory=dict)

    def over(self, default: Strategy) -> Strategy:
        return Strategy(self.function or default.function, self.cardinality or default.cardinality, self.on_error or default.on_error, self.depends_on or default.depends_on, {**default.params, **self.params})


GLOBAL_DEFAULT = Strategy("ALL", MANY, RETURN_ALL)


# ---------------------------------------------------------------- values with quality


_number = Q.number


def _join_values(left: DataFrame, right: DataFrame, group: Iterable[str] = KEY) -> DataFrame:
    """left with the further columns of right, by cluster (or group) and value; nulls are equal."""
    keys = [*group, *VALUE]
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = [F.col(k) == F.col(f"__r_{k}") if k in (*group, "co", "o_kind") else F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, on).drop(*[f"__r_{k}" for k in keys])


def _far(found: DataFrame, group: list[str]) -> DataFrame:
    """The mean distance of each value to all statements of its group; found has each value of a group once, stated n times.

    Groups of many values are cut into blocks: a task compares a block of values with a block of others,
    and the sums of blocks are added.
    """
    sizes = found.groupBy(*group).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("__blocks"))
    hashed = F.pmod(F.xxhash64("co", "o_kind", "o_dt", "o_lang"), F.col("__blocks")).cast("int")
    number = _number(F.col("co"), F.col("o_kind"))
    cut = found.join(sizes, group).withColumns({"__x": number, "__own": hashed, "__with": F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))})
    left = cut.select(*group, *VALUE, "__x", F.col("__own").alias("__row"), F.col("__with").alias("__block"))
    right = cut.select(*[F.col(k).alias(f"__g_{k}") for k in group], F.col("co").alias("__co"), F.col("o_kind").alias("__kind"), F.col("__x").alias("__y"), F.col("n").alias("__n"), F.col("__own").alias("__other"), F.col("__with").alias("__for"))
    d = Q.distance(F.col("co"), F.col("o_kind"), F.col("__co"), F.col("__kind"), F.col("__x"), F.col("__y"))
    on = (F.col("__block") == F.col("__other")) & (F.col("__row") == F.col("__for"))
    for k in group:
        on &= F.col(k) == F.col(f"__g_{k}")
    return left.join(right, on).groupBy(*group, *VALUE).agg((F.sum(d * F.col("__n")) / F.sum("__n")).alias("far"))


def values(statements: DataFrame, single: bool, deciding: bool = True) -> DataFrame:
    """One row per distinct value of a cluster, with quality, sources and counts.

    Distances are between distinct values, weighted by how often each was
    stated; the join is by cluster and needed for single-valued properties only.
    """
    wide = CONFLICT in statements.columns
    own = statements.groupBy(*KEY, *VALUE).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("g")).alias("sources"), F.sum("score").alias("sum_score"), F.max("score").alias("max_score"), *([F.first(CONFLICT).alias(CONFLICT)] if wide else [])
    )
    base = F.col("max_score")
    if single:
        group = [CONFLICT, "cp"] if wide else KEY
        others = statements.groupBy(*group, *VALUE).agg(F.count("*").alias("n")) if wide else own
        own = _join_values(own, _far(others.select(*group, *VALUE, "n"), group), group)
        base = base * (1 - F.col("far"))
    return own.withColumn("quality", Q.agreement(base, F.col("sum_score"), F.col("max_score")) if deciding else base)


def _all(statements: DataFrame, strategy: Strategy) -> DataFrame:
    return values(statements, strategy.cardinality == SINGLE).select(*OUT)


def _none(statements: DataFrame, strategy: Strategy) -> DataFrame:
    """Every statement by itself, with its own graph."""
    if strategy.cardinality != SINGLE:
        return statements.select(*KEY, *VALUE, F.col("score").alias("quality"), F.array("g").alias("sources"))
    far = values(statements, True, False).select(*KEY, *VALUE, (F.col("quality") / F.col("max_score")).alias("near"))
    out = _join_values(statements, far)
    return out.select(*KEY, *VALUE, (F.col("score") * F.coalesce("near", F.lit(0.0))).alias("quality"), F.array("g").alias("sources"))


def _pick(order: Callable[[], list[Column]], only: Callable[[], Column] | None = None) -> Callable[[DataFrame, Strategy], DataFrame]:
    """The one value that is greatest in the order; ties go to the smallest term."""

    def run(statements: DataFrame, strategy: Strategy) -> DataFrame:
        found = values(statements, strategy.cardinality == SINGLE)
        rest = None
        if only is not None:
            rest = found.where(~only())
            found = found.where(only())
        # min_by over (order, term): greatest order first, then the smallest term
        rank = F.struct(*[(-o).alias(f"r{i}") for i, o in enumerate(order())], term_key("co", "o"))
        best = found.groupBy(*KEY).agg(F.min_by(F.struct(*VALUE, "quality", "sources"), rank).alias("b")).select(*KEY, *[F.col(f"b.{c}").alias(c) for c in (*VALUE, "quality", "sources")])
        return best if rest is None or strategy.on_error == IGNORE else best.unionByName(rest.select(*OUT))

    return run


def _mediate(aggregate: Callable[[Strategy], Column], numeric: bool = True) -> Callable[[DataFrame, Strategy], DataFrame]:
    """One new value per cluster; its distance to every statement counts, also to those that cannot be aggregated."""

    def run(statements: DataFrame, strategy: Strategy) -> DataFrame:
        own = statements.withColumn("__x", _number(F.col("co"), F.col("o_kind")) if numeric else F.when(F.col("o_kind") == "literal", F.col("co")))
        new = own.where("__x is not null").groupBy(*KEY).agg(aggregate(strategy).alias("__v"), F.sort_array(F.collect_set("g")).alias("sources"), F.avg("score").alias("__score"))
        new = new.withColumn("co", F.col("__v").cast("string"))
        if strategy.cardinality == SINGLE:
            d = Q.distance(F.col("__new"), F.lit("literal"), F.col("co"), F.col("o_kind"))
            made = new.select(*KEY, F.col("co").alias("__new"))
            if CONFLICT in own.columns:
                made = made.join(own.select("cs", CONFLICT).distinct(), "cs")
                others = own.select(F.col(CONFLICT).alias("__c"), F.col("cp").alias("__p"), "co", "o_kind")
                compared = made.join(others, (F.col(CONFLICT) == F.col("__c")) & (F.col("cp") == F.col("__p")))
            else:
                compared = own.join(made, KEY)
            far = compared.groupBy(*KEY).agg((F.sum(d) / F.count("*")).alias("__far"))
            new = new.join(far, KEY).withColumn("quality", F.col("__score") * (1 - F.col("__far")))
        else:
            new = new.withColumn("quality", F.col("__score"))
        none = F.lit(None).cast("string")
        out = new.select(*KEY, "co", F.lit("literal").alias("o_kind"), (F.lit(XSD_DOUBLE) if numeric else none).alias("o_dt"), none.alias("o_lang"), "quality", "sources")
        if strategy.on_error != IGNORE:
            out = out.unionByName(values(own.where("__x is null"), strategy.cardinality == SINGLE).select(*OUT))
        return out

    return run


def _kept(condition: Callable[[Strategy], Column]) -> Callable[[DataFrame, Strategy], DataFrame]:
    return lambda statements, strategy: values(statements, strategy.cardinality == SINGLE).where(condition(strategy)).select(*OUT)


def _top(statements: DataFrame, strategy: Strategy) -> DataFrame:
    rank = Window.partitionBy(*KEY).orderBy(F.col("quality").desc(), "o_kind", "co", "o_dt", "o_lang")
    found = values(statements, strategy.cardinality == SINGLE).withColumn("__rank", F.row_number().over(rank))
    return found.where(F.col("__rank") <= int(strategy.params.get("n", "1"))).select(*OUT)


def _certain(statements: DataFrame, strategy: Strategy) -> DataFrame:
    """The value of clusters that have only one."""
    found = values(statements, strategy.cardinality == SINGLE)
    single = found.groupBy(*KEY).agg(F.count("*").alias("__k")).where("__k = 1").select(*KEY)
    return found.join(single, KEY, "left_semi").select(*OUT)


def _max_metadata(statements: DataFrame, strategy: Strategy) -> DataFrame:
    """The value of the source for which the metadata property is greatest; values without it come last."""
    said = statements.groupBy(*KEY, *VALUE).agg(F.max(Q.metadata_column(strategy.params["property"])).alias("said"))
    found = _join_values(values(statements, strategy.cardinality == SINGLE), said)
    rank = F.struct(F.col("said").isNull().alias("unsaid"), (-F.col("said")).alias("r"), term_key("co", "o"))
    best = found.groupBy(*KEY).agg(F.min_by(F.struct(*VALUE, "quality", "sources"), rank).alias("b"))
    return best.select(*KEY, *[F.col(f"b.{c}").alias(c) for c in (*VALUE, "quality", "sources")])


def _x() -> Column:
    return _number(F.col("co"), F.col("o_kind"))


def _is_number() -> Column:
    return _x().isNotNull()


REGISTRY: dict[str, Callable[[DataFrame, Strategy], DataFrame]] = {
    "ALL": _all,
    "NONE": _none,
    "BEST": _pick(lambda: [F.col("quality")]),
    "AVG": _mediate(lambda s: F.avg("__x")),
    # extensions
    "SUM": _mediate(lambda s: F.sum("__x")),
    "MEDIAN": _mediate(lambda s: F.median("__x")),
    "CONCAT": _mediate(lambda s: F.array_join(F.sort_array(F.collect_set("__x")), s.params.get("separator", "; ")), numeric=False),
    "MIN": _pick(lambda: [-_x()], _is_number),
    "MAX": _pick(lambda: [_x()], _is_number),
    "ANY": _pick(lambda: []),
    "RANDOM": _pick(lambda: [F.xxhash64("cs", "cp", "co").cast("double")]),
    "SHORTEST": _pick(lambda: [-F.length("co")]),
    "LONGEST": _pick(lambda: [F.length("co")]),
    "VOTE": _pick(lambda: [F.size("sources")]),
    "WEIGHTED_VOTE": _pick(lambda: [F.col("sum_score")]),
    "BEST_SOURCE": _pick(lambda: [F.col("max_score")]),
    "LATEST": _pick(lambda: [F.unix_micros(F.col("co").try_cast("timestamp"))], lambda: F.col("co").try_cast("timestamp").isNotNull()),
    "MAX_SOURCE_METADATA": _max_metadata,
    "TOPN": _top,
    "CERTAIN": _certain,
    "THRESHOLD": _kept(lambda s: F.col("quality") >= float(s.params.get("threshold", "0.5"))),
    "FILTER": _kept(lambda s: (_x() >= float(s.params.get("min", "-inf"))) & (_x() <= float(s.params.get("max", "inf")))),
    "CHOOSE_SOURCE": _kept(lambda s: F.array_contains("sources", s.params["source"])),
}


def register(name: str, build: Callable[[DataFrame, Strategy], DataFrame]) -> None:
    """A function of the user's own: build(statements, strategy) gives rows with the columns OUT."""
    REGISTRY[name.upper()] = build


def function(name: str) -> Callable[[DataFrame, Strategy], DataFrame]:
    try:
        return REGISTRY[name.upper()]
    except KeyError:
        raise ValueError(f"unknown resolution function {name}") from None
