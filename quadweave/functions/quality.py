"""Quality of fused values. Each assumption has a function of its own, so that it can be swapped.

Known: unknown sources score 0.5; for single-valued properties a value's quality falls
by the mean distance to all conflicting statements; N + 1 agreeing sources of score 1 give 1.
Assumed: what scores are taken for several sources, distances of strings and dates, the shape of the agreement bonus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN_SCORE = 0.5
AGREE_COEFFICIENT = 4.0
PUBLISHER_WEIGHT = 0.2
#: Scores that every task may hold: up to so many, quads stay where they are.
MOST_HELD = 400_000


def source_scores(quads: DataFrame, scores: DataFrame | None, unknown: float = UNKNOWN_SCORE) -> DataFrame:
    """quads with score: that of the graph, or unknown. Scores are counted to choose how they are joined."""
    if scores is None:
        return quads.withColumn("score", F.lit(unknown))
    own = scores.groupBy("g").agg(F.avg("score").alias("score"))
    if own.limit(MOST_HELD + 1).count() <= MOST_HELD:
        own = F.broadcast(own)
    return quads.join(own, "g", "left").withColumn("score", F.coalesce("score", F.lit(unknown)))


def metadata_scores(metadata: DataFrame, publisher_weight: float = PUBLISHER_WEIGHT) -> DataFrame:
    """(g, score) from statements about graphs: a graph's score, and the scores of its publishers.

    Predicates are told by their local names: score, publishedBy, publisherScore. Where both are known, the
    publishers' mean score has the share publisher_weight; a graph with publishers' scores alone has their mean.
    """
    def named(name: str) -> DataFrame:
        return metadata.where(F.col("p").rlike(f"[/#:]{name}$"))

    number = F.col("o").try_cast("double").alias("x")
    own = named("score").select(F.col("s").alias("g"), number).where("x is not null").groupBy("g").agg(F.avg("x").alias("own"))
    publishers = named("publisherScore").select(F.col("s").alias("who"), number).where("x is not null")
    by = named("publishedBy").select(F.col("s").alias("g"), F.col("o").alias("who")).distinct().join(publishers, "who").groupBy("g").agg(F.avg("x").alias("theirs"))
    both = own.join(by, "g", "full")
    mixed = F.col("own") * (1 - publisher_weight) + F.col("theirs") * publisher_weight
    return both.select("g", F.coalesce(mixed, "own", "theirs").alias("score"))


def metadata_column(name: str) -> str:
    return f"__meta_{name}"


def source_metadata(statements: DataFrame, metadata: DataFrame | None, name: str) -> DataFrame:
    """statements with a column of what metadata says of their graphs by the property: the greatest value, numbers as such."""
    column = metadata_column(name)
    if metadata is None:
        return statements.withColumn(column, F.lit(None).cast("double"))
    value = F.coalesce(F.col("o").try_cast("double"), F.col("o").try_cast("timestamp").cast("double"))
    said = metadata.where(F.col("p") == name).groupBy(F.col("s").alias("g")).agg(F.max(value).alias(column))
    return statements.join(said, "g", "left")


def numeric_distance(x: Column, y: Column) -> Column:
    """|x - y| over the absolute mean, at most 1."""
    mean = F.abs((x + y) / 2)
    return F.when(x == y, 0.0).when(mean == 0, 1.0).otherwise(F.least(F.lit(1.0), F.abs(x - y) / F.when(mean != 0, mean)))


def text_distance(x: Column, y: Column) -> Column:
    """Edit distance over the longer length; equal texts 0."""
    return F.when(x == y, 0.0).otherwise(F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)))


#: Fixed value: seconds between two dates that are as far apart as can be.
MAX_DATE_SECONDS = 31_622_400


def date_distance(x: Column, y: Column) -> Column:
    """Seconds between two times over MAX_DATE_SECONDS, at most 1."""
    return F.least(F.lit(1.0), F.abs(F.unix_micros(x) - F.unix_micros(y)) / F.lit(MAX_DATE_SECONDS * 1e6))


def _time(x: Column, kind: Column) -> Column:
    return F.when((kind == "literal") & x.rlike(r"^-?\d{4}-\d{2}-\d{2}(T|$)"), x.try_cast("timestamp"))


def number(value: Column, kind: Column) -> Column:
    return F.when(kind == "literal", value.try_cast("double"))


def distance(x: Column, x_kind: Column, y: Column, y_kind: Column, nx: Column | None = None, ny: Column | None = None) -> Column:
    """0 to 1 between two terms: numbers by size, dates by seconds, other literals by edits, all else equal or not.

    nx and ny are the terms as numbers, if they are known.
    """
    nx, ny = number(x, x_kind) if nx is None else nx, number(y, y_kind) if ny is None else ny
    numeric = nx.isNotNull() & ny.isNotNull()
    mixed = nx.isNotNull() | ny.isNotNull() | (x_kind != y_kind) | (x_kind != "literal")
    return F.when((x == y) & (x_kind == y_kind), 0.0).when(numeric, numeric_distance(nx, ny)).when(mixed, 1.0).otherwise(F.coalesce(date_distance(_time(x, x_kind), _time(y, y_kind)), text_distance(x, y)))


def agreement(quality: Column, sum_score: Column, max_score: Column, n: float = AGREE_COEFFICIENT) -> Column:
    """Quality raised by the scores of further sources that agree."""
    return quality + (1 - quality) * F.least(F.lit(1.0), (sum_score - max_score) / n)
