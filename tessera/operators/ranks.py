"""Row positions: last wins, last n, nearest-rank percentiles.

A group may hold a third of all rows, so nothing here sorts a whole group in one task. ``row_number``
filters of the form ``<= n`` are cut to n rows per task before the shuffle by Spark itself. Exact
percentiles are selected by counting in passes over the values: a histogram over magnitude buckets, which every task
makes of its own rows, finds the bucket that holds the wanted rank; a finer one of that bucket's rows follows, then the
few distinct values left. Only histograms are shuffled, so the shuffle does not grow with the number of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

#: Targets (groups times percentiles) up to which a list of wanted buckets is broadcast, after it has been counted.
BROADCAST_TARGETS = 10_000

_COARSE_BITS = 8
_COARSE = 2**_COARSE_BITS  # buckets per factor of two
_FINE = 65536  # buckets per coarse bucket


def keep_first(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of every group in the given order."""
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("__rn") <= n).drop("__rn")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the one written last."""
    return keep_first(df, [key], [F.col(order).desc()])


def last_n(df: DataFrame, order: list[Column], n: int = 100) -> DataFrame:
    """The newest ``n`` rows overall; each task keeps its own n first."""
    return df.orderBy(*order).limit(n)


def log_tail(df: DataFrame, job: str = "job_id", line_no: str = "line_no", n: int = 100) -> DataFrame:
    return keep_first(df, [job], [F.col(line_no).desc()], n)


def _bucketed(df: DataFrame) -> DataFrame:
    """Add two-level bucket numbers that grow with ``__v``.

    ``__b1`` is the exponent and the leading digits of the magnitude, so there are at most about a million
    of them whatever the data; ``__b2`` splits such a bucket evenly. If ``log2`` rounds across a power of
    two, the same bucket results from either exponent. One column per step: each is evaluated once.
    """
    sign = "CASE WHEN __v < 0 THEN -1 ELSE 1 END"
    return (
        df.selectExpr("*", "abs(__v) AS __m")
        .selectExpr("*", "CAST(greatest(coalesce(floor(log2(nullif(__m, 0D))), -1000L), -1000L) AS DOUBLE) AS __e")
        .selectExpr("*", f"__m * power(2D, {_COARSE_BITS} - __e) AS __u")
        .selectExpr("*", "CAST(floor(__u) AS DOUBLE) AS __f")
        # Declared non-null: a null test on a join key would be pushed into the scan with all of this inlined.
        .selectExpr(
            "*",
            f"coalesce(CAST({sign} * ((__e + 1001) * {_COARSE} + __f) AS BIGINT), 0L) AS __b1",
            f"coalesce(CAST({sign} * floor((__u - __f) * {_FINE}) AS BIGINT), 0L) AS __b2",
        )
        .drop("__m", "__e", "__u", "__f")
    )


def _match(rows: DataFrame, targets: DataFrame, keys: list[str], exact: list[str]) -> DataFrame:
    """Inner join in which null group keys match each other."""
    renamed = targets.withColumnsRenamed({k: f"__t_{k}" for k in [*keys, *exact]})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    for k in exact:
        condition = condition & (F.col(k) == F.col(f"__t_{k}"))
    return rows.join(renamed, condition).drop(*[f"__t_{k}" for k in [*keys, *exact]])


def rank_percentiles(df: DataFrame, value: str, probs: dict[str, float], by: tuple[str, ...] = ()) -> DataFrame:
    """Exact nearest-rank values: the element at index ``floor(n * p)`` of the sorted group, never interpolated.

    The index is clamped to the last element. Result: ``by`` columns and one column per entry of
    ``probs``. Nulls, NaN and infinities are ignored. Windows only ever see histograms (at most about a
    million rows per group), one coarse bucket's histogram, or the distinct values of one fine bucket.
    """
    keys = list(by)
    v = F.col(value).cast("double")
    numbers = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, (v + 0.0).alias("__v"))
    rows = _bucketed(numbers.withColumn("__n", F.lit(1).cast("bigint")))

    # Level 1: which coarse bucket holds each wanted rank.
    group = W.partitionBy(*keys)
    level1 = (
        rows.groupBy(*keys, "__b1").agg(F.sum("__n").alias("__n"))
        .withColumn("__total", F.sum("__n").over(group))
        .withColumn("__to", F.sum("__n").over(group.orderBy("__b1")))
    )
    ranks = F.array(
        *[
            F.struct(
                F.lit(name).alias("p"),
                F.least(F.floor(F.col("__total") * F.lit(float(p))), F.col("__total") - 1).cast("bigint").alias("rank"),
            )
            for name, p in probs.items()
        ]
    )
    start = F.col("__to") - F.col("__n")
    inside = F.filter(ranks, lambda r: (r["rank"] >= start) & (r["rank"] < F.col("__to")))
    at1 = level1.select(*keys, "__b1", start.alias("__before"), F.explode(inside).alias("__w")).select(
        *keys, "__b1", F.col("__w")["p"].alias("__p"), (F.col("__w")["rank"] - F.col("__before")).alias("__rank")
    )

    def locate(histogram: DataFrame, groups: list[str], order: str) -> DataFrame:
        """The entry of each group whose running count passes ``__rank``, and the rank inside it."""
        running = histogram.withColumn("__to", F.sum("__n").over(W.partitionBy(*groups).orderBy(order)))
        before = F.col("__to") - F.col("__n")
        return running.where((F.col("__rank") >= before) & (F.col("__rank") < F.col("__to"))).select(
            *groups, order, (F.col("__rank") - before).alias("__rank")
        )

    # Level 2: only rows of the buckets that hold a wanted rank.
    narrowed = _match(rows, _counted(at1, "rank-buckets"), keys, ["__b1"])
    at_keys = [*keys, "__p"]
    level2 = narrowed.groupBy(*at_keys, "__b2").agg(F.sum("__n").alias("__n"), F.first("__rank").alias("__rank"))
    at2 = locate(level2, at_keys, "__b2")

    # Level 3: the distinct values of one fine bucket.
    inside_fine = _match(narrowed.drop("__rank"), _counted(at2, "rank-values"), keys, ["__p", "__b2"])
    level3 = inside_fine.groupBy(*at_keys, "__v").agg(F.sum("__n").alias("__n"), F.first("__rank").alias("__rank"))
    found = locate(level3, at_keys, "__v")
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__p") == name, F.col("__v"))).alias(name) for name in probs]
    )


def _counted(targets: DataFrame, label: str) -> DataFrame:
    """Targets as a local table to broadcast if they turn out to be few; written once and joined by a shuffle if not."""
    few = targets.limit(BROADCAST_TARGETS + 1).collect()
    if len(few) <= BROADCAST_TARGETS:
        return F.broadcast(targets.sparkSession.createDataFrame(few, targets.schema))
    return materialize(targets, label).hint("merge")
