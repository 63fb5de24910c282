"""Percentiles, paired tests and agreement as aggregates over DataFrames."""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.sources.shared import materialise


def percentile(values: str, pct: float) -> Column:
    """Linear interpolation, exact."""
    if not 0 <= pct <= 100:
        raise ValueError(f"percentile {pct} is out of range")
    return F.percentile(values, pct / 100)


#: Bins that a range of values is cut into, and the values that are put in order in one place at most.
BINS, SMALL = 4096, 20_000
_MOST = 1.7976931348623157e308


def percentiles(rows: DataFrame, value: str, points: Sequence[float], *by: str) -> DataFrame:
    """The groups, n, max and p<point> of each group: exact, by linear interpolation, for groups of any size.

    Counts in bins of a group's range tell in which bin a rank lies; the bin's own range is cut again until
    it holds SMALL values or one value alone. Ranges are cut by logarithm and evenly in turn, so values of
    any spread take few rounds. So a task keeps BINS counts a range and group, and no list
    or map of a group's values is gathered. Null and NaN are left out, infinite values count as the
    greatest finite ones.
    """
    if any(not 0 <= p <= 100 for p in points):
        raise ValueError(f"a percentile of {list(points)} is out of range")
    v = F.col(value).cast("double")
    group = F.struct(*(F.col(c) for c in by)) if by else F.struct(F.lit(0).alias("all"))
    base = rows.where(v.isNotNull() & ~F.isnan(v)).select(group.alias("g"), F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), v)).alias("v"))
    base = materialise(base, "percentile-values")
    sizes = materialise(base.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "percentile-groups")
    at = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), (F.lit(p / 100) * (F.col("n") - 1)).alias("at")) for p in points)))
    wanted = sizes.select("g", "n", at.alias("w")).select("g", "w.p", "w.at", F.floor("w.at").alias("low"), F.least(F.floor("w.at") + 1, F.col("n") - 1).alias("high"))
    ranks = wanted.select("g", F.explode(F.array("low", "high")).alias("k")).distinct()
    still = ranks.join(sizes, "g").select("g", "k", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("c"))
    found = None
    part = ["lo", "hi", "below"]
    scaled = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 750))  # noqa: E731  rises with the value; no logarithm is below -745
    for turn in itertools.count():
        still = materialise(still, "percentile-ranges")
        one = still.where("lo = hi").select("g", "k", F.col("lo").alias("v"))
        found = one if found is None else found.unionByName(one)
        still = still.where("lo < hi")
        most = still.agg(F.max("c")).first()[0]
        if most is None:
            break
        inside = base.join(still.select("g", *part).distinct(), "g").where(F.col("v").between(F.col("lo"), F.col("hi")))
        if most <= SMALL:
            lists = inside.groupBy("g", *part).agg(F.sort_array(F.collect_list("v")).alias("l"))
            found = found.unionByName(still.join(lists, ["g", *part]).select("g", "k", F.get("l", (F.col("k") - F.col("below")).cast("int")).alias("v")))
            break
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        if turn % 2 == 0:
            share = F.when(scaled("hi") > scaled("lo"), (scaled("v") - scaled("lo")) / (scaled("hi") - scaled("lo"))).otherwise(share)
        bins = inside.groupBy("g", *part, F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        upto = F.sum("n").over(Window.partitionBy("g", *part).orderBy("bin"))
        bins = bins.withColumn("before", F.col("below") + upto - F.col("n"))
        hit = still.select("g", "k", *part).join(bins, ["g", *part]).where((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("n")))
        still = hit.select("g", "k", F.col("a").alias("lo"), F.col("z").alias("hi"), F.col("before").alias("below"), F.col("n").alias("c"))
    found = materialise(found, "percentile-found")
    pick = lambda name: found.select("g", F.col("k").alias(name), F.col("v").alias(f"v_{name}"))
    rows = wanted.join(pick("low"), ["g", "low"]).join(pick("high"), ["g", "high"])
    values = rows.withColumn("v", F.col("v_low") + (F.col("v_high") - F.col("v_low")) * (F.col("at") - F.col("low")))
    made = values.groupBy("g").agg(*(F.max(F.when(F.col("p") == float(p), F.col("v"))).alias(f"p{p}") for p in points))
    return sizes.select("g", "n", F.col("hi").alias("max")).join(made, "g").select(*(F.col("g")[c].alias(c) for c in by), "n", *(f"`p{p}`" for p in points), "max")


def report_percentiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, p50, p95 (from 20 values), p99 (from 100) and max of each group with a value."""
    out = percentiles(rows, value, (50, 95, 99), *by)
    return out.withColumns({"p95": F.when(F.col("n") >= 20, F.col("p95")), "p99": F.when(F.col("n") >= 100, F.col("p99"))})


def mcnemar(base: DataFrame, arm: DataFrame, key: str, hit: str) -> DataFrame:
    """(n_pairs, base_only, arm_only, p_value): the exact two-sided McNemar test of two paired arms."""
    pairs = base.select(key, F.col(hit).alias("b")).join(arm.select(key, F.col(hit).alias("a")), key)
    counts = pairs.agg(F.count("*").alias("n_pairs"), F.count_if(F.col("b") & ~F.col("a")).alias("base_only"), F.count_if(~F.col("b") & F.col("a")).alias("arm_only"))
    n, k = F.col("base_only") + F.col("arm_only"), F.least("base_only", "arm_only")
    # tail of the binomial by its recurrence, in logs; the list has as many terms as the smaller count
    zero = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1).cast("double")) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(terms, zero, step, lambda a: a["sum"])
    return counts.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def kappa(pairs: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """(n, observed, expected, kappa) of two ratings; null below ``least`` pairs, 1 if chance explains all."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    side = lambda c, name: cells.groupBy(F.col(c).alias("bin")).agg(F.sum("n").alias(name))
    chance = side("a", "na").join(side("b", "nb"), "bin").agg(F.sum(F.col("na") * F.col("nb")).alias("chance"))
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    # two one-row tables
    rows = total.withColumn("one", F.lit(1)).join(chance.withColumn("one", F.lit(1)), "one")
    observed, expected = F.try_divide("same", "n"), F.try_divide(F.coalesce("chance", F.lit(0)).cast("double"), F.col("n").cast("double") * F.col("n"))
    value = F.when(expected == 1, 1.0).otherwise(F.try_divide(observed - expected, 1 - expected))
    return rows.select("n", observed.alias("observed"), expected.alias("expected"), F.when(F.col("n") >= least, value).alias("kappa"))


def bootstrap(values: DataFrame, value: str, draws: int = 2000, seed: int = 7) -> DataFrame:
    """(low, high): the values at 2.5 and 97.5 percent of the means of ``draws`` resamples.

    Each row is drawn a Poisson(1) number of times in each resample. n rows of one value are drawn a
    Poisson(n) number of times together, so equal rows stay independent and are counted first. A task
    sums its values' draws for all resamples and hands on one row for each; the draws of a value hang on
    the value and the seed alone, so the interval does not depend on how the rows are dealt.
    """
    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("h", F.xxhash64("v", F.lit(seed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, times = np.zeros(draws), np.zeros(draws, np.int64)
        for batch in batches:
            for v, n, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                drawn = np.random.Generator(np.random.Philox(key=h & ((1 << 64) - 1))).poisson(n, draws)
                total += v * drawn
                times += drawn
        if times.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(times)], ["i", "total", "times"])

    drawn = counted.mapInArrow(run, "i long, total double, times long")
    means = drawn.groupBy("i").agg(F.try_divide(F.sum("total"), F.sum("times")).alias("m")).where("m IS NOT NULL")
    order = means.withColumn("r", F.row_number().over(Window.orderBy("m", "i")) - 1)
    return order.agg(F.max(F.when(F.col("r") == draws * 25 // 1000, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == draws * 975 // 1000, F.col("m"))).alias("high"))
