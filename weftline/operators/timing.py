"""Latency statistics: exact percentiles by selection, and running figures of a run in parts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import Tables

#: Bins of one pass of a selection, and parts that rows of running figures are ordered in.
BINS, PARTS = 4096, 64


def time_stats(df: DataFrame, value: str, *by: str) -> DataFrame:
    """n, avg, median, p95, min and max; percentiles are exact, with linear interpolation. Nulls are left out."""
    tables = Tables(df.sparkSession, "stats")
    rows = tables.put(df.select(*by, F.col(value).cast("double").alias("__x")))
    stats = rows.groupBy(*by).agg(F.count("__x").alias("n"), F.avg("__x").alias("avg"), F.min("__x").alias("min"), F.max("__x").alias("max"))
    found = percentiles(rows, "__x", by, {"median": 0.5, "p95": 0.95}, tables)
    same = [stats[c].eqNullSafe(found[c]) for c in by] or [F.lit(True)]  # without groups one row each
    return stats.join(found, same, "left").select(*(stats[c] for c in by), "n", "avg", "median", "p95", "min", "max")


def percentiles(df: DataFrame, value: str, by: tuple[str, ...], wanted: dict[str, float], tables: Tables | None = None) -> DataFrame:
    """by and a column for each wanted percentile (from 0 to 1) of a double column, null for groups without values.

    Each pass counts, for every order statistic that is looked for, the values in bins of the range it lies in, and keeps the
    bin that holds its rank, until a bin's least and largest value are one. So no task sees the values of a group, or a map
    of them; a pass narrows a range by BINS, and only counts by bin are shuffled. NaN is above all numbers.
    """
    tables = tables or Tables(df.sparkSession, "percentiles")
    key = [f"__k{i}" for i in range(len(by))] or ["__all"]
    rows = df.select(*(F.col(c).alias(k) for c, k in zip(by, key, strict=False)), *([] if by else [F.lit(0).alias("__all")]), F.col(value).alias("x")).filter("x is not null")
    finite = F.when(F.isnan("x") | (F.abs("x") == math.inf), None).otherwise(F.col("x"))
    n = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    n = tables.put(n)
    place = lambda p: (F.col("n") - 1) * F.lit(float(p))
    ranks = F.array_distinct(F.array(*(f(place(p)).cast("long") for p in wanted.values() for f in (F.floor, F.ceil))))
    open_ = n.select(*key, F.explode(ranks).alias("rank"), F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("high", F.lit(0.0)).alias("high"), F.lit(0).cast("long").alias("before"))
    settled, first = None, True
    while True:
        t = open_.select(*(F.col(k).alias("t" + k) for k in key), "rank", "low", "high", "before")
        inside = F.lit(True) if first else F.col("x").between(F.col("low"), F.col("high"))
        met = rows.join(t, [*(F.col(k).eqNullSafe(F.col("t" + k)) for k in key), inside])
        # halves of large numbers, as the difference of two doubles may be none
        half = F.when(F.greatest(F.abs("low"), F.abs("high")) > 1e300, 0.5).otherwise(1.0)
        share = F.try_divide(F.col("x") * half - F.col("low") * half, F.col("high") * half - F.col("low") * half)
        plain = F.when(F.col("low") == F.col("high"), 0).otherwise(F.least(F.lit(BINS - 1), F.floor(share * BINS)))
        place_in = F.when(F.isnan("x"), BINS + 1).when(F.col("x") == math.inf, BINS).when(F.col("x") == -math.inf, -1).otherwise(plain)
        bins = met.groupBy(*key, "rank", "before", place_in.cast("int").alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = Window.partitionBy(*key, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = bins.withColumn("upto", F.col("before") + F.sum("m").over(upto))
        hit = bins.filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("m") <= F.col("rank")))
        hit = tables.put(hit.select(*key, "rank", "low", "high", (F.col("upto") - F.col("m")).alias("before")))
        done = hit.filter("low = high").select(*key, "rank", F.col("low").alias("value"))
        settled = done if settled is None else settled.unionByName(done)
        open_, first = hit.filter("low != high"), False
        if open_.isEmpty():
            break
    held = settled.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("held"))
    both = n.select(*(F.col(k).alias("n" + k) for k in key), "n").join(held, [F.col("n" + k).eqNullSafe(F.col(k)) for k in key])

    def between(p: float) -> Column:
        low, high = F.floor(place(p)).cast("long"), F.ceil(place(p)).cast("long")
        a, b = F.element_at("held", low), F.element_at("held", high)
        return F.when(low == high, a).otherwise((high - place(p)) * a + (place(p) - low) * b)

    out = both.select(*(F.col(k).alias(c) for c, k in zip(by, key, strict=False)), *(between(p).alias(name) for name, p in wanted.items()))
    if by:
        return out
    # without a group there is one row, values or not
    return out.agg(*(F.first(name).alias(name) for name in wanted))


def running_stats(df: DataFrame, run: str, order: str, value: str, total: int | None = None, previous: DataFrame | None = None) -> DataFrame:
    """Adds done, running_avg, running_min and running_max of a run so far, and eta, the mean times the rows that are left of total (default: the run's own).

    Rows of null value, as skipped ones, are done but have no figures; while a run has none, those of the run before count,
    which previous holds for each run (run, avg, min, max), else null, and an eta of 0. order is a number, without
    repeats in a run. Runs are cut at quantiles of order into parts; figures are taken inside each part and added to those
    of the parts before, so one long run is many tasks.
    """
    cuts = df.agg(F.percentile_approx(F.col(order).cast("double"), [i / PARTS for i in range(1, PARTS)], 1000).alias("c")).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("__part", F.coalesce(part, F.lit(0)).cast("int"))
    sums = d.groupBy(F.col(run).alias("__run"), F.col("__part").alias("__p")).agg(F.count("*").alias("__rows"), F.count(value).alias("__n"), F.sum(value).alias("__sum"), F.min(value).alias("__min"), F.max(value).alias("__max"))
    earlier = Window.partitionBy("__run").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__run")
    sums = sums.select("__run", "__p", F.sum("__rows").over(whole).alias("__all"), *(f(c).over(earlier).alias(c) for f, c in ((F.sum, "__rows"), (F.sum, "__n"), (F.sum, "__sum"), (F.min, "__min"), (F.max, "__max"))))
    so_far = Window.partitionBy(run, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = {"__i_rows": F.count("*"), "__i_n": F.count(value), "__i_sum": F.sum(value), "__i_min": F.min(value), "__i_max": F.max(value)}
    d = d.withColumns({k: f.over(so_far) for k, f in inside.items()}).join(sums, [F.col(run).eqNullSafe(F.col("__run")), F.col("__part") == F.col("__p")])
    both = lambda c: F.coalesce(F.col("__i_" + c), F.lit(0)) + F.coalesce(F.col("__" + c), F.lit(0))
    figures = {"avg": F.try_divide(both("sum"), both("n")), "min": F.least("__i_min", "__min"), "max": F.greatest("__i_max", "__max")}
    if previous is not None:
        before = previous.select(F.col(run).alias("__of"), *(F.col(c).alias("__was_" + c) for c in figures))
        d = d.join(before, F.col("__of").eqNullSafe(F.col(run)), "left")
        figures = {c: F.coalesce(f, F.col("__was_" + c)) for c, f in figures.items()}
    n = F.col("__all") if total is None else F.lit(total)
    d = d.withColumn("done", both("rows")).withColumns({"running_" + c: f for c, f in figures.items()})
    eta = F.coalesce(F.col("running_avg"), F.lit(0)) * F.greatest(n - F.col("done"), F.lit(0))
    return d.withColumn("eta", eta).select(*df.columns, "done", *("running_" + c for c in figures), "eta")
