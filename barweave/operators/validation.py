"""Leak-free splits and sample weights for overlapping labels (rows: id, asof, exit_date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import tile_of


def sweep(spans: DataFrame) -> DataFrame:
    """day, until, load, before: the stretches of days over which the number of covering spans is the same, with the sum of 1 / load
    over all days before the stretch.

    Every span is two events, one more at its first day and one less after its last, so the work doesn't depend on the spans'
    lengths. Events are summed up per day before they are ordered: at most a row for each day of the calendar.
    """
    first, last = F.least("asof", "exit_date"), F.greatest("asof", "exit_date")
    known = spans.filter("asof is not null and exit_date is not null")
    events = known.select(F.explode(F.array(F.struct(first.alias("day"), F.lit(1).alias("step")), F.struct(F.date_add(last, 1).alias("day"), F.lit(-1).alias("step")))).alias("e"))
    days = events.groupBy("e.day").agg(F.sum("e.step").alias("step"))
    w = Window.orderBy("day")  # days of the calendar
    run = days.select("day", F.lead("day").over(w).alias("until"), F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("load"))
    part = F.when(F.col("load") > 0, F.datediff("until", "day") / F.col("load")).otherwise(0.0)
    return run.select("*", F.coalesce(F.sum(part).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))


def daily_load(spans: DataFrame) -> DataFrame:
    """day, load: the number of spans that cover each day with one at least."""
    return sweep(spans).filter("load > 0").select(F.explode(F.sequence("day", F.date_sub("until", 1))).alias("day"), "load")


def span_means(spans: DataFrame) -> DataFrame:
    """id, raw: mean of 1 / load over the days of each span (both ends known), by two lookups in the running sum."""
    return _with_means(spans).select("id", "raw")


def _with_means(spans: DataFrame) -> DataFrame:
    at = F.broadcast(sweep(spans).select("day", "before"))  # days of the calendar
    first, last = F.least("asof", "exit_date"), F.greatest("asof", "exit_date")
    s = spans.filter("asof is not null and exit_date is not null").select("*", first.alias("_a"), F.date_add(last, 1).alias("_z"))
    s = s.join(at.select(F.col("day").alias("_a"), F.col("before").alias("_from")), "_a").join(at.select(F.col("day").alias("_z"), F.col("before").alias("_to")), "_z")
    return s.select(*spans.columns, ((F.col("_to") - F.col("_from")) / F.datediff("_z", "_a")).alias("raw"))


def uniqueness_weights(spans: DataFrame) -> DataFrame:
    """id, weight: mean over the span's days of 1 / number of spans that cover the day, scaled to mean one."""
    return with_weights(spans).select("id", "weight")


def with_weights(spans: DataFrame) -> DataFrame:
    """``spans`` (those with both ends known) with their weight, looked up where each row lies: nothing is joined by id."""
    raw = _with_means(spans)
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.join(F.broadcast(mean)).select(*spans.columns, (F.col("raw") / F.col("mean")).alias("weight"))


def _dealt(spans: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``spans`` with ``own``, their part (from 1) of ``k`` even ones by (asof, id), and the parts' bounds (fold, lo, hi). Rows are counted
    by day, and only in days in which one part ends and another begins are they ordered by id."""
    w = Window.orderBy("_day")  # days of the calendar
    days = spans.groupBy(F.col("asof").alias("_day")).agg(F.count("*").alias("_n"))
    days = days.select("_day", (F.sum("_n").over(w) - F.col("_n")).alias("_before"), "_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    tile = lambda row: tile_of(row, F.col("_total"), k)
    days = days.select("*", tile(F.col("_before") + 1).alias("_first"), tile(F.col("_before") + F.col("_n")).alias("_last"))
    bounds = days.select(F.explode(F.sequence("_first", "_last")).alias("fold"), "_day").groupBy("fold").agg(F.min("_day").alias("lo"), F.max("_day").alias("hi"))  # k rows
    j = spans.join(F.broadcast(days), F.col("asof").eqNullSafe(F.col("_day")))
    inner = F.row_number().over(Window.partitionBy("asof").orderBy("id"))
    cut = j.filter("_first != _last").withColumn("_row", F.col("_before") + inner)
    whole = j.filter("_first = _last").select(*spans.columns, F.col("_first").alias("own"))
    return whole.unionByName(cut.select(*spans.columns, tile(F.col("_row")).alias("own"))), bounds


def _purge(fold, lo, hi, embargo_days: int):
    """test, train or null of a row (own, asof, exit_date) in a fold."""
    overlap = (F.col("asof") <= hi) & (F.col("exit_date") >= lo)
    waits = (F.col("asof") > hi) & (F.col("asof") <= F.date_add(hi, embargo_days))
    return F.when(F.col("own") == fold, "test").when(~overlap & ~waits, "train")


def purged_folds(spans: DataFrame, k: int = 5, embargo_days: int = 25) -> DataFrame:
    """fold, id, part: contiguous folds by (asof, id); a training row whose span touches the test range, or that
    starts within the embargo after it, is left out."""
    dealt, bounds = _dealt(spans, k)
    j = dealt.crossJoin(F.broadcast(bounds))
    return j.select("fold", "id", _purge(F.col("fold"), F.col("lo"), F.col("hi"), embargo_days).alias("part")).filter("part is not null")


def with_parts(rows: DataFrame, k: int = 5, embargo_days: int = 25) -> DataFrame:
    """``rows`` with ``parts``, their part in every one of ``purged_folds`` (1 train, 2 test, 0 neither), told where each row lies."""
    dealt, bounds = _dealt(rows, k)
    known = bounds.orderBy("fold").collect()  # k rows
    return dealt.select(*rows.columns, F.array(*[_marks(_purge(F.lit(b.fold), F.lit(b.lo), F.lit(b.hi), embargo_days)) for b in known]).cast("array<int>").alias("parts"))


def _marks(part):
    return F.when(part == "test", 2).when(part == "train", 1).otherwise(0)


def _windows(spans: DataFrame, warmup: int, test_days: int, step: int) -> DataFrame:
    ends = spans.agg(F.min("asof").alias("first"), F.max("asof").alias("last"))
    return ends.select(F.posexplode(F.expr(f"filter(sequence(date_add(first, {warmup}), greatest(last, date_add(first, {warmup})), interval {step} days), d -> date_add(d, {test_days}) <= last)")).alias("fold", "start"))


def walk_forward(spans: DataFrame, warmup: int = 1095, test_days: int = 180, step: int = 90, embargo: int = 15, least_train: int = 100, least_test: int = 20) -> DataFrame:
    """fold, id, part of a growing training window and a sliding test window; folds with too few rows are left out."""
    starts = _windows(spans, warmup, test_days, step)
    j = spans.join(F.broadcast(starts), (F.col("asof") <= F.date_sub("start", embargo)) | ((F.col("asof") >= F.col("start")) & (F.col("asof") < F.date_add("start", test_days))))
    rows = j.select("fold", "id", F.when(F.col("asof") >= F.col("start"), "test").otherwise("train").alias("part"))
    sizes = rows.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("tr"), F.count_if(F.col("part") == "test").alias("te")).filter((F.col("tr") > least_train) & (F.col("te") > least_test))
    return rows.join(F.broadcast(sizes.select("fold")), "fold")


def with_walk(rows: DataFrame, warmup: int = 1095, test_days: int = 180, step: int = 90, embargo: int = 15, least_train: int = 100, least_test: int = 20) -> DataFrame:
    """``rows`` with ``parts``, their part in every fold of ``walk_forward`` (1 train, 2 test, 0 neither), told where each row lies."""
    starts = _windows(rows, warmup, test_days, step).orderBy("fold").collect()  # a row per fold
    begins = [F.lit(r.start) for r in starts]
    part = [F.when((F.col("asof") >= s) & (F.col("asof") < F.date_add(s, test_days)), 2).when(F.col("asof") <= F.date_sub(s, embargo), 1).otherwise(0) for s in begins]
    sizes = rows.agg(*[F.count_if(p == m).alias(f"{m}_{i}") for i, p in enumerate(part) for m in (1, 2)]).first() if part else {}
    kept = [p for i, p in enumerate(part) if sizes[f"1_{i}"] > least_train and sizes[f"2_{i}"] > least_test]
    return rows.withColumn("parts", F.array(*kept).cast("array<int>"))
