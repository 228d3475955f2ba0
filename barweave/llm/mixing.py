"""Mixing sources to target weights by entropy balancing, by DataFrame functions only.

Each source gets a token target. Document rates are the bounded exponential tilt
``rate = 2 / (1 + exp(-lam * size / scale))`` with one multiplier ``lam`` per source, the maximum-entropy
rates in (0, 2) that meet the source's token constraint. Rates depend on (source, size) only,
so the convex dual is solved on the counts of those cells: every Newton step (safeguarded by a
bracket) is one distributed aggregation of gradient and curvature. The rates are then rounded
into whole copies, cell by cell with a running remainder, and single copies of small documents
settle what is left; inside a cell copies are dealt by hash order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, fits, word_count, written

CAP = 2  # no document is taken more often
MAX_STEPS, TOLERANCE, FARTHEST = 128, 1e-7, 1e15


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """source, source_size, target from source, source_size: weights by code point order (null
    last), targets capped at CAP times the size, the excess reshared by weight."""
    rank = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))  # a row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(rank) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("most", (F.col("source_size") * CAP).cast("double"))
    t = t.withColumn("want", F.lit(share) * F.sum("source_size").over(Window.partitionBy()))
    # fill water from the smallest cap per weight: a source is full if the level of those not yet full reaches its cap
    up = Window.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), "source")
    t = t.withColumn("done", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("left_w", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("full", F.col("most") / F.col("w") <= (F.col("want") - F.col("done")) / F.col("left_w"))
    every = Window.partitionBy()
    level = (F.col("want") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) / F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(every)
    return t.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level).alias("target"))


def _newton(cells: DataFrame, state: DataFrame, hint) -> DataFrame:
    """One Newton step of every open source's dual; a written table.

    The gradient is monotone, so each step moves an end of the bracket. An end that is not known yet is looked for by
    doubling, as the multiplier of a source whose mass lies in documents far from its mean size can be of any size. Sums are
    decimals: the same in any order, so reruns take the same steps.
    """
    r = F.lit(float(CAP)) / (1 + F.exp(-F.col("lam") * F.col("x")))
    z = F.col("size") * F.col("n")
    exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")
    keys = ["s", "target", "lam", "lo", "hi", "done"]
    sums = (
        cells.join(hint(state), F.col("source").eqNullSafe(F.col("s")))
        .select(*keys, (z * r).alias("f"), (z * F.col("x") * r * (1 - r / CAP)).alias("g"))
        .groupBy(*keys).agg(exact(F.col("f")).alias("f"), exact(F.col("g")).alias("g"))
    )
    over, size = F.col("f") > F.col("target"), F.greatest(F.abs("lam"), F.lit(1.0))
    t = sums.withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi"))).withColumn("lo", F.when(over, F.col("lo")).otherwise(F.col("lam")))
    step = F.col("lam") - F.try_divide(F.col("f") - F.col("target"), F.col("g"))
    lowest, highest = F.coalesce("lo", F.col("lam") - 2 * size), F.coalesce("hi", F.col("lam") + 2 * size)
    outward = F.when(F.col("hi").isNull(), highest).when(F.col("lo").isNull(), lowest).otherwise((F.col("lo") + F.col("hi")) / 2)
    inside = step.isNotNull() & (step > lowest) & (step < highest)
    off = F.abs(F.col("f") - F.col("target")) / F.greatest("target", F.lit(1.0))
    narrow = F.coalesce(F.col("hi") - F.col("lo") <= 1e-13 * F.greatest(F.abs("lo"), F.abs("hi")), F.lit(False))
    far = F.abs("lam") > F.lit(FARTHEST)  # the bound of the rates: all of a source, or none of it
    done = F.col("done") | (off < TOLERANCE) | narrow | far
    return written(t.select("s", "target", F.when(done, F.col("lam")).when(inside, step).otherwise(outward).alias("lam"), "lo", "hi", done.alias("done")), "mix_state")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5) -> DataFrame:
    """``docs`` with size, source_size (long), target (double), copies (int) and taken (long) added.

    Defined cases: a null text has size 0; documents of size 0 add nothing and are taken once; a
    null source is a source of its own, the last; repeated rows are separate documents; a source
    at its cap takes every document twice; a very long text among short ones is taken whole or not at all, and the
    others settle its source's target; an empty table gives no rows; further columns pass
    through (the added names are replaced where they exist; names that begin with ``_mix_`` are kept for the operator).
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    keyed = docs.drop(*added).withColumn("size", word_count(F.col("text"))).withColumn("_mix_h", F.xxhash64("doc_id", "text")).withColumn("_mix_bucket", F.pmod("_mix_h", F.lit(256)))
    buckets = written(keyed.groupBy("source", "size", F.col("_mix_bucket").alias("bucket")).agg(F.count("*").alias("m")), "mix_buckets")
    cells = written(buckets.groupBy("source", "size").agg(F.sum("m").alias("n")), "mix_cells")
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = written(source_targets(sizes, weights, share), "mix_targets")
    wide, own = F.col("size").cast("decimal(12,0)"), Window.partitionBy("source")
    scale = F.greatest(F.lit(1.0), F.try_divide(F.sum(wide * wide * F.col("n").cast("decimal(13,0)")).over(own).cast("double"), F.sum(F.col("size") * F.col("n")).over(own)))
    scaled = written(cells.withColumn("x", F.col("size") / F.coalesce(scale, F.lit(1.0))), "mix_scaled")
    unknown = F.lit(None).cast("double")
    state = targets.select(F.col("source").alias("s"), "target", "source_size", F.lit(0.0).alias("lam"), unknown.alias("lo"), unknown.alias("hi"), F.lit(False).alias("done"))
    state = written(state.filter(F.col("target") < CAP * F.col("source_size")).drop("source_size"), "mix_state")
    hint = F.broadcast if fits(targets) else (lambda t: t)
    for _ in range(MAX_STEPS):  # a source that is not solved then keeps its last rates; copies settle the rest
        before, state = state, _newton(scaled, state, hint)
        dropped(before)
        if not state.filter("not done").limit(1).count():
            break
    # whole copies per cell: rates as millionths, so that sums are exact and reruns agree
    lam = state.select("s", "lam")
    full = F.col("target") >= CAP * F.col("source_size")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(full, F.lit(float(CAP))).otherwise(F.lit(float(CAP)) / (1 + F.exp(-F.col("lam") * F.col("x"))))
    t = targets.select(F.col("source").alias("s"), "target", "source_size")
    planned = (
        scaled.join(hint(lam), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        .join(hint(t), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        .withColumn("millionths", F.round(rate * 1_000_000).cast("long") * F.col("n"))
    )
    down = Window.partitionBy("source").orderBy(F.col("size").desc())  # rows are cells: at most one per size
    run = F.sum("millionths").over(down.rowsBetween(Window.unboundedPreceding, 0))
    at = lambda c: F.floor((c + 500_000) / 1_000_000)
    planned = planned.withColumn("run", run).withColumn("k", (at(F.col("run")) - at(F.col("run") - F.col("millionths"))).cast("long"))
    planned = planned.withColumn("k", F.least(F.greatest("k", F.lit(0)), F.col("n") * CAP))
    for _ in range(3):
        planned = _settle(planned, down)
    planned = written(planned.select("source", "size", "n", "k", "target", "source_size"), "mix_copies")
    p, b = planned.alias("p"), buckets.alias("b")
    dealt = b.join(p, (F.col("b.source").eqNullSafe(F.col("p.source"))) & (F.col("b.size") == F.col("p.size"))).select(
        "b.source", "b.size", "b.bucket", "m", "n", "k", "target", "source_size",
        F.sum("m").over(Window.partitionBy("b.source", "b.size").orderBy("b.bucket").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    # of a cell's n documents each gets k div n copies, and k mod n of them, spread over the buckets, one more
    more = lambda u: F.floor(u * F.expr("k % n") / F.col("n"))
    dealt = written(
        dealt.select(
            F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("u"), F.expr("k div n").cast("int").alias("base"),
            (more(F.col("upto")) - more(F.col("upto") - F.col("m"))).alias("extra"), "target", "source_size",
        ), "mix_dealt",
    )
    dropped(buckets, cells, scaled, state, targets, planned)
    # one key without nulls for the window and the join: the rows are dealt once
    named = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    cell = Window.partitionBy("_mix_k", "size", "_mix_bucket").orderBy("_mix_h", "doc_id")
    return (
        keyed.withColumn("_mix_k", named(F.col("source"))).withColumn("_mix_r", F.row_number().over(cell))
        .join(dealt.select(named(F.col("s")).alias("_mix_k"), F.col("z").alias("size"), F.col("u").alias("_mix_bucket"), F.col("base").alias("_mix_base"), F.col("extra").alias("_mix_extra"), "target", "source_size"), ["_mix_k", "size", "_mix_bucket"])
        .withColumn("copies", (F.col("_mix_base") + (F.col("_mix_r") <= F.col("_mix_extra")).cast("int")).cast("int"))
        .withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .select(*[c for c in docs.columns if c not in added], *added)
    )


def _settle(planned: DataFrame, down) -> DataFrame:
    """Add or take single copies, largest size that fits first, until a source's remainder is
    smaller than every document that could still settle it."""
    whole = Window.partitionBy("source")
    left = F.round(F.max("target").over(whole)).cast("long") - F.sum(F.col("k") * F.col("size")).over(whole)
    t = planned.withColumn("left", left)
    room = F.when(F.col("left") > 0, F.col("n") * CAP - F.col("k")).otherwise(F.col("k"))
    t = t.withColumn("room", F.when((F.col("size") > 0) & (F.col("size") <= F.abs("left")), room).otherwise(F.lit(0)))
    before = F.coalesce(F.sum(F.col("room") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("need", F.greatest(F.abs("left") - before, F.lit(0)))
    move = F.least(F.col("room"), F.when(F.col("size") > 0, F.expr("need div greatest(size, 1)")).otherwise(F.lit(0)))
    return t.withColumn("k", F.col("k") + F.signum("left").cast("long") * move).drop("left", "room", "need")
