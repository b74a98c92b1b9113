"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Every source has a weight schedule: weights at points
of time, linear in between. It is scaled so that its integral is the source's share;
the integral tells how much of the source's tokens is wanted up to each moment. Without
given schedules, sources that may be repeated more often gain weight towards the end,
and at every moment the weights of all sources sum to 1. The documents of a
source stand in a fixed pseudo-random order, those larger than the source's whole
demand last, and each takes the moment at which the source's cumulative token demand
reaches it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.prefix import running_sum
from tidemark.runtime import materialize, range_parts

#: A source whose repeats give less than its share of this part of all listed tokens doesn't limit the total.
TOO_SMALL = 0.1
#: The strongest tilt of a schedule: from 1 - TILT to 1 + TILT times the share.
TILT = 0.8


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, too_small: float = TOO_SMALL) -> DataFrame:
    """One row per target source: share, repeats, available tokens, demand, whether it was passed over, and tilt of its schedule.

    ``sized`` has source and n_tokens, ``targets`` source (each once), target_share
    and max_repeats. The default total is the largest one at which every source meets
    its share within its repeats, so that the reached shares are the target ones.
    Sources without documents, or so small that the total would fall under
    ``too_small`` of all listed tokens, do not limit it: they give all they may and
    their shortfall raises the shares of the rest; so does any source that is too
    small for a given ``total_tokens``. All of these are ``passed_over``. With
    ``too_small`` 0 every source that has documents limits the default total.
    Schedules are linear in time; sources that may be repeated more often gain weight
    towards the end.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("available"))
    t = targets.where("source is not null and target_share > 0 and max_repeats > 0").select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
    t = t.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    most = F.col("available") * F.col("max_repeats")
    rank = F.log2(F.col("max_repeats").cast("double"))
    t = materialize(t.withColumn("feasible", most / F.col("target_share")), "sources")
    # One row of totals.
    whole = t.agg(F.sum("available").cast("double").alias("a")).first()["a"] or 0.0
    limiting = F.when((F.col("available") > 0) & (F.col("feasible") >= too_small * whole), F.col("feasible"))
    sums = t.agg(F.min(limiting).alias("total"), (F.sum(F.col("target_share") * rank) / F.sum("target_share")).alias("mean"), F.max(rank).alias("hi"), F.min(rank).alias("lo")).first()
    mean, hi, lo = (sums[x] or 0.0 for x in ("mean", "hi", "lo"))
    total = float(total_tokens) if total_tokens is not None else float(math.floor(sums["total"] if sums["total"] is not None else whole))
    span = max(hi - mean, mean - lo)
    tilt = F.lit(TILT) * (rank - mean) / span if span > 0 else F.lit(0.0)
    demand = F.least(F.col("target_share") * total, most.cast("double"))
    return t.select("source", "target_share", "max_repeats", "available", demand.alias("demand"), ((F.col("available") == 0) | (F.col("feasible") < total)).alias("passed_over"), tilt.alias("tilt"))


def curves(p: DataFrame, schedules: DataFrame | None) -> DataFrame:
    """``p`` with ``curve``: for every stretch between two points of its source's schedule, in order, the times ``t0`` and ``t1``, the weight ``w0``, its ``slope``, and the shares ``c0`` and ``c1`` of the source's demand up to either end.

    ``schedules`` has source, time (0 to 1) and weight (not negative); null values,
    and times outside, are left out, of equal times the largest weight counts. Before
    its first and after its last point a weight stays as there. A source without
    points, or with no weight anywhere, has the linear schedule of its ``tilt``.
    """
    tilted = F.array(F.struct(F.lit(0.0).alias("t"), (1 - F.col("tilt")).alias("w")), F.struct(F.lit(1.0).alias("t"), (1 + F.col("tilt")).alias("w")))
    if schedules is not None:
        good = schedules.select("source", F.col("time").cast("double").alias("t"), F.col("weight").cast("double").alias("w")).where("source is not null and t between 0 and 1 and w >= 0 and w < double('infinity')")
        # As many rows as the parameters have; one short array for each source.
        points = good.groupBy("source", "t").agg(F.max("w").alias("w")).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("t", "w"))).alias("given")).where(F.exists("given", lambda x: x["w"] > 0))
        p = p.join(points, "source", "left")
        at = lambda t, x: F.array(F.struct(F.lit(t).alias("t"), x["w"].alias("w")))
        whole = F.concat(at(0.0, F.get("given", F.lit(0))), F.col("given"), at(1.0, F.element_at("given", -1)))
        tilted = F.when(F.col("given").isNotNull(), whole).otherwise(tilted)
    p = p.withColumn("pts", tilted)
    pairs = F.filter(F.arrays_zip(F.slice("pts", F.lit(1), F.size("pts") - 1).alias("a"), F.slice("pts", F.lit(2), F.size("pts") - 1).alias("b")), lambda x: x["b"]["t"] > x["a"]["t"])
    p = p.withColumn("pairs", F.transform(pairs, lambda x: F.struct(x["a"]["t"].alias("t0"), x["b"]["t"].alias("t1"), x["a"]["w"].alias("w0"), ((x["b"]["w"] - x["a"]["w"]) / (x["b"]["t"] - x["a"]["t"])).alias("slope"), ((x["b"]["t"] - x["a"]["t"]) * (x["a"]["w"] + x["b"]["w"]) / 2).alias("area"))))
    area = lambda n: F.aggregate(F.slice("pairs", F.lit(1), n), F.lit(0.0), lambda s, x: s + x["area"])
    p = p.withColumn("area", area(F.size("pairs")))
    curve = F.transform("pairs", lambda x, i: F.struct("area", x["t0"].alias("t0"), x["t1"].alias("t1"), x["w0"].alias("w0"), x["slope"].alias("slope"), (area(i) / F.col("area")).alias("c0"), (area(i + 1) / F.col("area")).alias("c1")))
    return p.withColumn("curve", curve).drop("pts", "pairs", "area", "given")


def moment(u: Column, curve: Column) -> Column:
    """The time up to which the part ``u`` of a demand is wanted: the inverse of the integrated schedule."""
    s = F.coalesce(F.get(F.filter(curve, lambda x: (u < x["c1"]) & (x["c1"] > x["c0"])), F.lit(0)), F.element_at(F.filter(curve, lambda x: x["c1"] > x["c0"]), -1))
    need = F.greatest(F.lit(0.0), (u - s["c0"]) * s["area"])
    root = F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * s["slope"] * need))
    # The integral from t0 is w0 d + slope d^2 / 2; solved without subtracting near equals.
    return F.least(s["t1"], s["t0"] + F.coalesce(F.try_divide(2 * need, s["w0"] + root), F.lit(0.0)))


def mix_and_plan(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total_tokens: int | None = None, too_small: float = TOO_SMALL, schedules: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen documents: key, source, copy_no, n_tokens, position (0 to 1), sorted by position; and their plan.

    A document is used once per pass over its source, so at most ``max_repeats``
    times; the last pass ends where the demand is met, to within half a document.
    ``schedules`` (source, time, weight) says when a source is wanted, see ``curves``.
    Documents with a null source, an unlisted source or no tokens are not used.
    Repeated rows are documents of their own. No targets or no documents give an
    empty result. ``too_small`` says which sources may fall short of their share, see ``plan``.
    """
    sized = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"), F.col(f"`{size}`").cast("bigint").alias("n_tokens")).where("n_tokens > 0 and source is not null")
    sized = materialize(sized.withColumn("shuffled", F.xxhash64("key", F.lit("mix"))), "sized")
    p = materialize(curves(plan(sized, targets, total_tokens, too_small), schedules), "plan")
    listed = sized.join(p.select("source", "demand"), "source").withColumn("late", F.col("n_tokens") > F.col("demand")).drop("demand")
    placed = running_sum(listed, "source", ["late", "shuffled", "key"], "n_tokens", "before", range_parts(sized)).join(p, "source")
    middle = F.col("before") + F.col("n_tokens") / 2.0
    passes = F.floor((F.col("demand") - middle) / F.col("available")).cast("int")
    used = placed.where(middle <= F.col("demand")).select("*", F.explode(F.sequence(F.lit(0), F.least(passes, (F.col("max_repeats") - 1).cast("int")))).alias("copy_no"))
    u = (F.col("copy_no") * F.col("available") + middle) / F.col("demand")
    return used.select(F.col("key").alias(key), F.col("source").alias(source), "copy_no", "n_tokens", moment(u, F.col("curve")).alias("position")).orderBy("position", source, key, "copy_no"), p


def mix(docs: DataFrame, key: str, source: str, size: str, targets: DataFrame, total_tokens: int | None = None, too_small: float = TOO_SMALL, schedules: DataFrame | None = None) -> DataFrame:
    """The chosen documents of ``mix_and_plan``."""
    return mix_and_plan(docs, key, source, size, targets, total_tokens, too_small, schedules)[0]


def shares(mixed: DataFrame, source: str, targets: DataFrame, planned: DataFrame | None = None) -> DataFrame:
    """What each target source really reached: tokens, documents used, most copies of one, share and its difference from the target.

    With ``planned`` also whether it was passed over when the total was set; targets the plan can't use were.
    """
    got = mixed.groupBy(source).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), (F.max("copy_no") + 1).alias("most_copies"))
    total = got.agg(F.sum("tokens")).scalar()
    t = targets.select("source", "target_share", "max_repeats").join(got.withColumnRenamed(source, "source"), "source", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    share = F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0))
    passed = []
    if planned is not None:
        t = t.join(planned.select("source", "passed_over"), "source", "left")
        passed = [F.coalesce("passed_over", F.lit(True)).alias("passed_over")]
    return t.select("source", "target_share", "max_repeats", zero("tokens"), zero("uses"), zero("most_copies"), share.alias("reached_share"), (share - F.col("target_share")).alias("difference"), *passed)
