"""Mixing of sources to target weights by entropy balancing.

Of all rates that meet the token target of every source and stay within ``MOST``,
those closest in relative entropy to "every document once" are exponential
tilts by size: rate = min(MOST, exp(multiplier * size)). The multiplier of a source
is the root of its convex dual. Newton steps find it, kept inside a bracket; their
gradient (tokens taken less the target) and curvature (tokens weighed by size) are
sums that Spark takes over the documents' histogram of sizes. Rates are then
rounded into whole copies along the sizes of a source, so that its running error
never exceeds the largest size.

Cases: a null or empty text has size 0, rate 1 and takes nothing. Null is a source
of its own and the last one. Repeated rows count once each. With no words at all
every target is 0. An empty table gives no rows. Rows need not have an id; ties in
size are broken by a hash of the row, so rows that tie there too are equal and reruns
take the same. Further columns may have any name. A very long text costs one count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sealdex.session import staged, staging

#: Base weights in the order of the sources, repeating.
WEIGHTS = (1, 2, 3)
#: No source and no document is taken more often than this.
MOST = 3
NEWTON_STEPS = 60
#: A source is solved when its tokens are this close to its target, relative to it.
TOLERANCE = 1e-9
#: Rows of one source and size that are ranked together; more are dealt over several groups.
RANKED_TOGETHER = 256

#: A word: a run of characters other than blank and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def water_filled(sources: DataFrame) -> DataFrame:
    """``sources`` (source, mass, weight) with ``target``: shares by weight, none above MOST times its mass.

    A source is full when the level that fills it, MOST * mass / weight, is not
    above the common level; sorted by that, one running sum finds the level.
    """
    capacity = F.lit(float(MOST)) * F.col("mass") / F.col("weight")
    order = Window.orderBy("fills", "rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy("fills", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = (
        sources.withColumn("fills", capacity)
        .withColumn("total", F.sum("mass").over(all_rows))
        .withColumn("open_weight", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.lit(MOST) * F.col("mass")).over(order), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("open_weight"))
        # The first source that its level does not fill sets the level of all after it.
        .withColumn("common", F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", "rank", "level"))).over(all_rows)["level"])
    )
    return levels.withColumn("target", F.least(F.col("common") * F.col("weight"), F.lit(float(MOST)) * F.col("mass")))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")


def _draw(docs: DataFrame) -> Column:
    """A hash of the whole row."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*hashed)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for every row of ``docs``."""
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), _size(text_col).alias("size"), _draw(docs).alias("draw")
    )
    with staging(docs.sparkSession, "mixing") as stage:
        return staged(
            _copies(sized, stage).select(
                "doc_id", "size", F.col("mass").alias("source_size"), "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source"
            ),
            "mixed",
        )


def mixed_rows(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Rows are written once under numbers of their own, by which they meet their
    copies: no group of equal rows or of one id is brought together. The result reads
    tables of the workspace.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = staged(
        docs.select(
            row.alias("row"), F.monotonically_increasing_id().alias("at"), F.col(f"`{source_col}`").alias("source"), _size(text_col).alias("size"), _draw(docs).alias("draw")
        ),
        "mixing-rows",
    )
    with staging(docs.sparkSession, "mixing") as stage:
        copies = _copies(keyed.select(F.col("at").alias("doc_id"), "source", "size", "draw"), stage)
        copies = staged(copies.where("copies > 0").select(F.col("doc_id").alias("at"), "copies"), "mixing-copies")
    taken = keyed.select("row", "at").join(copies, "at")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def rate(multiplier: Column, size: Column) -> Column:
    """The tilt, at most MOST."""
    return F.least(F.exp(F.least(multiplier * size, F.lit(math.log(MOST)))), F.lit(float(MOST)))


def _multipliers(histogram: DataFrame, targets: DataFrame, stage) -> DataFrame:
    """(source, multiplier) of the sources that are neither empty nor taken whole MOST times.

    f(multiplier) = sum of docs * size * rate grows with the multiplier, so every
    step narrows the bracket [low, high] about the root; a Newton step that would
    leave it is replaced by its middle.
    """
    tilted = targets.where(F.col("target") < F.col("mass") * MOST * (1 - TOLERANCE)).where("target > 0")
    # At one end every size is taken MOST times, at the other all together less than the target.
    ends = histogram.where("size > 0").groupBy("source").agg(F.min("size").alias("least"))
    state = tilted.join(ends, tilted["source"].eqNullSafe(ends["source"])).select(
        tilted["source"],
        "target",
        F.lit(0.0).alias("multiplier"),
        F.least((F.log(F.col("target") / F.col("mass")) - 1) / F.col("least"), F.lit(0.0)).alias("low"),
        (F.lit(math.log(MOST)) / F.col("least")).alias("high"),
    )
    state = stage(state.select(F.col("source").alias("s"), "target", "multiplier", "low", "high", F.lit(1.0).alias("off")), "step-0")
    for step in range(1, NEWTON_STEPS + 1):
        tokens = F.col("docs") * F.col("size") * rate(F.col("multiplier"), F.col("size"))
        inside = F.col("multiplier") * F.col("size") < math.log(MOST)
        sums = histogram.join(state, histogram["source"].eqNullSafe(state["s"])).groupBy("s", "target", "multiplier", "low", "high").agg(
            (F.sum(tokens) - F.col("target")).alias("gradient"), F.sum(F.when(inside, tokens * F.col("size")).otherwise(0.0)).alias("curvature")
        )
        low = F.when(F.col("gradient") < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(F.col("gradient") > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.when(F.col("curvature") > 0, F.col("multiplier") - F.col("gradient") / F.col("curvature"))
        sums = sums.select("s", "target", low.alias("low"), high.alias("high"), "multiplier", newton.alias("newton"), (F.abs("gradient") / F.col("target")).alias("off"))
        moved = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        moved = F.when(F.col("off") <= TOLERANCE, F.col("multiplier")).otherwise(moved)
        state = stage(sums.select("s", "target", moved.alias("multiplier"), "low", "high", "off"), f"step-{step}")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select(F.col("s").alias("source"), "multiplier")


def _copies(documents: DataFrame, stage) -> DataFrame:
    """(doc_id, source, size, draw, mass, target, copies) of (doc_id, source, size, draw)."""
    write = stage
    sized = write(documents, "sized")
    histogram = write(sized.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")

    # As many rows as there are sources, so one ordered window over them is small.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = (
        histogram.groupBy("source")
        .agg(F.sum(F.col("docs") * F.col("size")).alias("mass"))
        .withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1))
    )
    targets = write(water_filled(sources).select("source", "rank", "mass", F.coalesce("target", F.lit(0.0)).alias("target")), "targets")

    multipliers = _multipliers(histogram, targets, stage)
    # Sources without a multiplier are empty, or taken MOST times.
    rates = targets.join(multipliers, targets["source"].eqNullSafe(multipliers["source"]), "left").select(
        targets["source"], "mass", "target", "multiplier"
    )

    # Copies of a size: whole copies for all, one more for some, so that the running
    # sum of copies along the sizes of a source follows the running sum of rates.
    along = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = histogram.join(rates, histogram["source"].eqNullSafe(rates["source"])).select(
        histogram["source"].alias("source"),
        "size",
        "docs",
        "mass",
        "target",
        F.when(F.col("target") <= 0, 0.0).when(F.col("multiplier").isNull(), float(MOST)).otherwise(rate(F.col("multiplier"), F.col("size"))).alias("rate"),
    )
    plan = (
        plan.withColumn("upto", F.floor(F.sum(F.col("docs") * F.col("rate")).over(along) + 0.5))
        .withColumn("here", F.col("upto") - F.coalesce(F.lag("upto").over(Window.partitionBy("source").orderBy("size")), F.lit(0)))
        .withColumn("here", F.least("here", F.col("docs") * MOST))
        .withColumn("base", F.floor(F.col("here") / F.col("docs")))
        .withColumn("extra", F.col("here") - F.col("base") * F.col("docs"))
        .withColumn("groups", F.ceil(F.col("docs") / RANKED_TOGETHER))
    )
    plan = write(plan.select("source", "size", "mass", "target", "base", "extra", "groups"), "plan")

    # The extra copies go to the smallest draws: counted by group of draws first, ranked inside one.
    planned = sized.join(plan, sized["source"].eqNullSafe(plan["source"]) & (sized["size"] == plan["size"])).select(
        "doc_id", sized["source"], sized["size"], "draw", "mass", "target", "base", "extra", F.pmod(F.shiftrightunsigned("draw", 1), "groups").alias("group")
    )
    planned = write(planned, "planned")
    group = ["source", "size", "group"]
    counts = planned.where("extra > 0").groupBy(*group).agg(F.count("*").alias("n"))
    before = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("source", "size").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    ).select(*[F.col(c).alias(f"g_{c}") for c in group], F.coalesce("before", F.lit(0)).alias("before"))
    before = write(before, "before")
    ranked = planned.where("extra > 0").withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy("draw", "doc_id")))
    same = F.col("source").eqNullSafe(F.col("g_source")) & (F.col("size") == F.col("g_size")) & (F.col("group") == F.col("g_group"))
    some = ranked.join(before, same).select("doc_id", "source", "size", "draw", "mass", "target", (F.col("base") + (F.col("place") + F.col("before") <= F.col("extra")).cast("long")).alias("copies"))
    rest = planned.where("extra = 0").select("doc_id", "source", "size", "draw", "mass", "target", F.col("base").alias("copies"))
    return some.unionByName(rest)
