"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Slot i of the schedule has the golden-ratio point frac(i * phi); the point falls into the interval
of one source on the line of cumulative weights, so every source comes up evenly all along the
mix. Slots are ranked within their source, and the r-th slot takes the r-th block of the source's
stream: its documents in a hashed order, once more in another order for a second epoch, cut into
blocks of equally many words. Where a source's slots fall short of its target (by the discrepancy,
a few blocks) closing slots follow the schedule; beyond the target nothing is taken. So each source
gives its target, rounded to whole words, and no document more than twice.

Ranks and running sums are taken in two levels (bucket totals, then within buckets of bounded
length), so that a source with a third of all rows is spread over many tasks.

Cases: a null source is a source, last in order; null or wordless texts have size 0 and take
nothing; a source of such texts has target 0; repeated rows are documents of their own, told apart
by the row number given when sizes are written; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinscope.llm.store import saved

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5          # of all words, given to the sources together
EPOCHS = 2           # no document is taken more often
BLOCK = 1024         # words
BUCKET = 20_000      # rows, about, that one window partition holds
PHI = 0.6180339887498949
CELLS = 4096         # equal parts of the line that slots and intervals meet in


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size), written once: the texts are read this one time. ``row`` is a unique number."""
    row = F.monotonically_increasing_id() if row is None else row
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return saved(docs.select(row.alias("row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, low, high): one row a source; [low, high) is its interval.

    Capped shares, the excess given out by weight again until none is above, come to
    min(cap, w * level) with one level for all. Sources in ascending order of cap / w fill up one
    by one; the level is where what is left, over the weights left, no longer reaches the next cap.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    place = (F.row_number().over(ordered) - 1) % len(WEIGHTS)
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))).withColumn("cap", EPOCHS * F.col("source_size").cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    below, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    per = per.select(
        "*", (SHARE * F.sum("source_size").over(everything)).alias("total"), F.coalesce(F.sum("cap").over(below), F.lit(0.0)).alias("filled"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(below), F.lit(0.0))).alias("open"))
    level = (F.col("total") - F.col("filled")) / F.col("open")
    # The first source in that order whose cap isn't reached sets the level of all that follow.
    per = per.withColumn("level", F.min(F.when(F.col("cap") > F.col("w") * level, F.struct(F.col("cap") / F.col("w"), F.col("source"), level.alias("v")))).over(everything)["v"])
    per = per.withColumn("target", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level"))))
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(everything)
    high = F.when(total > 0, F.sum("target").over(upto) / total).otherwise(0.0)
    out = per.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(ordered), F.lit(0.0)))
    # The word count each source gives, by its target.
    return out.select("source", "source_size", "target", "low", "high", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def _running(df: DataFrame, keys: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over the rows before, within ``keys`` and in the order of (bucket, order)."""
    tail = [F.col(k) for k in keys]
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_t"))
    before = Window.partitionBy(*tail).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(bucket).alias("_bucket"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col(bucket) == F.col("_bucket")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    inner = Window.partitionBy(*tail, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(totals, on)
    return out.withColumn(name, F.col("_base") + F.col("_in")).drop("_in", "_base", "_bucket", *[f"_{k}" for k in keys])


def stream(sizes: DataFrame, shares: DataFrame, seed: int, block: int) -> DataFrame:
    """(sid, block, row, words): what of which document lies in each block of each source's stream."""
    rows = sizes.where(F.col("size") > 0)
    buckets = max(1, -(-sizes.count() // BUCKET))
    shuffled = rows.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)]))).withColumn("h", F.xxhash64(F.lit(seed), "epoch", "doc_id"))
    # The high bits of the shuffled order deal it into buckets.
    shuffled = shuffled.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 32) * buckets) / F.lit(2.0 ** 32)).cast("long"))
    placed = _running(shuffled, ["source", "epoch"], "bucket", [F.shiftrightunsigned("h", 32), "h", "doc_id", "row"], F.col("size"), "at")
    quota = shares.select(F.col("source").alias("_s"), F.xxhash64(F.lit("s"), F.col("source"), F.col("source").isNull()).alias("sid"), "source_size", "quota")
    placed = placed.join(quota, F.col("source").eqNullSafe(F.col("_s"))).withColumn("at", F.col("at") + F.col("epoch") * F.col("source_size"))
    upto = F.least(F.col("at") + F.col("size"), F.col("quota"))
    placed = placed.where(F.col("at") < F.col("quota")).select("sid", "row", "at", upto.alias("upto"))
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("upto") - 1) / block))))
    words = F.least("upto", (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)
    return cut.select("sid", "block", "row", words.cast("long").alias("words"))


def schedule(spark, shares: DataFrame, n: int, block: int) -> DataFrame:
    """(slot, sid, block): the source of each slot, and which block of its stream the slot takes.

    Intervals and points meet in equal cells of the line: a point looks only at the sources of its
    cell. Slots beyond a source's quota are left out; closing slots (numbered from ``n``, by source)
    supply what the points left open.
    """
    source = shares.where(F.col("quota") > 0).select(F.xxhash64(F.lit("s"), F.col("source"), F.col("source").isNull()).alias("sid"), "low", "high", F.ceil(F.col("quota") / block).alias("need"))
    point = F.col("slot") * F.lit(PHI) - F.floor(F.col("slot") * F.lit(PHI))
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS))
    spans = source.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * CELLS), F.least(F.floor(F.col("high") * CELLS), F.lit(CELLS - 1)))))
    drawn = slots.join(spans, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "sid", "need", F.floor(F.col("slot") / BUCKET).alias("bucket"))
    ranked = _running(drawn, ["sid"], "bucket", ["slot"], F.lit(1), "block").where(F.col("block") < F.col("need")).select("slot", "sid", F.col("block").cast("long"))
    reached = ranked.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    short = source.join(reached, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0).cast("long"))).where(F.col("got") < F.col("need"))
    closing = short.withColumn("block", F.explode(F.sequence(F.col("got"), F.col("need") - 1))).select((F.lit(n) + F.col("block")).alias("slot"), "sid", "block")
    return ranked.unionByName(closing)


def mix(docs: DataFrame, seed: int = 1, block: int = BLOCK, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, taken), one row per document."""
    sizes = sized(docs, row)
    shares = saved(targets(sizes), "mix-targets")
    n = shares.agg(F.coalesce(F.floor(F.sum("target") / block), F.lit(0)).cast("long")).first()[0]
    slots = schedule(docs.sparkSession, shares, n, block)
    taken = slots.join(stream(sizes, shares, seed, block), ["sid", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
    per = shares.select(F.col("source").alias("_s"), "source_size", "target")
    out = sizes.join(taken, "row", "left").join(per, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents as the mix has them: once or twice, or not at all.

    A document cut by the end of its source's target stays if half of it or more is taken. One
    without words is in no block, and goes. Rows are numbered and written with their numbers, so
    each comes as often as the schedule took that row, whatever id it has.
    """
    rows = saved(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    share = mix(rows, seed, row=F.col("_row"))
    copies = share.where(F.col("size") > 0).select(F.col("row").alias("_id"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_copies")).where(F.col("_copies") > 0)
    out = rows.join(copies, F.col("_row") == F.col("_id"))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[rows[c] for c in docs.columns])
