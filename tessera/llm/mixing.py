"""Mixing sources to target weights: capped water-filling and seeded whole and fractional epochs.

DataFrame and SQL functions only. The plan of the mix needs one small aggregate, words by source
and by one of 16**3 hash buckets, whatever the number of documents; each document is then
decided by an equi-join on its source, without a shuffle of texts where the plan is small enough to ship. No ordering
of a source's documents is needed, and sources are ranked in ranges, never all in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._graph import checkpoint

#: Hex digits of a hash that name the bucket of a document; a prefix of a source's 16**3 buckets makes its fraction.
DIGITS = 3
MAX_EPOCHS = 3
#: Bytes of the plan, a row for each source, up to which it is broadcast; a larger one is joined on salted sources.
BROADCAST_BYTES = 8 << 20
SALTS = 64


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Targets of (source, source_size, weight): adds ``target``.

    The targets share the sum of all sizes by weight, none above ``max_epochs`` times its size;
    what a capped source can't take is shared by weight among the rest, until none is above. Each round is
    one aggregate: sources that the level would lift above their caps are clamped, and the level of the rest
    rises; a round that clamps no further source ends it. A source without words has target 0, and weights
    must be positive.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, -1
    while True:
        above = cap <= F.lit(level) * F.col("weight") if clamped >= 0 else F.lit(False)
        total, capped, weight, count = sources.agg(
            F.coalesce(F.sum(F.col("source_size").cast("double")), F.lit(0.0)),
            F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(above, 1)),
        ).first()
        if count == clamped or weight == 0:
            break
        clamped, level = count, (total - capped) / weight
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(cap, F.lit(level) * F.col("weight")))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def _ranked(sources: DataFrame, order: list[str]) -> DataFrame:
    """``sources`` with ``rank`` 1, 2, ... in that order: ranges are ranked apart and moved by the sizes of those before."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpoint(sources.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    within = ranged.withColumn("rank", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    moved = ranged.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("moved"))
    return within.join(moved, "_range").withColumn("rank", F.col("rank") + F.col("moved")).drop("_range", "moved")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS, seed: int = 0) -> DataFrame:
    """Repetitions of each document in a mix of the size of all ``docs``.

    ``docs`` has doc_id, text, source and any further columns, which are returned, followed by
    size (words), source_size, target and repeats; columns that have these names in any case are replaced. Sources in
    order of code points, null last, weigh ``weights``, repeating. A source's target over its size is its epochs: the whole part is
    taken of every document, the rest of those in a prefix of its hash buckets, cut where the
    words taken come nearest to the target. The hash is of seed, doc_id, and text, so reruns agree, equal
    rows are decided alike, and a null doc_id is a value like any other. A null or blank text has
    size 0, a very long one is a document like any other; an empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "repeats")]
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    sized = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        word_count(F.col("text")).alias("size"),
        F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("int").alias("bucket"),
        F.col("source").isNull().alias("none"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"),
    )
    name = ["none", "source"]
    buckets = checkpoint(sized.groupBy(*name, "bucket").agg(F.sum("size").alias("words")))
    sources = _ranked(buckets.groupBy(*name).agg(F.sum("words").alias("source_size")), name)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    named = checkpoint(sources.select(F.struct(*name).alias("source"), "source_size", weight.alias("weight")))
    targets = water_fill(named, max_epochs).select("source.none", "source.source", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.least(F.floor(epochs), F.lit(max_epochs)).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    along = W.partitionBy(*name).orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    # A bucket is taken when that brings the words taken nearer to the rest than leaving it.
    cuts = (
        buckets.withColumn("upto", F.sum("words").over(along))
        .join(targets, name)
        .groupBy(*name)
        .agg(F.max(F.when((F.col("upto") - F.col("words") / 2 <= F.col("rest")) & (F.col("rest") > 0) & (F.col("whole") < max_epochs), F.col("bucket"))).alias("cut"))
    )
    plan = checkpoint(targets.join(cuts, name).select(*name, "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")))
    if (plan.agg(F.sum(F.octet_length("source") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        joined = sized.join(F.broadcast(plan), name)
    else:  # a source's documents are spread over as many keys
        salted = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = sized.withColumn("salt", F.col("bucket") % SALTS).join(salted, [*name, "salt"])
    repeats = F.col("whole") + F.when(F.col("bucket") <= F.col("cut"), 1).otherwise(0)
    return joined.select("row.*", "size", "source_size", "target", repeats.cast("long").alias("repeats"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The mixed table: each document as often as it repeats, with ``copy`` 1, 2, ... and its size.

    A column of ``docs`` named copy, in any case, is replaced, as those of :func:`mix` are.
    """
    mixed = mix(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"]), **options).where("repeats > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).drop("repeats")
