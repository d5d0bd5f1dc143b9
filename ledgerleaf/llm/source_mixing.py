"""Mixing sources to target weights with a low-discrepancy schedule (native DataFrame operations only).

Slot i of the schedule has the point (i * golden ratio) mod 1. The points are mapped through the sources' cumulative
target shares, so every stretch of the schedule holds each source in proportion, and a source's slots are ranked.
A source's documents, shuffled, form one stream of tokens that is repeated at most ``max_repeats`` times and cut into
blocks of equal tokens; slot number r of a source takes block number r of its stream.

The number of golden-ratio slots is a parameter, so a block grows with the corpus. A source has as many slots as its
target needs: slots beyond that are left out, those that the golden-ratio points do not give it (a source smaller than
a block may get none) are added, and its last block ends at the target. So a source gives its target to the word,
however small it is beside the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, power_of_two, stored, table, word_count

SLOTS = 1 << 17
MAX_REPEATS = 3
SEED = 20_011
#: floor(2**32 / golden ratio), made odd: the step of the golden-ratio sequence in 32-bit fixed point.
GOLDEN = 2_654_435_769
UNIT = 1 << 32
#: Places between two golden-ratio slots, for the slots that are added.
GAP = 1 << 20
#: Documents to a bucket of the shuffle order.
BUCKET_DOCS = 256


@dataclass
class Mix:
    """rows: row, doc_id, source, size, source_size, target. schedule: slot (order of the schedule, with gaps), source,
    block. pieces: row, source, block, words (what a document lends to a block of its source's stream)."""

    rows: DataFrame
    sources: DataFrame
    schedule: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """row, taken: words of each document that scheduled blocks hold, repeats counted."""
        same = F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.block") == F.col("s.block"))
        used = self.pieces.alias("p").join(self.schedule.alias("s"), same)
        return used.groupBy("p.row").agg(F.sum("words").alias("taken"))


def source_targets(rows: DataFrame, weights: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, weight, source_size, target, below (targets of the sources before it).

    Sources in code-point order, null last, weigh 1, 2, 3, repeating, unless ``weights`` says otherwise. A target is
    the source's share of all sizes by weight; one that would exceed ``max_repeats`` times its source's size stops
    there and the excess is reshared. In the order of cap / weight the stopped sources come first, and a source is
    stopped exactly when its share of what the ones before it leave is no less than its cap; so one pass over the
    table of sources (one row each, already summed) gives what repeated resharing ends at.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sums.withColumn("weight", (place % 3 + 1 if weights is None else weights).cast("long"))
    cap = (F.col("source_size") * max_repeats).alias("cap")
    order = W.orderBy(F.col("cap") * 6 / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = weighted.select("*", cap).select("*", left.alias("left"), weight_left.alias("weight_left"))
    stopped = F.col("left").cast("decimal(38,0)") * F.col("weight") >= F.col("cap").cast("decimal(38,0)") * F.col("weight_left")
    # What is left shrinks along the order, so the first source that is not stopped has the most.
    open_ = F.max(F.when(~stopped, F.struct("left", "weight_left"))).over(everything)
    share = (open_["left"] * F.col("weight")).cast("double") / open_["weight_left"].cast("double")
    targets = ranked.select("source", "weight", "source_size", F.when(stopped, F.col("cap").cast("double")).otherwise(share).alias("target"))
    below = F.coalesce(F.sum("target").over(W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return targets.withColumn("below", below)


def golden_schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """slot, source, block: the source of each slot and the number of that source's block it takes.

    ``sources``: source, target, below, quota. Each source has exactly the slots that hold its quota; those that the
    golden-ratio points do not give it lie between their slots, at places that depend on the source alone.
    """
    spark = sources.sparkSession
    slots = -(-total // block)
    cells = 4096
    cell = UNIT // cells
    scale = F.lit(UNIT / max(total, 1))
    needs = sources.where("quota > 0").select("source", "target", "below", F.expr(f"(quota + {block - 1}) div {block}").alias("needed"))
    spans = needs.select(
        "source",
        "needed",
        F.floor(F.col("below") * scale).cast("long").alias("lo"),
        F.when(F.col("below") + F.col("target") >= total * (1 - 1e-12), F.lit(UNIT)).otherwise(F.floor((F.col("below") + F.col("target")) * scale)).cast("long").alias("hi"),
    )
    # Each source spans a run of cells; points meet their source by an equality on the cell, then by the exact bounds.
    spans = spans.where("hi > lo").select("*", F.explode(F.sequence(F.expr(f"lo div {cell}"), F.expr(f"(hi - 1) div {cell}"))).alias("cell"))
    points = spark.range(slots).select((F.col("id") * GAP).alias("slot"), (F.col("id") * GOLDEN % UNIT).alias("u")).withColumn("cell", F.expr(f"u div {cell}"))
    placed = points.join(spans, "cell").where("u >= lo and u < hi").select("slot", "source", "needed")
    have = placed.groupBy("source").agg(F.count(F.lit(1)).alias("have")).alias("h")
    short = needs.alias("n").join(have, F.col("n.source").eqNullSafe(F.col("h.source")), "left")
    short = short.select("n.source", "needed", (F.col("needed") - F.coalesce("have", F.lit(0))).alias("missing")).where("missing > 0")
    added = short.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("missing"))).alias("k"))
    added = added.select(F.pmod(F.xxhash64("source", "k"), F.lit(max(slots, 1) * GAP)).alias("slot"), "source", "needed")
    rank = F.row_number().over(W.partitionBy("source").orderBy("slot")) - 1
    return placed.unionByName(added).withColumn("block", rank.cast("long")).where("block < needed").select("slot", "source", "block")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS, max_repeats: int = MAX_REPEATS, seed: int = SEED) -> Mix:
    """The schedule and the pieces that fill it.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, the last. Rows that
    repeat are documents of their own. Empty table, or no words at all: every target is 0 and the schedule is empty.
    The order of a source's stream depends on id, text and seed alone, so reruns agree.
    """
    mixed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sized = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        mixed.alias("key"),
    )
    sized = stored(sized, "mix-rows")
    rows_n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    # The target in whole words.
    quota = F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats)
    sources = stored(source_targets(sized, max_repeats=max_repeats).withColumn("quota", quota), "mix-sources")
    block = max(1, -(-total // slots))

    # Where a document starts in its source's stream, in two steps: sums over buckets of the shuffle order, then
    # within a bucket. No task sees a whole source.
    bits = power_of_two(rows_n / BUCKET_DOCS, 20)
    bucket = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    some = sized.where("size > 0").withColumn("bucket", bucket)
    sums = some.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    inner = W.partitionBy("source", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "row").rowsBetween(W.unboundedPreceding, -1)
    within = some.withColumn("inner_start", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    a, b = within.alias("a"), sums.alias("b")
    placed = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.bucket") == F.col("b.bucket")))
    placed = placed.select("a.row", "a.source", "a.size", (F.col("bucket_start") + F.col("inner_start")).alias("start"))

    t = sources.alias("t")
    known = F.col("x.source").eqNullSafe(F.col("t.source"))
    streams = placed.alias("x").join(t.select("source", "source_size", "quota"), known).select("x.*", "t.source_size", "t.quota")
    passes = streams.select("row", "source", "size", "quota", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda p: F.col("start") + p * F.col("source_size"))).alias("at"))
    passes = passes.where("at < quota").withColumn("until", F.least(F.col("at") + F.col("size"), F.col("quota")))
    cuts = passes.select("*", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(until - 1) div {block}"))).alias("block"))
    pieces = cuts.select("row", "source", "block", (F.least(F.col("until"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)).alias("words"))
    rows = sized.alias("x").join(t, known).select("x.row", "x.doc_id", "x.source", "x.size", "t.source_size", "t.target")
    return Mix(rows, sources, golden_schedule(sources, total, block), pieces)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    made = mix(docs, **options)
    return made.rows.join(made.taken(), "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it, to the nearest whole number.

    A source's taken words are a prefix of its repeated stream, so all but one document of a source are taken whole.
    Documents without words are never taken. Rows that share an id are repeated alike.
    """
    taken = taken_words(docs, id_col=id_col, **options)
    times = F.round(F.sum("taken") / F.when(F.sum("size") > 0, F.sum("size"))).cast("int")
    id_, n, k = (free_name(x, docs) for x in ("mixed_id", "copies", "copy"))
    copies = taken.groupBy(F.col("doc_id").alias(id_)).agg(times.alias(n)).where(F.col(n) > 0)
    both = docs.join(copies, docs[id_col].eqNullSafe(F.col(id_)))
    return both.withColumn(k, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def op9_source_mixing(spark, sf_dir):
    return taken_words(table(spark, sf_dir, "documents"))
