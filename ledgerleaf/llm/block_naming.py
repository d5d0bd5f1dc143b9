"""Exact deduplication by deterministic block naming (native DataFrame operations only).

A text is cut into blocks of a fixed number of characters. The distinct blocks are sorted, by a 64-bit hash of each
(so that ranges are even and only integers move), and numbered: their names, the same in every run.
Adjacent names are then paired and the distinct pairs sorted and numbered again, until a text has one name. Equal
(rounds, name) means equal text: every step is one-to-one.

The numbering itself proves that the hash is one-to-one on the blocks of this corpus: distinct pairs of hash and block
give distinct hashes. If it ever is not, the pass is repeated with another seed, so no collision can reach the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import normal_space, removed, row_key, rows_of, stored

BLOCK_CHARS = 4096
SEED = 29


def numbered(keys: DataFrame) -> DataFrame:
    """Rows of distinct integers, sorted and numbered from 0 without gaps: ``name`` is a row's place among all, so it
    does not depend on how rows were dealt.

    Ranges of the order are sorted side by side; a range's first number is the count of the ranges before it.
    """
    ranged = keys.repartitionByRange(*keys.columns).sortWithinPartitions(*keys.columns)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(ranged.select("*", F.spark_partition_id().alias("range"), place.alias("place")), "ranges")
    # A row per range, so one task may add up their counts, and every task may have them.
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    firsts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return placed.join(F.broadcast(firsts), "range").withColumn("name", F.col("first") + F.col("place")).drop("range", "place", "first")


def _block_hash(block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), block)


def named_blocks(docs: DataFrame, text: Column, block_chars: int, extra: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with their blocks' hashes, hash -> name); the hash is one-to-one on the blocks of ``docs``."""
    source = docs.select(*(c.alias(k) for k, c in extra.items()), text.alias("_text"))  # no other columns, so no clash
    blocks = F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    blocks = F.when(F.length("_text") == 0, F.array(F.lit(""))).otherwise(blocks)
    seed = 0
    while True:
        pieces = source.select(F.explode(blocks).alias("block")).select(_block_hash(F.col("block"), seed).alias("h"), "block")
        names = stored(numbered(pieces.distinct().select("h")), "block-names")
        if not names.groupBy("h").count().where("count > 1").take(1):
            break
        seed += 1
    rows = source.select(
        F.monotonically_increasing_id().alias("row"),
        *extra,
        F.sha2("_text", 256).alias("text_sha256"),
        F.transform(blocks, lambda b: _block_hash(b, seed)).alias("hs"),
    )
    return stored(rows, "block-rows"), names


def identities(docs: DataFrame, text: Column, block_chars: int = BLOCK_CHARS, extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: row, the columns of ``extra``, text_sha256, rounds, name.

    (rounds, name) is the text's collision-free identity. An empty text has one empty block.
    """
    extra = extra or {}
    rows, names = named_blocks(docs, text, block_chars, extra)
    longest = rows.agg(F.max(F.size("hs"))).first()[0] or 0
    single = (
        rows.where(F.size("hs") == 1)
        .withColumn("h", F.col("hs")[0])
        .drop("hs")
        .join(names, "h")
        .select("row", *extra, "text_sha256", F.lit(0).alias("rounds"), "name")
    )
    if longest <= 1:
        return single
    rest = rows.where(F.size("hs") > 1)
    named = stored(rest.select("row", F.posexplode("hs").alias("pos", "h")).join(names, "h").select("row", "pos", "name"), "names")
    done, rounds = None, 0
    while longest > 1:
        rounds, longest = rounds + 1, (longest + 1) // 2
        # A row's pairs: bounded by its length halved each round. A last name without a neighbour is paired with -1.
        pairs = named.groupBy("row", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        pairs = stored(pairs, "pairs")
        pair_names = stored(numbered(pairs.select("a", "b").distinct()), "pair-names")
        named = stored(pairs.join(pair_names, ["a", "b"]).select("row", "pos", "name"), "names")
        last = named.groupBy("row").agg(F.max("pos").alias("top"), F.max("name").alias("name")).where("top = 0")
        ended = last.select("row", F.lit(rounds).alias("rounds"), "name")
        done = ended if done is None else done.unionByName(ended)
        if longest > 1:
            named = named.join(last.select("row"), "row", "left_anti")
    many = rest.drop("hs").join(done, "row").select("row", *extra, "text_sha256", "rounds", "name")
    return single.unionByName(many)


def grouped(docs: DataFrame, id_col: str, text_col: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """row, doc_id, key, rounds, name, text_sha256, first (what the row that stays has), group_size: a row per row."""
    extra = {"doc_id": F.col(id_col), "key": row_key(SEED, F.col(id_col), F.col(text_col))}
    found = stored(identities(docs, normal_space(F.col(text_col)), block_chars, extra), "identities")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"), F.col("key")))
    # Written, so that the join deals its rows itself and can split the rows of a group that is very large.
    groups = stored(found.groupBy("rounds", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")), "groups")
    return found.join(groups, ["rounds", "name"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``.

    Texts are equal when identical after each run of white space became one space; null is empty, so null, empty and
    absent texts are one group. The row with the smallest id stays; of repeated rows with that id exactly one stays.
    Null ids come after all others; keep_id is null only where every id of the group is. Empty table: no rows.
    """
    return grouped(docs, id_col, text_col, block_chars).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, found by id and text; ids may repeat or be null."""
    kept = grouped(docs, id_col, text_col).where("row = first.row").select("key").distinct()
    return rows_of(docs, row_key(SEED, F.col(id_col), F.col(text_col)), kept)


def op10_block_naming(spark, sf_dir):
    from .common import table

    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
