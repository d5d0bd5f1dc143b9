"""Best-fit-decreasing packing of token pieces into sequences, with a segment tree over remaining capacities.

Best fit decreasing depends on the pieces' lengths alone, and there are at most ``capacity`` different lengths. So the
driver packs the histogram of lengths (at most ``capacity`` numbers, whatever the size of the corpus) and gets a plan:
ranges of ranks within a length, each with the sequences and offsets they go to. Pieces are ranked within their
length on the executors and look their place up in the plan. The packing is the one that placing all pieces one by
one, longest first, into the tightest open sequence would give.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stored, table, with_arrow

CAPACITY = 1024
END_ID = 2
ENCODING = "byte_bpe_50k"
PIECES = "row long, doc_id {id}, piece int, start long, length long, ids_crc32 long, task long, rank long"


class SegmentTree:
    """Open sequences counted by remaining capacity; finds the smallest capacity of at least a length in O(log n)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The smallest capacity >= length that some open sequence has."""
        at = length + self.size
        if self.count[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(rows of length, first rank, pieces to a sequence, first sequence, offset), and the number of sequences.

    Rank r of a length, in the row with the largest first rank <= r, goes to sequence
    first + (r - first rank) // per, at offset + (r - first rank) % per * length.
    """
    tree = SegmentTree(capacity)
    open_: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> runs of sequences (first, how many)
    out, sequences = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left and n:
            open_.setdefault(left, []).append((first, n))
            tree.add(left, n)

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, run = capacity, (sequences, -(-todo // (capacity // length)))
                sequences += run[1]
            else:
                run = open_[left].pop()
                tree.add(left, -run[1])
            first, n = run
            # Once a sequence has taken one piece it is the tightest; it is filled before the next is touched.
            per = left // length
            full = min(n, todo // per)
            if full:
                out.append((length, rank, per, first, capacity - left))
                put(left - per * length, first, full)
                todo, rank, first, n = todo - full * per, rank + full * per, first + full, n - full
            if n and 0 < todo < per:
                out.append((length, rank, per, first, capacity - left))
                put(left - todo * length, first, 1)
                todo, rank, first, n = 0, rank + todo, first + 1, n - 1
            put(left, first, n)
    return np.array(out, dtype=np.int64).reshape(-1, 5), sequences


#: Runs without a break that are longer than this go to the tokenizer whose merging stays fast on them.
LONG_RUN = re.compile(r"\S{2000}|\s{2000}")


class Encoder:
    """Token ids of texts, by the vocabulary file's own rules: text that spells its special token is that token.

    The same vocabulary is read by two libraries, whose ids the tests hold equal: the rank file's is several times
    faster on prose, the other serves texts with very long runs of one class of characters.
    """

    def __init__(self, folder: str, name: str = ENCODING):
        import tiktoken
        from public_tokenizers import PATTERN

        self.file = f"{folder}/{name}.json"
        with open(f"{folder}/{name}.tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        with open(self.file, encoding="utf-8") as f:
            self.special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        self.fast = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    @cached_property
    def plain(self):
        """Large in memory, and few texts need it."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def ids(self, text: str) -> list[int]:
        if LONG_RUN.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


@lru_cache(maxsize=2)
def encoder(folder: str) -> Encoder:
    """One for each worker process."""
    return Encoder(folder)


def tokenizer_folder() -> str:
    """The folder of the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("").rstrip("/")


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, min(first, n)), *((s, capacity) for s in range(first, n, capacity))]


def tokenized_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, path: str, end_id: int) -> DataFrame:
    """A row per piece, with its rank among the pieces of its length in its task; written, so that both stay."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        encode = encoder(path).ids
        for batch in batches:
            rows, of = [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end_id], dtype="<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    rows.append((k, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                    of.append(at)
                    seen[length] += 1
            made = np.array(rows, dtype=np.int64).reshape(-1, 6)
            kept = batch.drop_columns(["text"]).take(pa.array(of, pa.int64()))
            yield with_arrow(kept, piece=pa.array(made[:, 0].astype(np.int32)), **{n: pa.array(made[:, k]) for k, n in enumerate(("start", "length", "ids_crc32", "task", "rank"), 1)})

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(source.mapInArrow(run, PIECES.format(id=kind)), "pieces")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, row: one row per piece of a document's tokens.

    A document is its text's tokens and ``end_id``; null and empty texts are the end token alone. Longer ones are cut
    into pieces of ``capacity`` of which the first may be shorter. Every piece is placed once, at consecutive offsets
    of its sequence. Repeated rows are documents of their own (``row`` tells them apart); null ids stay null. Empty
    table: no rows.
    """
    small_batches(docs.sparkSession)
    made = tokenized_pieces(docs, id_col, text_col, capacity, path or tokenizer_folder(), end_id)
    # Ranks within a length: those within a task, plus the counts of the tasks before it.
    counts = stored(made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    segments, _ = plan(histogram, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    keys = segments[:, 0] << 44 | segments[:, 1]
    order = np.argsort(keys)
    keys, segments = keys[order], segments[order]

    def place(batches):
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = segments[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            since = rank - at[:, 1]
            yield with_arrow(b.drop_columns(["rank"]), sequence_id=at[:, 3] + since // at[:, 2], offset=at[:, 4] + since % at[:, 2] * length)

    ranked = made.join(firsts, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("first"))
    kind = made.schema["doc_id"].dataType.simpleString()
    columns = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
    out = ranked.select(*columns, "rank").mapInArrow(place, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "row")


def op5_best_fit(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents")).drop("row")
