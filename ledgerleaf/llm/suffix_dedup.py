"""Removal of repeated passages: interval expansion on a Burrows-Wheeler transform, bounded by a length threshold.

A window is a string of ``LENGTH`` bytes inside a document. What is removed: every byte of a window that also starts
in a document with a smaller id.

1. Copies of a whole text are one text (its least id stands for it).
2. A window's anchor is the least hash of the strings of ANCHOR bytes in it. Equal windows have equal anchors, so only
   windows whose anchor occurs in two documents can repeat. Anchors are counted in buckets, a batch's anchors of a
   bucket in one row, and each batch learns which of its own are shared.
3. Runs of such windows are cut where their router changes (the same with ROUTER bytes): fragments. Equal windows lie
   in fragments of one router, so in one shard. A batch sends a shard its different fragments, once each, packed.
4. A shard is sorted by its suffixes' first bytes; on its Burrows-Wheeler transform intervals are extended backwards
   breadth first, which gives the common prefixes by increasing length, until LENGTH (fragments of one document
   without a window whose hash any other place of the shard has stay out: they cannot repeat). Suffixes between the boundaries
   found so far start with the same window; its least document goes back to the batches. A shard that is too large
   for one task (a router that very many different fragments share) is dealt out anew by its single windows.
5. Each batch marks its documents' bytes.
"""

from __future__ import annotations

import hashlib
import time

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bayes_minhash import starts_of, stream_groups
from .common import freed, removed, small_batches, stored, table

LENGTH = 50
ANCHOR, ROUTER = 24, 12
#: Documents to a batch, as a power of two, and bytes of a batch that are hashed together.
BATCH_BITS, PIECE_BYTES = 10, 4 << 20
#: Text bytes to a bucket of anchors and to a shard on average; fragment bytes of a shard beyond which it is dealt out.
BUCKET_BYTES, SHARD_BYTES, LARGE_BYTES = 32 << 20, 4 << 20, 24 << 20
#: Bytes whose windows lie in memory side by side, and those of a shard's different fragments that are sorted together:
#: a worker keeps what it once took, and two of them share an executor with the JVM.
STRETCH_BYTES, LOT_BYTES = 1 << 18, 1 << 20
#: Text bytes to a task where batches are dealt out.
TASK_BYTES = 64 << 20
LAST = (1 << 63) - 1
_TABLE = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15


_POWERS: list[np.ndarray] = [np.ones(0, dtype=np.uint64)] * 2


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept for the next call."""
    if len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.full(n, b, dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


class Hashes:
    """Hashes of the strings of any size that start at each position of some bytes, from sums over their beginnings."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        forth, self.back = powers(n)
        self.n, self.sums = n, np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * forth, out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        """One hash for each position at which ``size`` bytes are left."""
        m = self.n - size + 1
        out = (self.sums[size:] - self.sums[:m]) * self.back[:m]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(29)
        return out

    def least(self, size: int, length: int) -> np.ndarray:
        """The least hash of a string of ``size`` bytes in the window of each position at which one is left."""
        m, n, width = self.of(size), 1, length - size + 1
        while 2 * n <= width:
            m = np.minimum(m[:-n], m[n:])
            n *= 2
        if width > n:
            m = np.minimum(m[: n - width], m[width - n :])
        return m


class Batch:
    """Documents laid end to end. Their windows are hashed a stretch at a time; what is kept of them are runs."""

    def __init__(self, texts: list[bytes], length: int):
        self.sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.length = length

    def stretches(self, size: int):
        """Where windows start, their documents, and the least hash of a string of ``size`` bytes in each."""
        for s in range(0, len(self.data) - self.length + 1, STRETCH_BYTES):
            data = self.data[s : s + STRETCH_BYTES + self.length - 1]
            n = len(data) - self.length + 1
            lo, hi = np.searchsorted(self.ends, [s, s + n - 1], side="right")
            here = slice(lo, hi + 1)
            doc = np.repeat(np.arange(lo, hi + 1), np.minimum(self.ends[here], s + n) - np.maximum(self.begins[here], s))
            at = np.flatnonzero(np.arange(s, s + n) + self.length <= self.ends[doc])
            yield at + s, doc[at], Hashes(data).least(size, self.length)[at] if len(at) else np.zeros(0, dtype=np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """The batch's distinct anchors, sorted; whether two of its documents have it. Of each run of windows with one
        anchor the index of that and the document; for each stretch the numbers of windows of its runs."""
        values, docs, counts = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], []
        for at, doc, a in self.stretches(ANCHOR):
            new = np.flatnonzero(_turns(a, doc))
            values.append(a[new])
            docs.append(doc[new])
            counts.append(np.diff(np.append(new, len(at))))
        names, index = np.unique(np.concatenate(values), return_inverse=True)
        docs = np.concatenate(docs)
        first, last = np.full(len(names), 1 << 60), np.full(len(names), -1)
        np.minimum.at(first, index, docs)
        np.maximum.at(last, index, docs)
        return names, first != last, index, docs, counts

    def routed(self, open_: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and last window, document and router of each run of windows with one router, of those in ``open_`` runs
        (as ``anchors`` gives them)."""
        found, done = [], 0
        for (at, doc, route), n in zip(self.stretches(ROUTER), counts, strict=True):
            some = np.flatnonzero(np.repeat(open_[done : done + len(n)], n))
            done += len(n)
            at, doc, route = at[some], doc[some], route[some]
            new = np.flatnonzero(_turns(route, doc, at - np.arange(len(at))))
            found.append((at[new], at[np.append(new[1:], len(at))[: len(new)] - 1], doc[new], route[new]))
        first, last, doc, route = map(np.concatenate, zip(*found, strict=True))
        # A run may go on in the next stretch.
        new = np.ones(len(first), dtype=bool)
        new[1:] = (first[1:] != last[:-1] + 1) | (doc[1:] != doc[:-1]) | (route[1:] != route[:-1])
        new = np.flatnonzero(new)
        return first[new], last[np.append(new[1:], len(first))[: len(new)] - 1], doc[new], route[new]


def _turns(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _as_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def let_go(*tables: DataFrame) -> None:
    """Remove tables out of use and free shuffles. Garbage collected right after a job was seen to leave that job's
    shuffle on disk through the next step; so this waits and collects twice."""
    removed(*tables)
    for _ in range(2):
        time.sleep(0.5)
        freed(tables[0].sparkSession)


def dealt(rows: DataFrame, size: int, key: str) -> DataFrame:
    """Rows dealt out by ``key``: over the session's number of partitions, or more where so many bytes need them."""
    tasks = -(-size // TASK_BYTES)
    return rows.repartition(tasks, key) if tasks > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def counted_anchors(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """batch, piece, bucket, flags: for each batch (or the part of it that one task read, by its first row) and
    bucket, a byte for each of its anchors there, in order: whether the anchor occurs in two documents."""

    def emit(batches):
        for frame, _ in stream_groups(batches, ["batch"]):
            at = starts_of(frame, ["batch"])
            batch, row = frame["batch"].to_numpy(), frame["row"].to_numpy()
            for s, e in zip(at[:-1], at[1:], strict=True):
                texts = [_as_bytes(t) for t in frame["text"].iloc[s:e]]
                cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // PIECE_BYTES)) + 1
                for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
                    names, multi, *_ = Batch(texts[i:j], length).anchors()
                    bucket = bucket_of(names, buckets)
                    keys = ((names & np.uint64((1 << 39) - 1)) << np.uint64(1)) | multi.astype(np.uint64)
                    keys = keys.view(np.uint8).reshape(-1, 8)[:, :5]
                    have = np.unique(bucket)
                    yield pd.DataFrame({"batch": int(batch[s]), "piece": int(row[s + i]), "bucket": have, "keys": [keys[bucket == b].tobytes() for b in have]}, columns=["batch", "piece", "bucket", "keys"])

    def count(key, frame: pd.DataFrame) -> pd.DataFrame:
        raw = np.frombuffer(b"".join(frame["keys"]), dtype=np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, :5] = raw
        keys = wide.view(np.uint64).ravel()
        values, inverse, n = np.unique(keys >> np.uint64(1), return_inverse=True, return_counts=True)
        many = n > 1
        many[inverse[(keys & np.uint64(1)) == 1]] = True
        flags = many[inverse].astype(np.uint8)
        ends = np.cumsum([len(k) // 5 for k in frame["keys"]])
        return pd.DataFrame({"batch": frame["batch"], "piece": frame["piece"], "bucket": frame["bucket"], "flags": [f.tobytes() for f in np.split(flags, ends[:-1])]})

    rows = texts.select("batch", "row", "text").mapInPandas(emit, "batch long, piece long, bucket long, keys binary")
    return rows.groupBy("bucket").applyInPandas(count, "batch long, piece long, bucket long, flags binary")


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def packed(*arrays) -> bytes:
    """Arrays of integers or bytes as one compressed value."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype="<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:8], dtype="<i8")[0])
    ends = np.cumsum(np.frombuffer(raw[8 : 8 + 8 * n], dtype="<i8")) + 8 + 8 * n
    return [raw[s:e] for s, e in zip([8 + 8 * n, *ends[:-1]], ends, strict=True)]


def integers(part: bytes) -> np.ndarray:
    return np.frombuffer(part, dtype="<i8")


FRAGMENTS = "kind int, batch long, shard long, row long, bytes long, blob binary"


def fragments(texts: DataFrame, flags: DataFrame, copies: DataFrame, buckets: int, shards: int, length: int, size: int) -> DataFrame:
    """Rows of two kinds, without texts. 1: a batch's different fragments for a shard: numbers, sizes, least and greatest
    documents, bytes. 2: where a batch's documents have them: numbers, rows, documents, places."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = flags.select("batch", F.lit(0).alias("side"), F.col("piece").alias("row"), none("long").alias("doc"), none("string").alias("text"), "bucket", "flags")
    lesser = copies.select("batch", F.lit(1).alias("side"), "row", none("long").alias("doc"), none("string").alias("text"), none("long").alias("bucket"), none("binary").alias("flags"))
    told = texts.select("batch", F.lit(2).alias("side"), "row", "doc", "text", none("long").alias("bucket"), none("binary").alias("flags"))
    columns = [c.split()[0] for c in FRAGMENTS.split(", ")]

    def cut(batch: int, part: pd.DataFrame, known: pd.DataFrame, lesser: np.ndarray):
        b = Batch([_as_bytes(t) for t in part["text"]], length)
        names, _, index, docs, counts = b.anchors()
        if not len(names):
            return
        shared, bucket = np.zeros(len(names), dtype=bool), bucket_of(names, buckets)
        for k, f in zip(known["bucket"].to_numpy(), known["flags"], strict=True):
            shared[bucket == int(k)] = np.frombuffer(f, dtype=np.uint8) > 0
        rows, ids = part["row"].to_numpy(np.int64), part["doc"].to_numpy(np.int64)
        # Only the least copy of a text lends fragments.
        starts, last, docs, route = b.routed(shared[index] & ~np.isin(rows, lesser)[docs], counts)
        if not len(starts):
            return
        data, number = b.data.tobytes(), {}
        which = np.array([number.setdefault(data[s:e], len(number)) for s, e in zip(starts.tolist(), (last + length).tolist(), strict=True)])
        pieces = list(number)
        least, last = np.full(len(pieces), LAST), np.full(len(pieces), -LAST)
        np.minimum.at(least, which, ids[docs])
        np.maximum.at(last, which, ids[docs])
        shard = np.empty(len(pieces), dtype=np.int64)
        shard[which] = (route >> np.uint64(20)) % np.uint64(shards)
        made = []
        by = np.argsort(shard, kind="stable")
        for group in np.split(by, np.flatnonzero(np.diff(shard[by])) + 1):
            mine = [pieces[i] for i in group.tolist()]
            sizes = np.array([len(p) for p in mine], dtype="<i8")
            made.append((1, batch, int(shard[group[0]]), int(rows[0]), int(sizes.sum()), packed(group.astype("<i8"), sizes, least[group], last[group], b"".join(mine))))
        made.append((2, batch, -1, int(rows[0]), 0, packed(which.astype("<i8"), rows[docs], ids[docs], (starts - b.begins[docs]).astype("<i8"))))
        yield pd.DataFrame(made, columns=["kind", "batch", "shard", "row", "bytes", "blob"])

    def run(batches):
        for frame, _ in stream_groups(batches, ["batch"]):
            at = starts_of(frame, ["batch"])
            for s, e in zip(at[:-1], at[1:], strict=True):
                group = frame.iloc[s:e]
                known, docs = group[group["side"] == 0], group[group["side"] == 2]
                lesser = group["row"][group["side"] == 1].to_numpy(np.int64)
                pieces = np.unique(known["row"].to_numpy())
                which = np.searchsorted(pieces, docs["row"].to_numpy(), side="right")
                for k, piece in enumerate(pieces):
                    part = docs[which == k + 1]
                    for made in cut(int(frame["batch"].iloc[s]), part, known[known["row"] == piece], lesser) if len(part) else ():
                        yield made[columns]

    both = dealt(asked.unionByName(lesser).unionByName(told), size, "batch").sortWithinPartitions("batch", "side", "row")
    return stored(both.mapInPandas(run, FRAGMENTS), "fragments")


def common_windows(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, piece, at) of every window of the pieces, sorted by group: equal windows have one group."""
    symbols = np.zeros(sum(map(len, pieces)) + len(pieces) + 1, dtype=np.uint16)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    inside = np.ones(len(symbols), dtype=bool)
    inside[0] = inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint16) + 1
    order = prefix_order(symbols, length + 1)
    boundary = boundaries(symbols, order, length)
    piece = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = np.zeros(len(symbols), dtype=np.int64)
    left[1:] = (begins + sizes)[piece] - np.arange(1, len(symbols))
    group = np.cumsum(boundary) - 1
    ok = left[order] >= length
    start = order[ok]
    return group[ok], piece[start - 1], start - begins[piece[start - 1]]


def can_repeat(pieces: list[bytes], alone: np.ndarray, length: int) -> np.ndarray:
    """Which pieces can have a window that two documents have: those that are not ``alone`` (in one document), and
    those with a window whose hash some other place of the pieces has too. Equal windows have equal hashes."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    n = sizes - length + 1
    of = np.repeat(np.arange(len(pieces)), n)
    at = np.arange(n.sum()) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
    value = Hashes(np.frombuffer(b"".join(pieces), dtype=np.uint8)).of(length)[at]
    order = np.argsort(value)
    value = value[order]
    same = np.flatnonzero(value[1:] == value[:-1])
    out = ~alone
    out[of[order[same]]] = out[of[order[same + 1]]] = True
    return out


def lots(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """The pieces in lots of about LOT_BYTES. Equal windows have equal routers, and a piece has one, that of its first
    window; so they lie in one lot. Pieces that are single windows are told apart by their own hashes."""
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    n = -(-int(sizes.sum()) // LOT_BYTES)
    if n < 2:
        return [np.arange(len(pieces))]
    size, lot = ROUTER if sizes.max() > length else length, np.empty(len(pieces), dtype=np.int64)
    step = STRETCH_BYTES // length
    for i in range(0, len(pieces), step):
        some = np.frombuffer(b"".join(p[:length] for p in pieces[i : i + step]), dtype=np.uint8)
        lot[i : i + step] = (Hashes(some).least(size, length)[::length] >> np.uint64(44)) % np.uint64(n)
    by = np.argsort(lot, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(lot[by])) + 1)


def least_runs(pieces: list[bytes], first: np.ndarray, final: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """piece, at, n, least, by piece and place: the windows at .. at + n - 1 of a piece start in document ``least`` first.

    ``first``, ``final``: the least and greatest documents of each piece, which is there once. Pieces that no other place
    can repeat need no sorting; nothing of them is found.
    """
    some = np.flatnonzero(can_repeat(pieces, first == final, length))
    if not len(some):
        return (np.zeros(0, dtype=np.int64),) * 4
    group, piece, at = common_windows([pieces[i] for i in some.tolist()], length)
    starts = np.flatnonzero(np.append(True, np.diff(group) != 0))
    window = np.repeat(np.minimum.reduceat(first[some[piece]], starts), np.diff(np.append(starts, len(group))))
    # Back to the order of the text, by place; the separators keep pieces apart.
    sizes = np.array([len(pieces[i]) for i in some.tolist()], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    spot, room = begins[piece] + at, int(sizes.sum()) + len(sizes) + 1
    there, value, owner = np.zeros(room, dtype=bool), np.empty(room, dtype=np.int64), np.empty(room, dtype=np.int32)
    there[spot], value[spot], owner[spot] = True, window, piece
    spot = np.flatnonzero(there)
    value = value[spot]
    begin = np.flatnonzero(_turns(value, spot - np.arange(len(spot))))
    piece = owner[spot[begin]]
    return some[piece], spot[begin] - begins[piece], np.diff(np.append(begin, len(spot))), value[begin]


def prefix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of the text sorted by at least their first ``depth`` symbols, by prefix doubling."""
    n = len(symbols)
    have = np.bincount(symbols) > 0
    dense = (np.cumsum(have) - 1).astype(np.uint64)[symbols]
    bits, room = max(1, int(have.sum() - 1).bit_length()), int(n - 1).bit_length()
    width = 63 // bits
    key = dense.copy()
    for j in range(1, width):
        key <<= np.uint64(bits)
        key |= np.roll(dense, -j)
    # Later keys are two ranks. Where a place fits beside them, plain sorting, which is several times as fast, will do.
    small, start = 3 * room <= 63, width
    place = np.arange(n, dtype=np.uint64)
    while True:
        if small and width > start:
            key <<= np.uint64(room)
            key |= place
            key.sort()
            order = (key & np.uint64((1 << room) - 1)).astype(np.int64)
            key >>= np.uint64(room)
        else:
            order = np.argsort(key)
            key = key[order]
        if width >= depth:
            return order
        new = np.empty(n, dtype=np.uint64)
        new[0], new[1:] = 0, key[1:] != key[:-1]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(new)
        key = (rank << np.uint64(room)) | np.roll(rank, -width)
        width *= 2


def boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where in the order a suffix shares fewer than ``length`` symbols with the one before it.

    Intervals hold the suffixes that start with one string. Extending an interval's string backwards by each symbol
    of the transform within it gives intervals whose right ends, if no shorter string reached them before, are
    boundaries of the extended string's length less one; only such intervals are extended further.
    """
    n = len(symbols)
    kind = np.int32 if n < 1 << 31 else np.int64
    transform = symbols[order - 1]
    back = np.argsort(transform, kind="stable").astype(kind)  # back[j]: the row whose backward extension is row j
    to = np.empty(n, dtype=kind)
    to[back] = np.arange(n, dtype=kind)
    first = transform[back]
    turns = np.ones(n, dtype=bool)  # rows that start with another symbol than the row before
    turns[1:] = first[1:] != first[:-1]
    found = np.zeros(n + 1, dtype=bool)
    found[0] = found[n] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(length):
        if not len(lo):
            break
        sizes = hi - lo
        total = int(sizes.sum())
        if total > n // 8:
            # Each row's interval, or none, laid out by row and then seen by the rows that extend it.
            runs = np.empty(2 * len(lo) + 1, dtype=np.int64)
            runs[1::2], runs[0], runs[2:-1:2], runs[-1] = sizes, lo[0], lo[1:] - hi[:-1], n - hi[-1]
            names = np.full(2 * len(lo) + 1, -1, dtype=kind)
            names[1::2] = np.arange(len(lo), dtype=kind)
            label = np.repeat(names, runs)[back]
            new = turns.copy()
            new[1:] |= label[1:] != label[:-1]
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], n)
            held = label[begin] >= 0
            lo, hi = begin[held], end[held]
        else:
            of = np.repeat(np.arange(len(lo), dtype=kind), sizes)
            rows = np.arange(total, dtype=kind) + np.repeat((lo - (np.cumsum(sizes) - sizes)).astype(kind), sizes)
            target = to[rows]
            by = np.argsort(target)
            target, label = target[by], of[by]
            new = np.ones(total, dtype=bool)
            new[1:] = (label[1:] != label[:-1]) | turns[target[1:]] | (target[1:] != target[:-1] + 1)
            begin = np.flatnonzero(new)
            lo, hi = target[begin].astype(np.int64), target[np.append(begin[1:], total) - 1].astype(np.int64) + 1
        fresh = ~found[hi]
        lo, hi = lo[fresh], hi[fresh]
        found[hi] = True
    return found[:n]


def repeats(sent: DataFrame, large_bytes: int, length: int) -> tuple[DataFrame, DataFrame]:
    """The shards' parts, and batch, piece, blob (numbers, places, counts, least documents): windows at .. at + n - 1 of a batch's fragment
    also start in document ``least``, which is less than some document of the batch that has the fragment.

    ``sent``: batch, row, shard, bytes, blob. Shards with more than ``large_bytes`` of fragments are dealt out by
    their single windows, each by its own hash; so no task grows with what one router gathers.
    """
    sizes = sent.groupBy("shard").agg(F.sum("bytes").alias("total"))
    parts = F.when(F.col("total") > large_bytes, F.ceil(F.col("total") * length / 8 / large_bytes)).otherwise(1)
    sizes = stored(sizes.select("shard", parts.cast("long").alias("parts")), "shard-sizes")
    dealt = sent.join(sizes, "shard")

    def deal(batches):
        """Rows of shards that are whole as they are; those of large ones as windows, one row for each part."""
        for frame in batches:
            whole = frame[frame["parts"] == 1]
            if len(whole):
                yield whole.assign(part=0, base=None)[["batch", "row", "shard", "part", "base", "blob"]]
            for r in frame[frame["parts"] > 1].itertuples():
                number, size, least, last, data = unpacked(r.blob)
                number, size, least, last = map(integers, (number, size, least, last))
                begin, n = np.cumsum(size) - size, size - length + 1
                of = np.repeat(np.arange(len(size)), n)
                base = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = begin[of] + base
                part = (Hashes(np.frombuffer(data, dtype=np.uint8)).of(length)[at] >> np.uint64(7)) % np.uint64(r.parts)
                out = []
                for k in np.unique(part):
                    i = np.flatnonzero(part == k)
                    text = np.frombuffer(data, dtype=np.uint8)[at[i][:, None] + np.arange(length)].tobytes()
                    out.append((r.batch, r.row, r.shard, int(k), base[i].astype("<i8").tobytes(), packed(number[of[i]], np.full(len(i), length, dtype="<i8"), least[of[i]], last[of[i]], text)))
                yield pd.DataFrame(out, columns=["batch", "row", "shard", "part", "base", "blob"])

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        names: dict[bytes, int] = {}
        number, name, base, least, last, of = [], [], [], [], [], []
        for k, (blob, bases) in enumerate(zip(frame["blob"], frame["base"], strict=True)):
            n, size, lo, hi, data = unpacked(blob)
            n, size = integers(n), integers(size)
            ends = np.cumsum(size).tolist()
            name.append([names.setdefault(data[s:e], len(names)) for s, e in zip([0, *ends[:-1]], ends, strict=True)])
            number.append(n)
            base.append(np.zeros(len(n), dtype=np.int64) if bases is None else integers(bases))
            least.append(integers(lo))
            last.append(integers(hi))
            of.append(np.full(len(n), k))
        number, name, base, least, last, of = map(np.concatenate, (number, name, base, least, last, of))
        first, final = np.full(len(names), LAST), np.full(len(names), -LAST - 1)
        np.minimum.at(first, name, least)
        np.maximum.at(final, name, last)
        pieces = list(names)
        runs = []
        for lot in lots(pieces, length):
            piece, *rest = least_runs([pieces[i] for i in lot.tolist()], first[lot], final[lot], length)
            runs.append((lot[piece], *rest))
        piece, at, n, window = map(np.concatenate, zip(*runs, strict=True))
        by = np.argsort(piece, kind="stable")
        piece, at, n, window = piece[by], at[by], n[by], window[by]
        # Every sent fragment takes the runs of its name.
        lo = np.searchsorted(piece, name, side="left")
        many = np.searchsorted(piece, name, side="right") - lo
        sent_ = np.repeat(np.arange(len(name)), many)
        run_ = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[sent_]
        ok = window[run_] < last[sent_]
        sent_, run_ = sent_[ok], run_[ok]
        out = []
        for rows in np.split(np.arange(len(sent_)), np.flatnonzero(np.diff(of[sent_])) + 1) if len(sent_) else ():
            i, j = sent_[rows], run_[rows]
            k = of[i[0]]
            out.append((frame["batch"].iloc[k], frame["row"].iloc[k], packed(number[i], (at[j] + base[i]).astype("<i8"), n[j].astype("<i8"), window[j])))
        return pd.DataFrame(out, columns=["batch", "row", "blob"])

    rows = dealt.select("batch", "row", "shard", "parts", "blob").mapInPandas(deal, "batch long, row long, shard long, part long, base binary, blob binary")
    return sizes, stored(rows.groupBy("shard", "part").applyInPandas(run, "batch long, row long, blob binary"), "repeats")


def cut_out(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, list[tuple[int, int]], str]:
    """Removed bytes, maximal removed runs, digest of the rest."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(ends[by])
    new = np.append(True, starts[1:] > reach[:-1])
    begin = np.flatnonzero(new)
    runs = list(zip(starts[begin].tolist(), reach[np.append(begin[1:], len(starts)) - 1].tolist(), strict=True))
    kept, at = hashlib.sha256(), 0
    for s, e in runs:
        kept.update(data[at:s])
        at = e
    kept.update(data[at:])
    return sum(e - s for s, e in runs), runs, kept.hexdigest()


SPANS = "array<struct<start:long,end:long>>"


def marked(texts: DataFrame, made: DataFrame, found: DataFrame, length: int, with_spans: bool, size: int) -> DataFrame:
    """row, n_removed, n_spans, kept_sha256, spans of the documents that lose bytes; batch by batch."""
    places = made.where("kind = 2").select("batch", F.lit(0).alias("side"), "row", F.lit(None).cast("string").alias("text"), "blob")
    told = found.select("batch", F.lit(1).alias("side"), "row", F.lit(None).cast("string").alias("text"), "blob")
    long = texts.where(F.octet_length("text") >= length).select("batch", F.lit(2).alias("side"), "row", "text", F.lit(None).cast("binary").alias("blob"))

    def run(batches):
        for frame, _ in stream_groups(batches, ["batch"]):
            bounds = starts_of(frame, ["batch"])
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                group = frame.iloc[s:e]
                texts = dict(zip(group["row"][group["side"] == 2], group["text"][group["side"] == 2], strict=True))
                places = {r: [integers(x) for x in unpacked(x)] for r, x in zip(group["row"][group["side"] == 0], group["blob"][group["side"] == 0], strict=True)}
                hits = {}
                for piece, blob in zip(group["row"][group["side"] == 1], group["blob"][group["side"] == 1], strict=True):
                    number, at, n, least = map(integers, unpacked(blob))
                    which, rows, docs, begins = places[piece]
                    by = np.argsort(which, kind="stable")
                    lo = np.searchsorted(which[by], number, side="left")
                    many = np.searchsorted(which[by], number, side="right") - lo
                    hit = np.repeat(np.arange(len(number)), many)
                    spot = by[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + lo[hit]]
                    ok = least[hit] < docs[spot]
                    hit, spot = hit[ok], spot[ok]
                    start = begins[spot] + at[hit]
                    order = np.argsort(rows[spot], kind="stable")
                    r, start, end = rows[spot][order], start[order], (start + n[hit] + length - 1)[order]
                    for i in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1) if len(r) else ():
                        hits.setdefault(int(r[i[0]]), []).append((start[i], end[i]))
                out = []
                for row, spans in hits.items():
                    removed, runs, digest = cut_out(_as_bytes(texts[row]), *(np.concatenate(x) for x in zip(*spans, strict=True)))
                    out.append((row, removed, len(runs), digest, [{"start": x, "end": y} for x, y in runs] if with_spans else None))
                if out:
                    yield pd.DataFrame(out, columns=["row", "n_removed", "n_spans", "kept_sha256", "spans"])

    both = dealt(places.unionByName(told).unionByName(long), size, "batch").sortWithinPartitions("batch")
    return stored(both.mapInPandas(run, f"row long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS}"), "marked")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, large_bytes: int = LARGE_BYTES, bucket_bytes: int = BUCKET_BYTES, with_spans: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end of each removed run; null unless asked for).

    Texts are UTF-8 bytes, null is empty; documents shorter than ``length`` lose nothing. A null id is greater than
    all others. Documents of equal ids do not take from each other. Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    order = F.coalesce(F.col(id_col), F.lit(LAST))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), order.alias("doc"), text.alias("text"))
    texts = stored(texts.withColumns({"batch": F.shiftright("row", BATCH_BITS), "sha": F.sha2("text", 256), "n_bytes": F.octet_length("text").cast("long")}), "texts")

    copies = stored(texts.groupBy("sha").agg(F.min("doc").alias("least")), "copies")
    narrow = texts.select("row", "doc_id", "doc", "sha", "n_bytes", "batch")
    facts = stored(narrow.join(copies, "sha").select("row", "doc_id", "n_bytes", "sha", (F.col("doc") == F.col("least")).alias("first"), "batch"), "facts")

    total = int(facts.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])
    buckets, shards = max(16, -(-total // bucket_bytes)), max(16, -(-total // shard_bytes))
    flags = stored(counted_anchors(texts, buckets, length), "flags")
    let_go(copies)
    made = fragments(texts.select("batch", "row", "doc", "text"), flags, facts.where("not first").select("batch", "row"), buckets, shards, length, total)
    let_go(flags)
    sizes, found = repeats(made.where("kind = 1").select("batch", "row", "shard", "bytes", "blob"), large_bytes, length)
    let_go(sizes)
    some = marked(texts, made, found, length, with_spans, total)
    let_go(texts, made, found)

    whole = ~F.col("first") & (F.col("n_bytes") >= length)
    all_ = F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.lit([]).cast(SPANS)))
    return facts.join(some, "row", "left").select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        (all_ if with_spans else F.lit(None).cast(SPANS)).alias("spans"),
    )


def op3_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), with_spans=False).drop("spans")
