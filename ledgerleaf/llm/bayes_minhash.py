"""Near-duplicate detection: banded MinHash candidates, sequential Bayesian verification, exact confirmation.

1. Every text gives its set of word shingles, a MinHash signature and a digest of the set. Equal sets are one class.
2. Classes that agree on all rows of a band share a bucket.
3. In each bucket all classes are compared with the bucket's least class: pairs grow with the rows, not with their
   square. Signatures are compared a batch at a time; a pair is dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below the chosen miss probability. Survivors are confirmed on full sets.
4. Where a bucket still holds several components, classes of different components are compared in blocks, first on
   signatures in large blocks, then those left on full sets in small ones. A block gives a forest of its links, not its pairs. So
   no link that a bucket holds is left out, and no table holds more rows than a group has members.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt_anew, removed, row_key, rows_of, small_batches, stored, table, with_arrow
from .components import components

WORDS = 5
PERCENT = 85
BANDS, ROWS = 26, 5
MISS = 1e-5
#: Ends of the batches in which signatures are compared.
BATCHES = (26, 52, 78, 104, 130)
#: Classes of a bucket whose signatures, and whose full sets, are compared with each other in one block.
BLOCK, SET_BLOCK = 2048, 256
#: Pairs of one class that are confirmed together.
TOGETHER = 64
SEED = 97

_WORD_HASH: dict[bytes, int] = {}


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: lower-case A-Z, words between ASCII white space.

    Fewer words than a shingle: the whole sequence is one. No words: empty.
    """
    if not isinstance(text, str):
        return np.zeros(0, dtype=np.uint64)
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: lowers A-Z and splits on \x20\x09-\x0D alone
    if not found:
        return np.zeros(0, dtype=np.uint64)
    known, get = _WORD_HASH, _WORD_HASH.get
    h = [get(w) for w in found]
    if None in h:
        for i, w in enumerate(found):
            if h[i] is None:
                h[i] = xxhash.xxh64_intdigest(w)
                if len(known) < 150_000:  # bounded memory in a worker that lives long; frequent words come early
                    known[w] = h[i]
    h = np.array(h, dtype=np.uint64)
    k = min(words, len(h))
    n = len(h) - k + 1
    out = np.full(n, len(h) if len(h) < words else 0, dtype=np.uint64)
    for j in range(k):  # order matters: a polynomial, mixed after every word
        out = (out ^ h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


@lru_cache(maxsize=1)
def _permutations(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 32, size, dtype=np.uint32)[:, None], (rng.integers(0, 1 << 31, size, dtype=np.uint32) * 2 + 1)[:, None]


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """MinHash values of a set that is not empty."""
    flip, mul = _permutations(size)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(x), 2048):
        part = (x[None, at : at + 2048] ^ flip) * mul
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=1), out=least)
    return least


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float, batches: tuple[int, ...] = BATCHES) -> tuple[int, ...]:
    """For each batch end n the fewest matches m of n for which P(similarity >= threshold | m, n) reaches ``miss``.

    The prior is uniform, so the posterior is Beta(m + 1, n - m + 1), whose tail is a sum of binomial terms. Bytes of
    MinHash values are compared, which match by chance too; that only lets more pairs through.
    """
    t = percent / 100
    tail = lambda m, n: sum(comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))
    return tuple(next(m for m in range(n + 1) if tail(m, n) >= miss) for n in batches)


def survivors(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int, miss: float) -> np.ndarray:
    """Which of the pairs (rows of a and b: signatures as bytes; set sizes) the comparison of batches leaves."""
    left = np.flatnonzero(np.minimum(na, nb) * 100 >= percent * np.maximum(na, nb))
    matches, at = np.zeros(len(left), dtype=np.int32), 0
    for end, least in zip(BATCHES, least_matches(percent, miss), strict=True):
        if not len(left):
            break
        matches = matches + (a[left, at:end] == b[left, at:end]).sum(axis=1)
        ok = matches >= least
        left, matches, at = left[ok], matches[ok], end
    return left


def _bytes(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(len(column), -1)


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """row, doc_id, key (of id and text), n, digest of the set, sig (a byte of each MinHash value), bands. Written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, digest, sig, bands = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                if not len(s):
                    digest.append(b"")
                    sig.append(b"")
                    bands.append([])
                    continue
                m = signature(s)
                digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig.append((m & np.uint32(255)).astype(np.uint8).tobytes())
                bands.append([xxhash.xxh3_64_intdigest(m[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(BANDS)])
            yield with_arrow(b.drop_columns(["text"]), n=pa.array(n, pa.int64()), digest=pa.array(digest, pa.binary()), sig=pa.array(sig, pa.binary()), bands=pa.array(bands, pa.list_(pa.int64())))

    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    return stored(source.mapInArrow(run, f"row long, doc_id {kind}, key binary, n long, digest binary, sig binary, bands array<long>"), "signed")


def text_key(id_col: str, text_col: str):
    return row_key(SEED, F.col(id_col), F.col(text_col))


def stream_groups(batches, keys: list[str]):
    """Whole groups from batches that are sorted by ``keys``, several at a time."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        if not len(b):
            continue
        last = np.ones(len(b), dtype=bool)
        for k in keys:
            last &= (b[k] == b[k].iloc[-1]).to_numpy()
        yield b[~last], False
        rest = b[last]
    if rest is not None and len(rest):
        yield rest, True


def starts_of(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where groups start in a sorted frame, and its length."""
    new = np.ones(len(frame), dtype=bool)
    if len(frame):
        values = frame[keys].to_numpy()
        new[1:] = (values[1:] != values[:-1]).any(axis=1)
    return np.append(np.flatnonzero(new), len(frame))


def star_pairs(entries: DataFrame, signs: DataFrame, percent: int, miss: float) -> DataFrame:
    """a, b: each class against the least class of each of its buckets, where the comparison leaves the pair."""
    heads = dealt_anew(entries.groupBy("band").agg(F.min("cls").alias("a")), "band")
    pairs = entries.join(heads, "band").where("cls <> a").select("a", F.col("cls").alias("b")).distinct()

    def prune(batches):
        for b in batches:
            if len(b):
                left = survivors(_bytes(b["a_sig"]), _bytes(b["b_sig"]), b["a_n"].to_numpy(), b["b_n"].to_numpy(), percent, miss)
                yield b.iloc[left][["a", "b"]]

    side = lambda c: signs.select(F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("sig").alias(f"{c}_sig"))
    sized = pairs.join(side("b"), "b").join(side("a"), "a")
    return stored(sized.mapInPandas(prune, "a long, b long"), "star-pairs")


def in_blocks(entries: DataFrame, block: int) -> DataFrame:
    """Rows of ``entries`` (band, cls, ...) dealt over pairs of blocks of their bucket: adds i, j, own."""
    sizes = entries.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    dealt = entries.join(dealt_anew(sizes, "band"), "band").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = dealt.select("*", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).drop("other", "blocks")
    keys = ["band", "i", "j"]
    return placed.repartition(*keys).sortWithinPartitions(*keys)


def pairs_left(g: pd.DataFrame, percent: int, miss: float):
    """Index pairs of a block group, of different components, that sizes and signatures leave; some at a time."""
    sig, n, label, own, i, j = _bytes(g["sig"]), g["n"].to_numpy(), g["label"].to_numpy(), g["own"].to_numpy(), g["i"].iloc[0], g["j"].iloc[0]
    left = np.flatnonzero(own == i)
    right = left if i == j else np.flatnonzero(own == j)
    for at in range(0, len(left), 128):
        some = left[at : at + 128]
        x, y = np.repeat(some, len(right)), np.tile(right, len(some))
        ok = label[x] != label[y]
        if i == j:
            ok &= x < y
        x, y = x[ok], y[ok]
        for k in range(0, len(x), 65536):
            p, q = x[k : k + 65536], y[k : k + 65536]
            keep = survivors(sig[p], sig[q], n[p], n[q], percent, miss)
            if len(keep):
                yield p[keep], q[keep]


def open_classes(mixed: DataFrame, percent: int, miss: float) -> DataFrame:
    """band, cls: classes of a bucket that the comparison of signatures leaves in a pair with another component."""

    def run(batches):
        for frame, _ in stream_groups(batches, ["band", "i", "j"]):
            at = starts_of(frame, ["band", "i", "j"])
            band, cls = frame["band"].to_numpy(), frame["cls"].to_numpy()
            left = np.zeros(len(frame), dtype=bool)
            twos = at[:-1][np.diff(at) == 2]
            if len(twos):  # most buckets hold two classes: all of them at once
                own, i, j, label, n = (frame[c].to_numpy() for c in ("own", "i", "j", "label", "n"))
                sig, x, y = _bytes(frame["sig"]), twos, twos + 1
                cross = (label[x] != label[y]) & ((i[x] == j[x]) | (own[x] != own[y]))
                x, y = x[cross], y[cross]
                keep = survivors(sig[x], sig[y], n[x], n[y], percent, miss)
                left[x[keep]] = left[y[keep]] = True
            for k in np.flatnonzero(np.diff(at) > 2):
                for p, q in pairs_left(frame.iloc[at[k] : at[k + 1]], percent, miss):
                    left[at[k] + p] = left[at[k] + q] = True
            yield pd.DataFrame({"band": band[left], "cls": cls[left]})

    return stored(in_blocks(mixed, BLOCK).mapInPandas(run, "band long, cls long").distinct(), "open-classes")


def block_links(open_: DataFrame, percent: int, miss: float, words: int) -> DataFrame:
    """a, b: links between components, confirmed on full sets within blocks; of each block no more than a forest.

    A pair is looked at in the first band it shares. Nothing grows with the number of pairs but the comparisons.
    """

    def links(g: pd.DataFrame):
        sets = [shingle_set(t, words) for t in g["text"]]
        sizes = np.array([len(x) for x in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.cumsum(sizes) - sizes
        member = np.zeros(ids.max() + 1, dtype=np.int32)
        bands, band = np.array(g["bands"].tolist(), dtype=np.int64), int(g["band"].iloc[0])
        cls, root = g["cls"].to_numpy(), {}

        def find(x):
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        label = g["label"].tolist()
        for p, q in pairs_left(g, percent, miss):
            shared = bands[p] == bands[q]
            first = bands[p, shared.argmax(axis=1)] == band
            p, q = p[first], q[first]
            at = np.append(np.flatnonzero(np.append(True, p[1:] != p[:-1])), len(p)) if len(p) else [0]
            for s, e in zip(at[:-1], at[1:], strict=True):
                mine, others = p[s], q[s:e]
                mark = ids[begins[mine] : begins[mine] + sizes[mine]]
                member[mark] = 1
                n = sizes[others]
                rows = np.repeat(begins[others] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                both = np.add.reduceat(member[ids[rows]], np.cumsum(n) - n)
                member[mark] = 0
                for k in others[100 * both >= percent * (sizes[mine] + n - both)]:
                    x, y = find(label[mine]), find(label[k])
                    if x != y:
                        root[x] = y
                        yield cls[mine], cls[k]

    def run(batches):
        for frame, _ in stream_groups(batches, ["band", "i", "j"]):
            at = starts_of(frame, ["band", "i", "j"])
            out = [x for k in np.flatnonzero(np.diff(at) > 1) for x in links(frame.iloc[at[k] : at[k + 1]])]
            yield pd.DataFrame({"a": pd.Series([x for x, _ in out], dtype="int64"), "b": pd.Series([y for _, y in out], dtype="int64")})

    return stored(in_blocks(open_, SET_BLOCK).mapInPandas(run, "a long, b long"), "block-links")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs whose full sets reach the threshold. A class of very many pairs is dealt over several groups."""
    groups = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts")), "pair-groups")
    left = groups.join(texts.withColumnRenamed("cls", "a"), "a").select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.lit(-1).cast("long").alias("b"), "text")
    placed = pairs.join(groups, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    right = placed.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "text")

    def run(batches):
        of, mine = None, None
        for frame in batches:
            a_out, b_out = [], []
            for a, part, side, b, text in zip(frame["a"], frame["part"], frame["side"], frame["b"], frame["text"], strict=True):
                s = shingle_set(text, words)
                if side == 0:
                    of, mine = (a, part), s
                    continue
                assert of == (a, part)
                both = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(s) - both):
                    a_out.append(a)
                    b_out.append(b)
            yield pd.DataFrame({"a": pd.Series(a_out, dtype="int64"), "b": pd.Series(b_out, dtype="int64")})

    order = ["a", "part", "side"]
    return stored(left.unionByName(right).repartition("a", "part").sortWithinPartitions(*order).mapInPandas(run, "a long, b long"), "confirmed")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, miss: float = MISS, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, key, n, cls; cls, label): documents with their class of equal sets, classes with their component."""
    small_batches(docs.sparkSession)
    made = signed(docs, id_col, text_col, words)
    # Documents without shingles are classes of their own.
    digest = F.when(F.col("n") > 0, F.col("digest")).otherwise(F.col("row").cast("string").cast("binary"))
    rows = made.select("row", "doc_id", "key", "n", digest.alias("digest"))
    classes = stored(rows.groupBy("digest").agg(F.min("row").alias("cls")), "classes")
    member = stored(rows.join(classes, "digest").select("row", "doc_id", "key", "n", "cls"), "members")

    heads = made.where("n > 0").join(classes.select(F.col("cls").alias("row")), "row", "left_semi")
    signs = stored(heads.select(F.col("row").alias("cls"), "key", "n", "sig", "bands"), "signs")
    entries = signs.select("cls", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("band")
    entries = stored(entries.join(dealt_anew(shared, "band"), "band"), "entries")

    # The texts of classes that share a bucket at all, by a key of id and text; repeated rows count once.
    wanted = signs.select("cls", "key").join(entries.select("cls").distinct(), "cls")
    source = docs.select(text_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    texts = stored(source.join(wanted, "key").dropDuplicates(["cls"]).select("cls", "text"), "near-texts")

    links = confirmed(star_pairs(entries, signs, percent, miss), texts, percent, words)
    labels = stored(components(links), "labels")
    labelled = entries.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("band")
    mixed = labelled.join(dealt_anew(mixed, "band"), "band").join(signs.select("cls", "n", "sig"), "cls")
    open_ = open_classes(mixed, percent, miss)
    whole = open_.join(labelled, ["band", "cls"]).join(signs.select("cls", "n", "sig", "bands"), "cls").join(texts, "cls")
    more = block_links(whole, percent, miss, words)
    merged = components(links.unionByName(more)) if more.take(1) else labels
    return member, stored(merged.select(F.col("node").alias("cls"), "label"), "component-labels")


def labelled_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, key, n, label, component_id: a row per row of ``docs``."""
    member, labels = near_classes(docs, **options)
    labelled = member.join(labels, "cls", "left").select("doc_id", "key", "n", F.coalesce("label", "cls").alias("label"))
    labelled = stored(labelled, "labelled-documents")
    removed(member, labels)
    least = dealt_anew(labelled.groupBy("label").agg(F.min("doc_id").alias("component_id")), "label")
    return labelled.join(least, "label")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    component_id is the smallest doc_id that links lead to; kept says that it is the document's own. Texts without
    words, null and empty ones are linked with nothing. A null doc_id is smaller than none; a component of null ids
    has a null component_id, and its rows are kept. Rows that repeat share a component. Empty table: no rows.
    """
    made = labelled_documents(docs, **options)
    return made.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, nulls last; of equal ids, one."""
    made = labelled_documents(docs, id_col=id_col, text_col=text_col, **options)
    # Texts without words have labels of their own, so each stays.
    kept = made.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first"), F.max("n").alias("n"))
    bare = made.where("n = 0").select("key")
    keys = kept.where("n > 0").select(F.col("first.key").alias("key")).unionByName(bare).distinct()
    return rows_of(docs, text_key(id_col, text_col), keys)


def op4_bayes_minhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


#: On small tables only: SQL has to meet every pair of documents that share a shingle.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM w
), n AS (SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), chr(10))) AS h FROM s),
c AS (SELECT h, min(doc_id) AS cls, any_value(n_shingles) AS n FROM n WHERE n_shingles > 0 GROUP BY h),
x AS (SELECT cls, n, unnest(s) AS g FROM s JOIN c ON s.doc_id = c.cls),
p AS (
  SELECT a.cls AS a, b.cls AS b FROM x a JOIN x b ON a.g = b.g AND a.cls < b.cls AND a.n * 100 >= 85 * b.n AND b.n * 100 >= 85 * a.n
  GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT cls AS node, cls AS seen FROM c UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
l AS (SELECT node, min(seen) AS label FROM r GROUP BY node)
SELECT n.doc_id, n.n_shingles, coalesce(l.label, n.doc_id) AS component_id, n.doc_id = coalesce(l.label, n.doc_id) AS kept
FROM n LEFT JOIN c ON n.h = c.h AND n.n_shingles > 0 LEFT JOIN l ON c.cls = l.node
"""
