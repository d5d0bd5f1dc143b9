"""Phrase collocations, mined level by level with hashed pruning (PCY, as direct hashing and pruning extends it).

A pass over the texts counts phrases of k words exactly and, at the same time, all that could be phrases of k + 1 words
by the bucket that their hash falls into. A phrase of k + 1 words is then counted only if

* its bucket holds at least the threshold (bitmap of buckets), and
* both its phrases of k words are frequent (Apriori), looked up in a bitmap of the hashes of those counted frequent.

Both bitmaps have ``BUCKETS`` bits at any size of the corpus, so they can be broadcast; a bit too many costs a count
that the exact threshold then drops, and no bit is ever missing. So the result does not depend on the hash.

Workers turn texts into arrays of word numbers and count with sorts of integers; a phrase is named by the name of its
beginning and its last word, so two phrases are never taken for one. What a worker holds is bounded by ``CHUNK`` bytes
of text (and one piece between marks) and ``BUCKETS`` counters of one byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import removed, small_batches, stored, table

#: Longest phrase, least frequency, phrases reported for each language.
LONGEST = 4
LEAST = 30
TOP = 2000
#: A longer phrase that has this share of a phrase's occurrences makes it redundant.
COVER_PERCENT = 80
SCALE = 2_000_000
BUCKETS = 1 << 25
#: Buckets to a block of counters when tasks' counters are added up.
BLOCK = 1 << 16
#: Bytes of text that a worker turns into numbers at a time.
CHUNK = 4 << 20

#: Bytes that end a piece become full stops, tabs spaces, A to Z small; no word holds a full stop or white space then.
_BYTES = bytes(ord(".") if c in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if c == 0x09 else c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def chunks(batches, most: int = CHUNK):
    """(language, bytes of texts of it) with at most ``most`` bytes, but for a piece that is longer; texts are
    translated and parted by full stops. A long text is parted between pieces only."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    total = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = text.translate(_BYTES)
            at = 0
            while at < len(data):
                end = len(data)
                if end - at > most:
                    end = data.rfind(b".", at, at + most) + 1
                    if end <= at:
                        end = data.find(b".", at + most) + 1 or len(data)
                held.setdefault(lang, []).append(data[at:end])
                sizes[lang] = sizes.get(lang, 0) + end - at
                total += end - at
                at = end
                if total >= most:  # the language that has most goes first, so what is held stays small
                    big = max(sizes, key=sizes.get)
                    total -= sizes.pop(big)
                    yield big, b".".join(held.pop(big))
    for lang, texts in held.items():
        yield lang, b".".join(texts)


class Chunk:
    """The words of a chunk as numbers, and phrases of growing length as numbers too (-1: none starts there)."""

    def __init__(self, lang: str, data: bytes):
        tokens = data.replace(b".", b" . ").split(b" ")
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        empty = np.array([w == b"" for w in words], bool)
        codes = codes[~empty[codes]]
        mark = np.array([w == b"." for w in words], bool)
        seed = xxhash.xxh64_intdigest(lang.encode()) & 0xFFFFFFFF
        self.words, self.codes = words, codes
        self.real = ~mark[codes]
        self.word_hash = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
        hashes = self.word_hash[codes]
        #: Of the phrase of k words that starts at a place: its hash, and whether it lies in one piece.
        self.k, self.hash, self.valid = 1, hashes, self.real
        self.name = codes

    def grow(self) -> None:
        """Hashes and places of phrases of one more word."""
        k = self.k
        self.hash = _spread(self.hash[:-1] * _ODD + self.word_hash[self.codes[k:]]) if len(self.hash) else self.hash
        self.valid = self.valid[:-1] & self.real[k:] if len(self.valid) else self.valid
        self.k += 1

    def counted(self, where: np.ndarray):
        """(phrases as bytes, hashes, counts) of the phrases that start at ``where``: names of phrases of two words
        are made from their words, of three from the first two and the last; equal names are equal phrases."""
        if not len(where):
            return [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
        names = self.codes[where]
        for j in range(1, self.k):
            _, names = np.unique(names * len(self.words) + self.codes[where + j], return_inverse=True)
        _, first, counts = np.unique(names, return_index=True, return_counts=True)
        at = where[first]
        said = [b" ".join(self.words[c] for c in row) for row in np.stack([self.codes[at + j] for j in range(self.k)], 1)]
        return said, self.hash[at], counts


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes & np.uint64(buckets - 1)).astype(np.int64)


def _has(bits: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (bits[bucket >> 3] >> (bucket & 7).astype(np.uint8) & 1).astype(bool)


SCHEMA = "lang string, phrase binary, h long, n long, block int, counters binary"


def _pass(texts: DataFrame, k: int, buckets: int, least: int, longest: int, hot, frequent, chunk: int) -> DataFrame:
    """Exact counts of phrases of ``k`` words by chunk, and counters of the buckets of those of k + 1 words by task.

    ``hot``: bitmap of buckets of phrases of k words; ``frequent``: bitmap of those of k - 1 words counted frequent.
    A counter stops at the threshold: the sum of such counters reaches it exactly when the sum of all does.
    """

    def run(batches):
        counters = np.zeros(buckets, np.uint8)
        for lang, data in chunks(batches, chunk):
            c = Chunk(lang, data)
            for _ in range(k - 2):
                c.grow()
            ok = c.valid
            if k > 1:
                known = ok & _has(frequent.value, _bucket(c.hash, buckets))
                c.grow()
                ok = c.valid & known[:-1] & known[1:]
                ok[ok] = _has(hot.value, _bucket(c.hash[ok], buckets))
            said, hashes, counts = c.counted(np.flatnonzero(ok))
            if said:
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([lang] * len(said), pa.string()),
                        "phrase": pa.array(said, pa.binary()),
                        "h": pa.array(hashes.view(np.int64)),
                        "n": pa.array(counts.astype(np.int64)),
                        "block": pa.nulls(len(said), pa.int32()),
                        "counters": pa.nulls(len(said), pa.binary()),
                    }
                )
            if k < longest and len(ok) > 1:
                # A phrase of k + 1 words needs both of its phrases of k words among those counted now.
                c.grow()
                next_ = c.hash[c.valid & ok[:-1] & ok[1:]]
                b, n = np.unique(_bucket(next_, buckets), return_counts=True)
                counters[b] = np.minimum(counters[b] + n, least)
        if k < longest and counters.any():
            packed = [(i, counters[i * BLOCK : (i + 1) * BLOCK]) for i in range(-(-buckets // BLOCK))]
            packed = [(i, x.tobytes()) for i, x in packed if x.any()]
            for i, x in packed:
                made = {"lang": [None], "phrase": [None], "h": [None], "n": [None], "block": [i], "counters": [pa.compress(x, "zstd", asbytes=True)]}
                yield pa.RecordBatch.from_pydict(made, pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("h", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("counters", pa.binary())]))

    return texts.mapInArrow(run, SCHEMA)


def _hot_buckets(counters: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bitmap of the buckets whose counters add up to the threshold.

    Counters of a block stream by in one task, which keeps their sum; the bitmap has ``buckets`` bits.
    """
    size = min(BLOCK, buckets)

    def run(batches):
        at, held = None, None
        out = lambda: pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())})
        for batch in batches:
            for block, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block != at:
                    if at is not None:
                        yield out()
                    at, held = block, np.zeros(size, np.int64)
                held += np.frombuffer(pa.decompress(packed.as_buffer(), size, "zstd", asbytes=True), np.uint8)
        if at is not None:
            yield out()

    rows = counters.where("block is not null").select("block", "counters").repartition("block").sortWithinPartitions("block")
    bits = np.zeros(buckets // 8, np.uint8)
    for r in rows.mapInArrow(run, "block int, bits binary").collect():
        bits[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return bits


def _hash_bits(phrases: DataFrame, buckets: int) -> np.ndarray:
    """Bitmap of the buckets of the hashes ``h``, made by Spark's bitmaps of 32,768 bits."""
    bucket = (F.col("h").bitwiseAND(F.lit(buckets - 1)) + 1).alias("b")  # Spark's bitmaps hold the numbers from 1
    made = phrases.select(bucket).groupBy(F.bitmap_bucket_number("b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    bits = np.zeros(max(buckets // 8, 4096), np.uint8)
    for r in made.collect():
        bits[(r.part - 1) * 4096 : r.part * 4096] = np.frombuffer(r.bits, np.uint8)
    return bits


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, buckets: int = BUCKETS, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f of every phrase of at most ``longest`` words with f >= least; lang, n of all its words)."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("binary")).toDF("lang", "text").where("text is not null")
    hot = seen = words = found = None
    for k in range(1, longest + 1):
        made = stored(_pass(texts, k, buckets, least, longest, hot, seen, chunk), f"phrases-{k}")
        counts = made.where("phrase is not null").groupBy("lang", "phrase", "h").agg(F.sum("n").alias("f"))
        if k == 1:
            counts = stored(counts, "words")
            words = stored(counts.groupBy("lang").agg(F.sum("f").alias("n")), "words-of-langs")
        level = stored(counts.where(F.col("f") >= least).select("lang", F.lit(k).alias("k"), F.col("phrase").cast("string").alias("phrase"), "h", "f"), f"frequent-{k}")
        if k == 1:
            removed(counts)
        if k < longest:
            hot = spark.sparkContext.broadcast(_hot_buckets(made, buckets, least))
            seen = spark.sparkContext.broadcast(_hash_bits(level, buckets))
        removed(made)
        level = level.drop("h")
        found = level if found is None else found.unionByName(level)
    return found, words


def scored(found: DataFrame, longest: int = LONGEST) -> DataFrame:
    """lang, k, phrase, a, l, r, score of phrases of two words and more, by the cut that scores lowest, the first of
    equal ones. Every part of a frequent phrase is frequent, so equality joins find them all."""
    words = F.split("phrase", " ")
    parts = found.select("lang", F.col("phrase").alias("part"), F.col("f"))
    cuts = found.where("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.withColumn("words", words)
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    score = F.expr(f"(cast(a as decimal(19,0)) * {SCALE}) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "k", "phrase", "a").agg(best).select("lang", "k", "phrase", "a", "best.l", "best.r", "best.score")


def covered(found: DataFrame, percent: int = COVER_PERCENT) -> DataFrame:
    """lang, phrase of frequent phrases that lie inside a longer one with at least ``percent`` of their occurrences."""
    longer = found.where("k > 2").withColumn("words", F.split("phrase", " "))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice("words", at, size), " "))))
    most = longer.select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    inside = found.where("k > 1").join(most, ["lang", "phrase"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return inside.where(wide("most") * 100 >= wide("f") * percent).select("lang", "phrase")


def collocations(docs: DataFrame, top: int = TOP, percent: int = COVER_PERCENT, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    Words are between spaces and tabs, phrases within pieces between marks and line ends; a null language is ``und``,
    a null text empty. Repeated rows count each time. Empty table, or nothing frequent: no rows. Ties in score go by
    frequency, then by the bytes of the phrase.
    """
    found, words = frequent_phrases(docs, **options)
    left = scored(found).join(covered(found, percent), ["lang", "phrase"], "left_anti")
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase"))
    ranked = left.withColumn("rank", place).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS p, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), cut AS (
  SELECT p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM cut GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM cut, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS c FROM f WHERE k > 1
), parts AS (
  SELECT c.*, l.f AS l, r.f AS r, c.a::HUGEINT * 2000000 // (l.f + r.f) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : c], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[c + 1 : c.k], ' ')
), best AS (
  SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
), inside AS (
  SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(f) AS most
  FROM (SELECT lang, k, f, w, s, unnest(range(1, k - s + 2)) AS i
        FROM (SELECT lang, k, f, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS s FROM f WHERE k > 2)) GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, score
  FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE i.most IS NULL OR i.most::HUGEINT * 100 < a::HUGEINT * 80
)
SELECT r.lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked r JOIN words USING (lang) WHERE rank <= 2000
"""
