"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): all
pairwise interactions in time linear in the document's features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches, table, with_arrow

#: The classifier is fitted on at most this many labelled documents, those with the smallest hashes of their ids.
SAMPLE = 6000
BUCKETS = 1 << 15
RANK = 4
EPOCHS = 6
THRESHOLD = 0.7
SEED = 7

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[^\w\s]", re.UNICODE)
_LETTERS = re.compile(r"[^\W\d_]+")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"\d")
_RUNS = re.compile(r"[^\w\s]{2,}")
#: Cuts of each statistic; a statistic becomes one indicator of the interval it falls in, beside its value.
STATS = ("words", "chars", "word_length", "upper", "digit", "symbol", "symbol_runs", "distinct", "top_word", "same_next", "lines", "repeated_lines", "short_lines", "declared_chars")


def statistics(text: str, words: list[str], counts: Counter, declared: float | None) -> list[float]:
    """Structure statistics of a text, each about 0 to 1, in the order of STATS."""
    chars, n = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    letters = sum(map(len, _LETTERS.findall(text)))
    return [
        np.log1p(len(words)) / 12,
        np.log1p(len(text)) / 14,
        min(letters / n / 12, 2.0),
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars,
        len(_SYMBOLS.findall(text)) / chars,
        len(_RUNS.findall(text)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(lines) / n,
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        np.log1p(max(0.0, declared)) / 14 if declared is not None and declared == declared else 0.0,
    ]


_BUCKET_OF: dict[str, int] = {}


def _bucket(word: str, buckets: int) -> int:
    found = _BUCKET_OF.get(word)
    if found is None:
        found = zlib.crc32(word.lower().encode("utf-8", "surrogatepass"))
        if len(_BUCKET_OF) < 100_000:  # bounded memory in a worker that lives long; frequent words come early
            _BUCKET_OF[word] = found
    return found % buckets


def features(text: str | None, declared: float | None, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words weigh 1/sqrt(number of distinct words), statistics come after the buckets."""
    text = text if isinstance(text, str) else ""
    words = _WORD.findall(text)
    counts = Counter(words)
    idx = np.fromiter((_bucket(w, buckets) for w in counts), dtype=np.int64, count=len(counts))
    stats = statistics(text, words, counts, declared)
    cells = [buckets + len(STATS) + 16 * k + min(15, int(s * 16)) for k, s in enumerate(stats)]
    idx = np.concatenate([idx, np.arange(buckets, buckets + len(STATS)), cells])
    val = np.concatenate([np.full(len(counts), 1 / np.sqrt(max(1, len(counts)))), stats, np.full(len(cells), 0.5)])
    return idx, val.astype(np.float64)


def width(buckets: int = BUCKETS) -> int:
    return buckets + len(STATS) * 17


@dataclass
class FactorisationMachine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, idx: np.ndarray, val: np.ndarray) -> float:
        p = self.v[idx] * val[:, None]
        s = p.sum(axis=0)
        return self.bias + float(self.w[idx] @ val) + 0.5 * float((s * s).sum() - (p * p).sum())

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(idx, val), -40, 40))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, rank: int = RANK, epochs: int = EPOCHS, rate: float = 0.08, decay: float = 1e-5, batch: int = 32, seed: int = SEED) -> FactorisationMachine:
    """Adagrad on the logistic loss, both classes weighing alike in sum; without both classes, a constant score."""
    y = np.array([r[0] for r in rows], dtype=float)
    if len(rows) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)))
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)))
    gw, gv, gb = np.full(size, 1e-3), np.full((size, rank), 1e-3), 1e-3
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            lens = [len(rows[i][1]) for i in pick]
            idx, val = np.concatenate([rows[i][1] for i in pick]), np.concatenate([rows[i][2] for i in pick])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            p = model.v[idx] * val[:, None]
            s = np.add.reduceat(p, starts)
            z = model.bias + np.add.reduceat(model.w[idx] * val, starts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((p * p).sum(1), starts))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) * weight[pick] / len(pick)
            each = np.repeat(g, lens) * val
            at_once, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, each, len(at_once)) + decay * model.w[at_once]
            inner = np.repeat(s, lens, axis=0) - p
            dv = np.stack([np.bincount(where, each * inner[:, f], len(at_once)) for f in range(rank)], axis=1) + decay * model.v[at_once]
            gw[at_once] += dw * dw
            gv[at_once] += dv * dv
            gb += g.sum() ** 2
            model.w[at_once] -= rate * dw / np.sqrt(gw[at_once])
            model.v[at_once] -= rate * dv / np.sqrt(gv[at_once])
            model.bias -= rate * g.sum() / np.sqrt(gb)
    return model


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, buckets: int = BUCKETS) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled documents whose crc32(doc_id) mod 4 is not 2.

    Null labels and labels without a document are left out; of several labels of a document the largest holds.
    """
    small_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(sample)

    def run(batches):
        for b in batches:
            made = [features(t, d, buckets) for t, d in zip(b["text"], b["n_chars"], strict=True)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "idx": [m[0].astype("<i4").tobytes() for m in made], "val": [m[1].astype("<f4").tobytes() for m in made]})

    # `chosen` has at most `sample` rows of two numbers, so it may be broadcast; the features of as many rows come back.
    some = docs.select("doc_id", F.col("text").cast("string").alias("text"), *metadata(docs)).join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat an id the least text counts, so the sample keeps its bound.
    some = some.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.min(F.struct("text", "n_chars")).alias("row")).select("doc_id", "quality", "row.text", "row.n_chars")
    rows = some.mapInPandas(run, "doc_id long, quality int, idx binary, val binary").toPandas().sort_values(["doc_id"], kind="stable")
    data = [(int(q > 0), np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for q, i, v in zip(rows["quality"], rows["idx"], rows["val"], strict=True)]
    return fit(data, width(buckets))


def metadata(docs: DataFrame) -> list:
    """n_chars as a double; absent or not a number: null."""
    return [F.col("n_chars").cast("double").alias("n_chars") if "n_chars" in docs.columns else F.lit(None).cast("double").alias("n_chars")]


def score(docs: DataFrame, model: FactorisationMachine, keep: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep`` and, last, a score (0 to 1), a row per row of ``docs``; null texts are scored as empty ones.

    The score is named so where no column is. The other columns pass as Arrow values, so null and large integers stay.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.w.astype("f4"), model.v.astype("f4")))  # of fixed size

    def run(batches):
        bias, w, v = shared.value
        m = FactorisationMachine(bias, w, v)
        for b in batches:
            made = [m.score(*features(t, d, buckets)) for t, d in zip(b.column(text).to_pylist(), b.column(n).to_pylist(), strict=True)]
            yield with_arrow(b.drop_columns([text, n]), **{out: pa.array(made, pa.float64())})

    out, text, n = free_name("score", docs), free_name("whole_text", docs), free_name("said_chars", docs)
    kind = T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    return docs.select(*keep, F.col("text").cast("string").alias(text), metadata(docs)[0].alias(n)).mapInArrow(run, kind)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of ``docs``.

    Equal texts of equal n_chars get equal scores. A null doc_id is scored like any other. With no usable labels, or
    labels of one class, every score is that class's smoothed share. Empty table: no rows.
    """
    made = score(docs, train(docs, labels, sample), ["doc_id"]).toDF("doc_id", "score")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    made = score(docs, train(docs, labels), docs.columns)
    return made.where(F.col(made.columns[-1]) >= threshold).select(*docs.columns)


def op1_quality_fm(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
