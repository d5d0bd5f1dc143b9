"""Toxicity: a chain of linear classifiers, one per category, each seeing the probabilities of the earlier ones.

While fitting, a later model sees the earlier categories' out-of-fold predictions: each row is predicted by a model
that has not seen it, so later models learn how far earlier ones can be trusted on new texts.

The labels mark a text as toxic or not. The categories are toxicity in each of the chosen languages, learnt from the
label and the language of labelled rows, and toxicity in any language, the last. A score reads the text alone. The
pull on weights and the threshold are chosen by out-of-fold predictions of the fitted rows, never by held-out ones.

``train`` fits on every labelled row that is not held out. The rows' features lie in the shared folder, in shards; in
each epoch a task streams through each shard's rows once, from the same weights, and the driver takes the mean of what
the shards made of them. The number of shards, the rows of each and their order depend on the rows alone, and the mean is
taken in whole numbers, so the result does not depend on files, partitions or the order of tasks. All models of the chain (one per category from all rows, one per category and fold) take a step
together: a batch's out-of-fold probabilities, category by category, are what its later categories see. ``fit_chain`` is
the same chain on rows in memory, one model after the other.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property
from itertools import chain as joined

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, stored, table, with_arrow
from .quality_fm import held_out

#: Shards that are fitted side by side (a task streams through its shard, however long), and rows that are shuffled together.
SHARDS, SHUFFLED = 8, 1000
#: Weights are added up in whole numbers of this part of one.
UNIT = 1 << 24
#: Parts that a range of values is counted in, to find the value at a place.
BINS = 1024
BUCKETS = 1 << 17
FOLDS, EPOCHS = 3, 8
#: Rows to a step: a sixteenth of those fitted, between these.
BATCH = (32, 256)
#: Pulls on weights to choose from, by out-of-fold loss.
DECAYS = (1e-3, 3e-3)
#: The threshold is the lowest that flags at most this share of clean fitted rows by out-of-fold predictions.
WRONG = 0.001
LANGUAGES = ("en", "de", "es", "fr")
SEED = 13
_WORD = re.compile(r"[^\W\d_]+")
#: What of a lower-case text's bytes can be in a word: letters, and all that is not ASCII.
_PARTS = bytes(i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))
#: Places of known words, of which there are at most so many, in the table of their features.
KNOWN = 100_000
_PLACE: dict[str, int] = {}
_TABLE = np.zeros((KNOWN, 4), dtype=np.int32)
_SEEN = np.zeros(BUCKETS, dtype=bool)


def _ids(word: str) -> tuple[int, ...]:
    """The hashed word and its beginnings, four numbers; a short word's own stands in for those that it does not have."""
    crc, raw, n = zlib.crc32, word.encode("utf-8", "surrogatepass"), len(word)
    own = crc(raw) % BUCKETS
    if len(raw) > n:
        return (own, *(crc(f"{word[:k]}*".encode("utf-8", "surrogatepass")) % BUCKETS if n > k else own for k in (3, 4, 5)))
    if n > 5:
        return own, crc(raw[:3] + b"*") % BUCKETS, crc(raw[:4] + b"*") % BUCKETS, crc(raw[:5] + b"*") % BUCKETS
    return own, crc(raw[:3] + b"*") % BUCKETS if n > 3 else own, crc(raw[:4] + b"*") % BUCKETS if n > 4 else own, own


def words_of(text: str) -> set[str]:
    """The distinct words of the lower-case text. ASCII parts them by one pass over bytes; only what has other signs than
    letters beyond ASCII is matched."""
    parts = set(text.lower().encode("utf-8", "surrogatepass").translate(_PARTS).decode("utf-8", "surrogatepass").split())
    odd = [p for p in parts if not p.isalpha()]
    parts.difference_update(odd)
    parts.update(joined.from_iterable(map(_WORD.findall, odd)))
    return parts


def features(text: str | None) -> np.ndarray:
    """Which hashed words and beginnings of words the whole text has, sorted."""
    words = words_of(text) if isinstance(text, str) else set()
    places, new = [], []
    get = _PLACE.get
    for w in words:
        at = get(w)
        if at is not None:
            places.append(at)
            continue
        found = _ids(w)
        new += found
        if len(_PLACE) < KNOWN:  # bounded memory in a worker that lives long; frequent words come early
            _TABLE[len(_PLACE)] = found
            _PLACE[w] = len(_PLACE)
    _SEEN[_TABLE[places].ravel()] = True
    _SEEN[new] = True
    out = np.flatnonzero(_SEEN)
    _SEEN[out] = False
    return out


class Rows:
    """Feature indices of many rows, end to end."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.idx = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)

    def __len__(self) -> int:
        return len(self.sizes)

    @cached_property
    def of(self) -> np.ndarray:
        """Which row each index belongs to."""
        return np.repeat(np.arange(len(self)), self.sizes)

    def take(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the picked rows, and which pick each belongs to."""
        n = self.sizes[pick]
        of = np.repeat(np.arange(len(pick)), n)
        return self.idx[np.arange(n.sum()) + np.repeat(self.begins[pick] - (np.cumsum(n) - n), n)], of


@dataclass
class Linear:
    bias: float
    w: np.ndarray
    of_earlier: np.ndarray  # weights of earlier categories' probabilities

    def scores(self, x: Rows, earlier: np.ndarray, pick: np.ndarray | None = None) -> np.ndarray:
        """A probability for each row (or each picked one); ``earlier`` has a row for each of those."""
        idx, of = (x.idx, x.of) if pick is None else x.take(pick)
        z = self.bias + np.bincount(of, self.w[idx], len(earlier)) + earlier @ self.of_earlier
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(x: Rows, pick: np.ndarray, earlier: np.ndarray, y: np.ndarray, decay: float, epochs: int = EPOCHS, rate: float = 0.3) -> Linear:
    """Adagrad on the logistic loss of the picked rows, weights pulled to zero; without both classes, a constant."""
    model = Linear(0.0, np.zeros(BUCKETS), np.zeros(earlier.shape[1]))
    if len(pick) == 0 or y[pick].min() == y[pick].max():
        share = (y[pick].sum() + 0.5) / (len(pick) + 1)
        model.bias = float(np.log(share / (1 - share)))
        return model
    rng, batch = np.random.default_rng(SEED), int(np.clip(len(pick) // 16, *BATCH))
    gw, ge, gb = np.full(BUCKETS, 1e-2), np.full(earlier.shape[1], 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(pick)
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            idx, of = x.take(some)
            z = model.bias + np.bincount(of, model.w[idx], len(some)) + earlier[some] @ model.of_earlier
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(some)
            dw = np.bincount(idx, g[of], BUCKETS)
            used = np.flatnonzero(dw)
            dw = dw[used] + decay * model.w[used]
            gw[used] += dw * dw
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            de = g @ earlier[some]
            ge += de * de
            model.of_earlier -= rate * de / np.sqrt(ge)
            gb += g.sum() ** 2
            model.bias -= rate * g.sum() / np.sqrt(gb)
    return model


def out_of_fold(x: Rows, earlier: np.ndarray, y: np.ndarray, fold: np.ndarray, decay: float) -> np.ndarray:
    """Each row's probability by a model fitted on the other folds."""
    out = np.zeros(len(x))
    for f in np.unique(fold):
        rest, mine = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        out[mine] = fit_linear(x, rest, earlier, y, decay).scores(x, earlier[mine], mine)
    return out


@dataclass
class Chain:
    models: list[Linear]
    threshold: float

    def probabilities(self, x: Rows) -> np.ndarray:
        """A row of probabilities, one for each category in order, for each row of ``x``."""
        out = np.zeros((len(x), 0))
        for m in self.models:
            out = np.column_stack([out, m.scores(x, out)])
        return out


def lowest_threshold(p: np.ndarray, y: np.ndarray, wrong: float) -> float:
    """The lowest threshold at which at most a share ``wrong`` of the rows with y = 0 reaches it."""
    clean = np.sort(p[y == 0])[::-1]
    if not len(clean) or not (y > 0).any():
        return 0.5
    allowed = int(wrong * len(clean))
    above = p[p > clean[allowed]]
    return float((clean[allowed] + above.min()) / 2) if len(above) else float(np.nextafter(clean[allowed], 2))


def fit_chain(x: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS, decays: tuple[float, ...] = DECAYS, wrong: float = WRONG) -> Chain:
    """A model per column of ``labels``, in order, and the last one's threshold."""
    rows = Rows(x)
    fold, everything = np.random.default_rng(SEED).integers(0, folds, len(rows)), np.arange(len(rows))
    earlier, models = np.zeros((len(rows), 0)), []
    last = labels[:, -1].astype(float) if len(rows) else np.zeros(0)
    loss = []
    for d in decays if len(decays) > 1 and len(rows) else ():
        p = np.clip(out_of_fold(rows, earlier, last, fold, d), 1e-9, 1 - 1e-9)
        loss.append(float(-(last * np.log(p) + (1 - last) * np.log(1 - p)).mean()))
    decay = decays[int(np.argmin(loss))] if loss else decays[0]
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        models.append(fit_linear(rows, everything, earlier, y, decay))
        earlier = np.column_stack([earlier, out_of_fold(rows, earlier, y, fold, decay)])
    return Chain(models, lowest_threshold(earlier[:, -1], last, wrong))


def categories(languages: tuple[str, ...] = LANGUAGES) -> list[str]:
    return [*(f"toxic_{x}" for x in languages), "toxic"]


class Together:
    """Models that take their steps together: model k learns category ``of[k]`` from the rows outside fold
    ``without[k]`` (-1: from all). A category's probability for a row, as later categories see it, is that of the model
    which left the row's fold out. Models without rows of both classes stay constants, as in ``fit_linear``."""

    def __init__(self, of: list[int], without: list[int], decay: list[float], chained: bool, n: np.ndarray, toxic: np.ndarray):
        """``n``: rows by fold; ``toxic``: by fold and category, those that it marks."""
        self.of, self.without, self.decay, self.chained = np.array(of), np.array(without), np.array(decay, dtype=np.float32), chained
        taken = self.without != np.arange(len(n))[:, None]
        rows, marked = (n[:, None] * taken).sum(axis=0), (toxic[:, self.of] * taken).sum(axis=0)
        self.open = (marked > 0) & (marked < rows)
        share = (marked + 0.5) / (rows + 1)
        k, c = len(of), max(of) + 1
        self.w, self.gw = np.zeros((k, BUCKETS), dtype=np.float32), np.full((k, BUCKETS), 1e-2, dtype=np.float32)
        # Bias and its squares, weights of earlier probabilities and theirs.
        self.rest = np.vstack([np.where(self.open, 0.0, np.log(share / (1 - share))), np.full(k, 1e-2), np.zeros((c, k)), np.full((c, k), 1e-2)])

    def thin(self) -> tuple:
        """What a task needs, weights of used buckets only; of squares three digits are enough."""
        used = np.flatnonzero((self.gw != np.float32(1e-2)).any(axis=0))
        return {k: v for k, v in vars(self).items() if k not in ("w", "gw")}, used.astype(np.int32), self.w[:, used], self.gw[:, used].astype(np.float16)

    @classmethod
    def whole(cls, thin: tuple) -> Together:
        facts, used, w, gw = thin
        self = cls.__new__(cls)
        vars(self).update(facts, rest=facts["rest"].copy())
        self.w, self.gw = np.zeros((len(w), BUCKETS), dtype=np.float32), np.full((len(w), BUCKETS), 1e-2, dtype=np.float32)
        self.w[:, used], self.gw[:, used] = w, gw
        return self

    def predicted(self, idx: np.ndarray, of: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows as ``Rows.take`` gives them a column of probabilities for each model, and one for each category by
        the models that have not seen the rows."""
        c = (len(self.rest) - 2) // 2
        p, unseen = np.empty((len(fold), len(self.of))), np.zeros((len(fold), c))
        starts = np.flatnonzero(np.diff(of, prepend=-1))
        for j in range(c):
            for k in np.flatnonzero(self.of == j):
                z = self.rest[0, k] + unseen[:, :j] @ self.rest[2 : 2 + j, k]
                z[of[starts]] += np.add.reduceat(self.w[k].take(idx), starts) if len(idx) else 0
                p[:, k] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            for k in np.flatnonzero((self.of == j) & (self.without >= 0)):
                mine = fold == self.without[k]
                unseen[mine, j] = p[mine, k]
        return p, unseen

    def step(self, idx: np.ndarray, of: np.ndarray, y: np.ndarray, fold: np.ndarray, rate: float = 0.3) -> None:
        """One step of ``fit_linear`` for every model, on rows as ``Rows.take`` gives them."""
        p, unseen = self.predicted(idx, of, fold)
        taken = self.without != fold[:, None]
        g = np.where(taken & self.open, p - y[:, self.of], 0) / np.maximum(taken.sum(axis=0), 1)
        place = np.zeros(BUCKETS, dtype=np.int64)
        place[idx] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(len(used))
        place = place[idx]
        for f in np.unique(self.without):
            held = fold[of] != f
            places, rows = place[held], of[held]
            for k in np.flatnonzero(self.open & (self.without == f)):
                dw = np.bincount(places, g[:, k].take(rows), len(used))
                mine = np.flatnonzero(dw)
                at, w, gw = used[mine], self.w[k], self.gw[k]
                old = w.take(at)
                dw = dw.take(mine).astype(np.float32) + self.decay[k] * old
                square = gw.take(at) + dw * dw
                gw[at] = square
                w[at] = old - np.float32(rate) * dw / np.sqrt(square)
        c = unseen.shape[1]
        earlier = (np.arange(c)[:, None] < self.of) & self.chained
        d = np.vstack([g.sum(axis=0), np.where(earlier, unseen.T @ g, 0)])
        at, squares = [0, *range(2, 2 + c)], [1, *range(2 + c, 2 + 2 * c)]
        self.rest[squares] += d * d
        self.rest[at] -= rate * d / np.sqrt(self.rest[squares])

    def mix(self, made, total: int) -> None:
        """Take the mean, by rows, of what shards made, a row for each model of a shard, in order of models; of a
        bucket's weights, that of the shards which used it. All models of a shard use the same buckets, which the first
        one's row names. Sums are of whole numbers, so the order of shards does not matter."""
        rows = np.zeros(BUCKETS, dtype=np.int64)
        w, gw, rest = (np.zeros(x.shape, dtype=np.int64) for x in (self.w, self.gw, self.rest))
        whole = lambda x, n: np.rint(x.astype(float) * n * UNIT).astype(np.int64)
        for r in made:
            k, n = r["model"], r["n"]
            if k == 0:
                at = np.frombuffer(r["at"], "<i4")
                rows[at] += n
            w[k, at] += whole(np.frombuffer(r["w"], "<f4"), n)
            gw[k, at] += whole(np.frombuffer(r["gw"], "<f2"), n)
            rest[:, k] += whole(np.frombuffer(r["rest"], "<f8"), n)
        at = np.flatnonzero(rows)
        for k in range(len(w)):
            self.w[k, at], self.gw[k, at] = w[k, at] / UNIT / rows[at], gw[k, at] / UNIT / rows[at]
        self.rest = rest / UNIT / max(total, 1)


def _read(batch: pa.RecordBatch, names: list[str]) -> tuple[Rows, np.ndarray, np.ndarray]:
    """Features, marks and folds of a batch of stored rows."""
    x = Rows([np.frombuffer(i, "<i4") for i in batch.column("idx").to_pylist()])
    return x, np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float), batch.column("fold").to_numpy()


def _by_shard(batches, size: int):
    """(shard, its rows in groups of ``size`` and a last one), whatever batches they come in; shards are in order."""
    held: list[pa.RecordBatch] = []
    have = 0

    def out() -> pa.RecordBatch:
        return pa.concat_batches(held)

    for b in batches:
        shards = b.column("shard").to_numpy()
        at = 0
        while at < len(shards):
            if held and held[0].column("shard")[0].as_py() != shards[at]:
                yield held[0].column("shard")[0].as_py(), out()
                held, have = [], 0
            same = int(np.searchsorted(shards[at:], shards[at], "right"))
            part = b.slice(at, min(same, size - have))
            held.append(part)
            have, at = have + part.num_rows, at + part.num_rows
            if have == size:
                yield held[0].column("shard")[0].as_py(), out()
                held, have = [], 0
    if held:
        yield held[0].column("shard")[0].as_py(), out()


def fit_together(models: Together, rows: DataFrame, names: list[str], n: int, epochs: int = EPOCHS) -> Together:
    """``models`` after ``epochs`` passes over all ``rows`` (place, fold, idx, a boolean for each name); ``n`` is their
    number. A row's place says which shard it is in and where."""
    size, context = int(np.clip(n // 16, *BATCH)), rows.sparkSession.sparkContext
    shards = rows.withColumn("shard", F.pmod(F.shiftright("place", 8), F.lit(SHARDS)).cast("int"))
    shards = shards.repartitionById(SHARDS, F.col("shard")).sortWithinPartitions("shard", "place", "idx")
    for epoch in range(epochs if n else 0):
        shared = context.broadcast(models.thin())

        def run(batches, shared=shared, epoch=epoch):
            def made(own, used, met):
                at = np.flatnonzero(used)
                for k in range(len(own.w)):
                    yield {"model": k, "n": met, "at": b"" if k else at.astype("<i4").tobytes(), "w": own.w[k, at].tobytes(), "gw": own.gw[k, at].astype("<f2").tobytes(), "rest": own.rest[:, k].tobytes()}

            now = None
            for shard, b in _by_shard(batches, SHUFFLED):
                if shard != now:
                    for r in made(own, used, met) if now is not None else ():  # noqa: F821 set with the first shard
                        yield pa.RecordBatch.from_pylist([r])
                    own, rng, now = Together.whole(shared.value), np.random.default_rng([SEED, epoch, shard]), shard
                    met, used = 0, np.zeros(BUCKETS, dtype=bool)
                x, y, fold = _read(b, names)
                order = rng.permutation(len(x))
                for at in range(0, len(order), size):
                    some = order[at : at + size]
                    own.step(*x.take(some), y[some], fold[some])
                met += len(x)
                used[x.idx] = True
            for r in made(own, used, met) if now is not None else ():
                yield pa.RecordBatch.from_pylist([r])

        # Up to 0.8 MB for a model of a shard, whatever its rows: the driver takes one part of them after the other.
        made = stored(shards.mapInArrow(run, "model long, n long, at binary, w binary, gw binary, rest binary"), "toxic-models")
        models.mix(made.toLocalIterator(), n)
        shared.destroy()
        dropped(made)
    return models


def unseen_rows(models: Together, rows: DataFrame, names: list[str]) -> DataFrame:
    """toxic, p: each row's mark and its probabilities, one for each category, by the models that left its fold out.
    The table is stored."""
    shared = rows.sparkSession.sparkContext.broadcast(models.thin())

    def run(batches):
        own = Together.whole(shared.value)
        for b in batches:
            x, _, fold = _read(b, names)
            for at in range(0, len(x), BATCH[1]):
                some = np.arange(at, min(at + BATCH[1], len(x)))
                p = own.predicted(*x.take(some), fold[some])[1]
                yield pa.RecordBatch.from_arrays([b.column("toxic").slice(at, len(some)), pa.array(list(p), pa.list_(pa.float64()))], names=["toxic", "p"])

    out = stored(rows.mapInArrow(run, "toxic boolean, p array<double>"), "toxic-unseen")
    shared.destroy()
    return out


def from_top(values: DataFrame, place: int) -> float:
    """The value at a place, from 0, of a table's one column in descending order: ranges are counted in parts, and the
    part that holds the place is counted in parts again. Of each count ``BINS`` rows come back."""
    p = values.columns[0]
    low, high = values.agg(F.min(p), F.max(p)).first()
    while low < high:
        part = F.least(F.floor((F.col(p) - low) / (high - low) * BINS), F.lit(BINS - 1))
        found = values.where(F.col(p).between(low, high)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(p).alias("low"), F.max(p).alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r.part):
            if place < r.n:
                low, high = r.low, r.high
                break
            place -= r.n
    return low


def lowest_threshold_of(rows: DataFrame, wrong: float) -> float:
    """``lowest_threshold`` of a table of any size (p, toxic)."""
    clean = rows.where("not toxic")
    n, marked = rows.agg(F.count_if(~F.col("toxic")), F.count_if("toxic")).first()
    if not n or not marked:
        return 0.5
    cut = from_top(clean.select("p"), int(wrong * n))
    above = rows.where(F.col("p") > cut).agg(F.min("p")).first()[0]
    return float(np.nextafter(cut, 2)) if above is None else float((cut + above) / 2)


def train(docs: DataFrame, labels: DataFrame, languages: tuple[str, ...] = LANGUAGES, decays: tuple[float, ...] = DECAYS, wrong: float = WRONG) -> Chain:
    """The chain fitted on all labelled rows that are not held out, and its threshold from all of them.

    Null labels and labels without a document are left out; of several labels of a document the largest holds, of
    several rows of a document the one of the least text. Without a column lang only the last category has toxic rows.
    """
    small_batches(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    some = docs.select("doc_id", F.col("text").cast("string").alias("text"), lang.alias("lang")).join(known, "doc_id")
    some = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("row"))
    names = categories(languages)
    marks = [F.coalesce((F.col("toxic") > 0) & (F.col("row.lang") == x), F.lit(False)).alias(f"toxic_{x}") for x in languages]
    place = F.xxhash64(F.lit(SEED), "doc_id")
    some = some.select(place.alias("place"), F.pmod(place, F.lit(FOLDS)).cast("int").alias("fold"), F.col("row.text").alias("text"), *marks, (F.col("toxic") > 0).alias("toxic"))

    def run(batches):
        for b in batches:
            idx = pa.array([features(t).astype("<i4").tobytes() for t in b.column("text").to_pylist()], pa.binary())
            yield with_arrow(b.drop_columns(["text"]), idx=idx)

    rows = some.mapInArrow(run, "place long, fold int, " + ", ".join(f"{c} boolean" for c in names) + ", idx binary")
    rows = stored(rows.sortWithinPartitions("place"), "toxic-rows")
    n, toxic = np.zeros(FOLDS), np.zeros((FOLDS, len(names)))
    for r in rows.groupBy("fold").agg(F.count(F.lit(1)), *(F.count_if(c) for c in names)).collect():
        n[r[0]], toxic[r[0]] = r[1], r[2:]
    total = int(n.sum())

    decay = decays[0]
    if len(decays) > 1 and total:
        # The last category alone, once for each pull.
        pairs, last = [(d, f) for d in range(len(decays)) for f in range(FOLDS)], [names[-1]] * len(decays)
        tried = Together([d for d, _ in pairs], [f for _, f in pairs], [decays[d] for d, _ in pairs], False, n, np.tile(toxic[:, -1:], len(decays)))
        told = unseen_rows(fit_together(tried, rows, last, total), rows, last)
        sure = [F.greatest(F.least(F.col("p")[d], F.lit(1 - 1e-9)), F.lit(1e-9)) for d in range(len(decays))]
        loss = told.agg(*(F.sum(-F.log(F.when(F.col("toxic"), p).otherwise(1 - p))) for p in sure)).first()
        decay = decays[int(np.argmin(loss))]
        dropped(told)
    pairs = [(c, f) for c in range(len(names)) for f in (-1, *range(FOLDS))]
    models = fit_together(Together([c for c, _ in pairs], [f for _, f in pairs], [decay] * len(pairs), True, n, toxic), rows, names, total)
    told = unseen_rows(models, rows, names)
    threshold = lowest_threshold_of(told.select("toxic", F.col("p")[len(names) - 1].alias("p")), wrong)
    dropped(rows, told)
    whole = [pairs.index((c, -1)) for c in range(len(names))]
    return Chain([Linear(float(models.rest[0, k]), models.w[k].astype(float), models.rest[2 : 2 + c, k]) for c, k in enumerate(whole)], threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float | None = None, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """doc_id, held_out, p_<category> for each category, toxic (1 where the last reaches the threshold).

    One row per row of ``docs``; whole texts count, null texts as empty. Equal texts get equal probabilities. Without
    usable labels of both classes the probability is their smoothed share. Empty table: no rows. The threshold is the
    fitted one unless given.
    """
    made = train(docs, labels, languages)
    threshold = made.threshold if threshold is None else threshold
    shared = docs.sparkSession.sparkContext.broadcast([(m.bias, m.w.astype("f4"), m.of_earlier) for m in made.models])  # of fixed size
    names = [f"p_{c}" for c in categories(languages)]

    def run(batches):
        fitted = Chain([Linear(*m) for m in shared.value], 0.0)
        for b in batches:
            p = fitted.probabilities(Rows([features(t) for t in b.column("text").to_pylist()]))
            yield with_arrow(b.drop_columns(["text"]), **{n: pa.array(p[:, k]) for k, n in enumerate(names)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} double" for n in names))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), *names, (F.col(names[-1]) >= threshold).cast("int").alias("toxic"))


def op6_toxic_chain(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
