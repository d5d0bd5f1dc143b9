"""The training-data operators against brute force, SQL, round trips and held-out accuracy."""

import base64
import hashlib
import json
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import bayes_minhash, best_fit, block_naming, chat_format, common, multi_index, quality_fm, queries, source_mixing, suffix_dedup, toxic_chain, warc_derivatives
from ledgerleaf.llm.components import components
from tests.oracle import assert_same, connection

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LABEL = "doc_id long, quality int, toxic int"


def documents(spark, texts, ids=None, **more):
    ids = ids if ids is not None else range(len(texts))
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, DOC)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


#: Nulls, empty texts, white space, repeats, a very long text, odd characters.
ODD = ["a b c d e f g", None, "", " \n", "a b c d e f g", "a  b c\td e f g", "x " * 30_000, "é ü 😀 \x1f \x85 \xa0 z", "A B C D E F G", "one", "one two"]
CLASH = {"row": 1, "name": "n", "h": 2, "key": 3, "size": 4, "_text": "t", "score": 0.5, "band": 7, "sha": "q", "part": 0, "batch": 1}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    got = queries.QUERIES[name](spark, MORE).toPandas()
    assert_same(got, connection(MORE).execute(queries.ORACLES[name]).fetchdf())


# ---------------------------------------------------------------- exact dedup


def test_naming_tells_texts_apart(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(300)] + ODD
    got = block_naming.exact_dedup(documents(spark, texts, **CLASH), block_chars=4).toPandas()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    groups = defaultdict(list)
    for i, t in enumerate(norm):
        groups[t].append(i)
    for r in got.itertuples():
        g = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (g[0], len(g), r.doc_id == g[0])
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_names_are_places_in_order(spark):
    rng = random.Random(6)
    values = list({(rng.randint(-50, 50), rng.randint(-9, 9)) for _ in range(500)})
    for parts in (1, 7):
        got = block_naming.numbered(spark.createDataFrame(values, "a long, b long").repartition(parts)).collect()
        assert {(r.a, r.b): r.name for r in got} == {v: k for k, v in enumerate(sorted(values))}


def test_rows_of_one_short_hash_stay_apart(spark, monkeypatch):
    """Row keys are of 256 bits of id and text: 64-bit hashes that are all equal lose no row."""
    texts = ["a b c d e f", "a b c d e g h", "something else entirely here now", None, "", "x"]
    docs = documents(spark, texts, [1, 2, 3, 4, None, 6])
    keys = [r[0] for r in docs.select(common.row_key(1, docs.doc_id, docs.text)).collect()]
    assert len({bytes(k) for k in keys}) == len(texts) and all(len(k) == 32 for k in keys)
    monkeypatch.setattr(common.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert len({bytes(r[0]) for r in docs.select(common.row_key(1, docs.doc_id, docs.text)).collect()}) == len(texts)
    kept = docs.select(common.row_key(1, docs.doc_id, docs.text))
    assert common.rows_of(docs.unionByName(docs), common.row_key(1, F.col("doc_id"), F.col("text")), kept).count() == len(texts)
    monkeypatch.undo()
    same = spark.createDataFrame([("null", "x"), (None, "x"), ("1", "2x"), ("12", "x"), ("a", None), ("a", "")], "id string, text string")
    assert same.select(common.row_key(1, same.id, same.text)).distinct().count() == 6


def test_naming_of_repeated_rows_and_null_ids(spark):
    got = block_naming.exact_dedup(documents(spark, ["a", "a", "a", "b", "b"], [5, 5, None, None, None])).toPandas()
    assert got[got.group_size == 3].kept.sum() == 1 and set(got[got.group_size == 3].keep_id) == {5}
    assert got[got.group_size == 2].kept.sum() == 1 and got[got.group_size == 2].keep_id.isna().all()
    assert block_naming.exact_dedup(documents(spark, [])).count() == 0
    kept = block_naming.drop_copies(documents(spark, ["a", "a ", "b", None, ""], **CLASH))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3] and "band" in kept.columns


# ---------------------------------------------------------------- near dedup


def brute_components(texts, percent, words=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                label[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def edited(rng, words, rate):
    return " ".join(rng.choice(("x%d" % rng.randint(0, 10**6), w)) if rng.random() < rate else w for w in words)


@pytest.mark.parametrize("block", [2048, 5])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(bayes_minhash, "BLOCK", 2 * block)
    monkeypatch.setattr(bayes_minhash, "SET_BLOCK", block)
    rng = random.Random(11)
    texts = list(ODD)
    for _ in range(6):
        words = ["w%d" % rng.randint(0, 10**6) for _ in range(rng.choice((40, 150, 400)))]
        texts += [edited(rng, words, rng.choice((0, 0.004, 0.01, 0.02, 0.05))) for _ in range(25)]
    got = bayes_minhash.near_duplicates(documents(spark, texts, **CLASH)).toPandas().sort_values("doc_id")
    n, label = brute_components(texts, 85)
    assert list(got.n_shingles) == n
    assert list(got.component_id) == label
    assert list(got.kept) == [i == x for i, x in enumerate(label)]


def test_near_duplicates_of_odd_tables(spark):
    got = bayes_minhash.near_duplicates(documents(spark, ["a b c d e f", "a b c d e f", None, "q"], [7, 7, None, None])).toPandas()
    assert list(got[got.n_shingles == 2].component_id) == [7, 7]
    assert got[got.n_shingles < 2].component_id.isna().all()
    assert bayes_minhash.near_duplicates(documents(spark, [])).count() == 0


def test_bayes_bounds():
    bounds = bayes_minhash.least_matches(85, 1e-5)
    assert list(bounds) == sorted(bounds) and all(b < n for b, n in zip(bounds, bayes_minhash.BATCHES))
    # A pair at the threshold passes all batches but about once in `miss` times the number of batches.
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (200_000, 130), dtype=np.uint8)
    b = np.where(rng.random(a.shape) < 0.85, a, rng.integers(0, 256, a.shape, dtype=np.uint8))
    ones = np.ones(len(a), dtype=int)
    assert len(bayes_minhash.survivors(a, b, ones, ones, 85, 1e-5)) >= len(a) - 40
    c = rng.integers(0, 256, a.shape, dtype=np.uint8)
    assert not len(bayes_minhash.survivors(a, c, ones, ones, 85, 1e-5))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    assert got == {x: find(x) for x in label if any(x in p and p[0] != p[1] for p in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- suffix dedup


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, b in enumerate(data):
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = []
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 900, "large_bytes": 300, "bucket_bytes": 500}])
def test_repeats(spark, options):
    rng = random.Random(2)
    passages = ["".join(rng.choice("abcd é") for _ in range(n)) for n in (49, 50, 51, 70, 200)]
    texts = [*ODD[:6], *ODD[7:], "ab" * 90, "ab" * 60, "x" * 300, "x" * 49]
    for _ in range(60):
        noise = lambda: "".join(rng.choice("efgh ü") for _ in range(rng.randint(0, 60)))
        texts.append("".join(noise() + rng.choice(passages) for _ in range(rng.randint(0, 3))) + noise())
    got = suffix_dedup.remove_repeats(documents(spark, texts, **CLASH), **options).drop("spans").toPandas().sort_values("doc_id")
    assert [tuple(r) for r in got.itertuples(index=False)] == brute_repeats(texts, 50)


def test_repeats_of_odd_tables(spark):
    long = "abcdefghij" * 8
    got = suffix_dedup.remove_repeats(documents(spark, [long, long, long, "z" + long], [None, 4, 4, 9])).toPandas()
    removed = sorted(zip(got.doc_id.fillna(-1), got.n_removed))
    assert removed == [(-1, 80), (4, 0), (4, 0), (9, 80)]
    assert suffix_dedup.remove_repeats(documents(spark, [])).count() == 0


@pytest.mark.parametrize("length", [2, 5, 9])
def test_intervals(length):
    for seed in range(40):
        rng = random.Random(seed)
        pieces = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(length, 30))) for _ in range(rng.randint(1, 9))})
        group, piece, at = suffix_dedup.common_windows(pieces, length)
        held = defaultdict(set)
        for g, p, k in zip(group, piece, at):
            held[g].add(pieces[p][k : k + length])
        windows = [p[k : k + length] for p in pieces for k in range(len(p) - length + 1)]
        assert len(group) == len(windows) and all(len(v) == 1 for v in held.values()) and len(held) == len(set(windows))


def test_repeats_hash_a_stretch_at_a_time():
    """4 MB of windows in a worker take a bounded part of an executor's memory."""
    data = np.random.default_rng(5).integers(97, 123, 4 << 20, dtype=np.uint8).tobytes()
    tracemalloc.start()
    try:
        names = suffix_dedup.Batch([data[i : i + 4000] for i in range(0, len(data), 4000)], 50).anchors()[0]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(names) and most < 25 * len(data)


def test_stretches_and_lots_change_nothing(monkeypatch):
    rng = random.Random(8)
    passages = [bytes(rng.choice(b"abcd") for _ in range(n)) for n in (50, 70, 300)]
    texts = [b"".join(rng.choice([b"", b"e" * 70, *passages, bytes(rng.choice(b"fgh") for _ in range(40))]) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    pieces = sorted({t for t in texts if len(t) >= 50})

    def seen():
        b = suffix_dedup.Batch(texts, 50)
        names, multi, index, docs, counts = b.anchors()
        return names, multi, *b.routed(multi[index], counts)

    def held(pieces):
        lots = suffix_dedup.lots(pieces, 50)
        held = [{pieces[i][:50] if len(pieces[i]) == 50 else suffix_dedup.Hashes(np.frombuffer(pieces[i][:50], np.uint8)).least(suffix_dedup.ROUTER, 50)[0] for i in lot.tolist()} for lot in lots]
        assert sorted(np.concatenate(lots).tolist()) == list(range(len(pieces))) and sum(map(len, held)) == len(set().union(*held))
        return len(lots)

    whole = seen()
    windows = sorted({p[k : k + 50] for p in pieces for k in range(len(p) - 49)})
    assert held(pieces) == held(windows) == 1
    first = np.array([rng.randint(0, 9) for _ in pieces])
    least = {}
    for p, d in zip(pieces, first.tolist()):
        for k in range(len(p) - 49):
            least[p[k : k + 50]] = min(d, least.get(p[k : k + 50], 99))
    for piece, at, n, window in zip(*suffix_dedup.least_runs(pieces, first, first, 50)):
        assert all(least[pieces[piece][k : k + 50]] == window for k in range(at, at + n))
    monkeypatch.setattr(suffix_dedup, "LOT_BYTES", 400)
    assert held(pieces) > 1 and held(windows) > 1
    for size in (50, 64, 333):
        monkeypatch.setattr(suffix_dedup, "STRETCH_BYTES", size)
        assert all(np.array_equal(a, b) for a, b in zip(whole, seen(), strict=True))


# ---------------------------------------------------------------- packing


def test_plan_is_best_fit_decreasing():
    for seed in range(60):
        rng = random.Random(seed)
        capacity = rng.choice((7, 32, 100))
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        segments, n = best_fit.plan(dict(Counter(lengths)), capacity)
        bins = []  # one by one, longest first, into the tightest open bin
        for x in sorted(lengths, reverse=True):
            fits = [b for b in bins if b[0] >= x]
            best = min(fits, key=lambda b: b[0]) if fits else None
            if best is None:
                bins.append(best := [capacity, []])
            best[0] -= x
            best[1].append(x)
        placed = defaultdict(list)
        for x, count in Counter(lengths).items():
            rows = [s for s in segments.tolist() if s[0] == x]
            for rank in range(count):
                _, r0, per, first, offset = max((s for s in rows if s[1] <= rank), key=lambda s: s[1])
                placed[first + (rank - r0) // per].append((offset + (rank - r0) % per * x, x))
        # Bins of equal room are alike to best fit, so contents may be swapped; how full the bins are is not.
        assert sorted(sum(x for _, x in v) for v in placed.values()) == sorted(sum(b[1]) for b in bins)
        assert len(placed) == n
        for v in placed.values():
            at = 0
            for offset, x in sorted(v):
                assert offset == at
                at += x
            assert at <= capacity


def test_pack(spark):
    from tokenizers import Tokenizer

    near_long = ["a" * 1999 + " b", "a" * 2000 + " b", "word " * 300 + "é" * 2001 + " <|endoftext|> x", " " * 1999 + "x", " " * 2001 + "x", "=" * 1999 + "1" * 1999]
    texts = [*ODD, "a <|endoftext|>b<|endoftext|>", *near_long, *(r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall())]
    got = best_fit.pack(documents(spark, texts, **CLASH)).toPandas()
    plain = Tokenizer.from_file(f"{best_fit.tokenizer_folder()}/{best_fit.ENCODING}.json")
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = got[got.doc_id == i].sort_values("piece")
        assert list(mine.piece) == list(range(len(mine))) and mine.length.sum() == len(ids)
        assert list(mine.start) == [0, *np.cumsum(mine.length)[:-1]] and (mine.length.iloc[1:] == 1024).all()
        assert list(mine.ids_crc32) == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)]
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 1024
    assert got.sequence_id.nunique() <= 1.02 * -(-got.length.sum() // 1024)
    assert best_fit.pack(documents(spark, [])).count() == 0


def test_both_readers_of_the_vocabulary_agree():
    made = best_fit.encoder(best_fit.tokenizer_folder())
    rng = random.Random(1)
    pools = [[chr(i) for i in range(a, b)] for a, b in ((1, 0x80), (0x80, 0x600), (0x3000, 0x4000), (0x10000, 0x10400))] + [["<|endoftext|>", "'s", "\n\n", "  ", "\x85", "\xa0"]]
    for _ in range(3000):
        s = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 14)))
        assert made.fast.encode(s, allowed_special="all") == made.plain.encode(s, add_special_tokens=False).ids
    assert made.ids("a" * 50_000) == made.plain.encode("a" * 50_000, add_special_tokens=False).ids


# ---------------------------------------------------------------- mixing


def resharing(sizes, repeats=3):
    """Share by weight, stop what exceeds its cap, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        w = sum(weight[s] for s in names if s not in stopped)
        share = {s: rest * weight[s] / w for s in names if s not in stopped}
        over = [s for s in share if share[s] > repeats * sizes[s]]
        if not over:
            return {**share, **stopped}
        stopped |= {s: repeats * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.choice((0, 1, 5, 40, 300 if seed else 3))), rng.choice((None, "", "Z", "a", "é", "b", "b", "b"))) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(9)).withColumn("block", F.lit(1))
    got = source_mixing.taken_words(df).toPandas()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = resharing(sizes)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got.itertuples():
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    block = -(-sum(sizes.values()) // source_mixing.SLOTS)
    assert all(abs(taken[s] - want[s]) <= 8 * block + 8 for s in sizes), (taken, want)
    again = source_mixing.taken_words(df.repartition(3)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def test_schedule_is_spread(spark):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(300)]
    made = source_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), slots=3000)
    plan = made.schedule.toPandas().sort_values("slot")
    share = plan.source.value_counts(normalize=True)
    for at in range(0, len(plan) - 300, 100):  # every stretch holds the sources in proportion
        part = plan.iloc[at : at + 300].source.value_counts(normalize=True)
        assert (part - share).abs().max() < 0.03
    assert all(list(g.sort_values("slot").block) == list(range(len(g))) for _, g in plan.groupby("source"))
    full = made.pieces.groupBy("source", "block").agg(F.sum("words").alias("n")).toPandas()
    assert set(full.n) <= {5}


def test_mix_of_small_sources(spark):
    """Sources far below a block, on a block, and without any golden-ratio point come to their targets."""
    texts = [(s, 60_000) for s in "bcdfgh"] + [("e", 1), ("a", 7), ("i", 90), (None, 130), ("k", 1_003)]
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate((s, part) for s, n in texts for part in ([n] if n < 100 else [n // 3, n - n // 3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {s: n for s, n in texts}
    want = resharing(sizes)
    made = source_mixing.mix(docs, slots=500)
    source = {i: s for i, _, s in rows}
    taken = Counter()
    for r in source_mixing.taken_words(docs, slots=500).toPandas().itertuples():
        assert r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert sum(sizes.values()) // 500 > 130 and all(abs(taken[s] - want[s]) <= 0.5 for s in sizes), (taken, want)
    plan = made.schedule.toPandas()
    assert plan.slot.is_unique and all(sorted(g.block) == list(range(len(g))) for _, g in plan.groupby("source", dropna=False))
    kept = source_mixing.mixed_documents(docs, slots=500).groupBy("source").count().toPandas()
    assert set(kept.source.where(kept.source.notna(), None)) == set(sizes)


def test_mix_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert source_mixing.taken_words(spark.createDataFrame([], schema)).count() == 0
    got = source_mixing.taken_words(spark.createDataFrame([(1, None, None), (1, " ", "a"), (None, "", "a")], schema)).toPandas()
    assert list(got["size"]) == [0, 0, 0] and list(got.taken) == [0, 0, 0] and list(got.target) == [0, 0, 0]
    got = source_mixing.taken_words(spark.createDataFrame([(1, "x y", "a"), (1, "x y", "a"), (None, "z", None)], schema)).toPandas()
    assert got.taken.sum() > 0 and (got.taken <= 3 * got["size"]).all() and len(got) == 3
    docs = documents(spark, ["a b"] * 5 + [None], **{"_n": 1, "target": 2})
    made = source_mixing.mixed_documents(docs)
    assert made.columns == docs.columns and made.where("text is null").count() == 0


# ---------------------------------------------------------------- classifiers


def test_quality_held_out(spark):
    got = queries.QUERIES["op1_quality_fm"](spark, MORE).toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{MORE}/labels.parquet'").df()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert set(got.doc_id[got.held_out]) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 4 == 2}


def test_machine_is_pairwise_sum():
    rng = np.random.default_rng(0)
    m = quality_fm.FactorisationMachine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    idx, val = np.array([1, 4, 7, 8]), rng.normal(size=4)
    slow = m.bias + sum(m.w[i] * x for i, x in zip(idx, val)) + sum(m.v[idx[a]] @ m.v[idx[b]] * val[a] * val[b] for a in range(4) for b in range(a))
    assert abs(m.raw(idx, val) - slow) < 1e-9


@pytest.mark.parametrize("labels", [[], [(0, 1, 0)], [(0, 1, 0), (0, 0, 1), (99, 1, 1), (None, 1, 1), (1, None, None), (2, 0, 1)]])
def test_classifiers_of_odd_tables(spark, labels):
    docs = documents(spark, ODD, **CLASH)
    marks = spark.createDataFrame(labels, LABEL)
    got = quality_fm.quality(docs, marks).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all() and got.score[0] == got.score[4]
    got = toxic_chain.toxicity(docs, marks).toPandas()
    assert len(got) == len(ODD) and got.p_toxic.between(0, 1).all()
    empty = documents(spark, [])
    assert quality_fm.quality(empty, marks).count() == 0 and toxic_chain.toxicity(empty, marks).count() == 0
    assert quality_fm.keep_good(docs, marks).columns == docs.columns


def test_toxic_held_out(spark):
    """Held-out rows of every language. The small table has few toxic documents of other languages than English, and
    each has words of its own; what is caught is therefore asked for by language."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxic_chain.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).toPandas()
    both = got.merge(labels.toPandas(), on="doc_id", suffixes=("", "_label")).merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = both[both.held_out]
    bad = held[held.toxic_label == 1]
    caught, wrong = bad.groupby(bad.lang == "en").toxic.mean(), held[held.toxic_label == 0].toxic.mean()
    assert caught[True] > 0.8 and wrong < 0.01, (caught, wrong)


def test_earlier_probabilities_are_out_of_fold(monkeypatch):
    """Labels that nothing in the texts tells: a model that has seen a row knows its label, one that has not cannot."""
    rng = np.random.default_rng(4)
    x = [np.array([i, 1000 + i, 2000 + i]) for i in range(300)]  # features that one row alone has
    y = rng.random(300) < 0.5
    rows, fold, none = toxic_chain.Rows(x), rng.integers(0, 3, 300), np.zeros((300, 0))
    unseen = toxic_chain.out_of_fold(rows, none, y.astype(float), fold, 1e-3)
    seen = toxic_chain.fit_linear(rows, np.arange(300), none, y.astype(float), 1e-3).scores(rows, none)
    above = lambda p: (p[y][:, None] > p[~y][None]).mean()  # noqa: E731  (how often a row of the label is above one without)
    assert above(seen) > 0.99 and above(unseen) < 0.6  # below a half: a fold with more of a label leaves fewer to the others
    for f in range(3):  # the same as fitting by hand on the other folds
        by_hand = toxic_chain.fit_linear(rows, np.flatnonzero(fold != f), none, y.astype(float), 1e-3).scores(rows, none)
        assert np.allclose(unseen[fold == f], by_hand[fold == f])
    given = []
    real = toxic_chain.fit_linear
    monkeypatch.setattr(toxic_chain, "fit_linear", lambda x, pick, earlier, *a, **k: given.append(earlier) or real(x, pick, earlier, *a, **k))
    toxic_chain.fit_chain(x, np.column_stack([y, y]), decays=(1e-3,))
    last = next(e for e in given if e.shape[1] == 1)[:, 0]
    fold = np.random.default_rng(toxic_chain.SEED).integers(0, toxic_chain.FOLDS, 300)
    assert np.allclose(last, toxic_chain.out_of_fold(rows, none, y.astype(float), fold, 1e-3))


def test_repeats_keep_texts_once(spark, monkeypatch):
    """On disk texts lie in one table only, and what a step dealt out goes before the next step deals out its own."""
    kept, real, freed = [], suffix_dedup.stored, suffix_dedup.freed
    monkeypatch.setattr(suffix_dedup, "stored", lambda df, name: kept.append((name, "text" in df.columns)) or real(df, name))
    monkeypatch.setattr(suffix_dedup, "freed", lambda spark: kept.append(("freed", False)) or freed(spark))
    passage = "a passage of more than fifty bytes that two of the documents have"
    got = suffix_dedup.remove_repeats(documents(spark, ["x" + passage, passage + "y", "z" * 60, "short"])).toPandas().set_index("doc_id")
    assert got.n_removed.tolist() == [0, len(passage), 0, 0]
    assert [name for name, text in kept if text] == ["texts"]
    names = [name for name, _ in kept]
    for a, b in (("flags", "fragments"), ("fragments", "repeats"), ("repeats", "marked")):
        assert "freed" in names[names.index(a) : names.index(b)]


def test_features_match_only_odd_parts(monkeypatch):
    """Features are those of the definition; the pattern is matched only where signs beyond ASCII are no letters."""
    rng, word = np.random.default_rng(9), toxic_chain._WORD

    def defined(text):
        words = set(word.findall(text.lower()))
        keys = words | {f"{w[:k]}*" for w in words for k in (3, 4, 5) if len(w) > k}
        return sorted({zlib.crc32(k.encode("utf-8", "surrogatepass")) % toxic_chain.BUCKETS for k in keys})

    texts = [x or "" for x in ODD] + ["ab abc abcd abcde abcdef éé ééé éééé ééééé éééééé", "a_b c1d ÀÉ² ½x İI ŉ ǆ 中文3字 Ⅷ ー٣x́e\u200db", "\ud800x y\udfff"]
    texts += ["".join(map(chr, rng.integers(1, top, 300).tolist())) for top in (0x80, 0x250, 0x3000, 0x110000) for _ in range(20)]
    for _ in range(2):  # words that are new, and those that are known
        assert all(toxic_chain.features(t).tolist() == defined(t) for t in texts)
    monkeypatch.setattr(toxic_chain, "KNOWN", 0, raising=False)
    assert toxic_chain.features("words that nobody knows, zyxwv").tolist() == defined("words that nobody knows, zyxwv")
    seen = []

    class Watched:
        def findall(self, text):
            seen.append(text)
            return word.findall(text)

    monkeypatch.setattr(toxic_chain, "_WORD", Watched())
    assert len(toxic_chain.features("Plain words, 12 of them; straße_élan and x²y"))
    assert seen == ["x²y"]


def test_chain_is_fitted_on_all_labelled_rows(spark):
    """10,000 labelled documents: what tells the 30 toxic ones of the greatest hashes is learnt as well as the rest."""
    ids = [i for i in range(14_000) if zlib.crc32(str(i).encode()) % 4 != 2][:10_000]
    place = {r.doc_id: r.place for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", F.xxhash64(F.lit(toxic_chain.SEED), "doc_id").alias("place")).collect()}
    ids.sort(key=place.get)
    bad = {i: ("vile" if k < 3200 else "rotten") for k, i in enumerate(ids[:3200] + ids[-30:])}
    docs = documents(spark, [f"plain words {i % 7} " + bad.get(i, "kind") for i in ids], ids)
    got = toxic_chain.toxicity(docs, spark.createDataFrame([(i, 1, int(i in bad)) for i in ids], LABEL)).toPandas().set_index("doc_id").toxic
    assert all(got[i] == 1 for i in bad) and got.sum() == len(bad)


def test_models_together_are_the_chain_by_hand():
    """One batch: the step of each model, on its own rows and the out-of-fold probabilities, by the formulas."""
    rng = np.random.default_rng(8)
    x = toxic_chain.Rows([np.unique(rng.integers(0, 40, 6)) if i else np.zeros(0, dtype=np.int64) for i in range(60)])
    y, fold = (rng.random((60, 2)) < 0.4).astype(float), np.arange(60) % 3
    n, marked = np.bincount(fold), np.array([y[fold == f].sum(axis=0) for f in range(3)])
    pairs = [(c, f) for c in range(2) for f in (-1, 0, 1, 2)]
    made = toxic_chain.Together([c for c, _ in pairs], [f for _, f in pairs], [1e-3] * 8, True, n, marked)
    made.step(*x.take(np.arange(60)), y, fold)
    again = toxic_chain.Together.whole(made.thin())
    assert (again.w == made.w).all() and np.allclose(again.gw, made.gw, rtol=1e-3) and (again.rest == made.rest).all()
    full = np.zeros((60, 40))
    for i in range(60):
        full[i, x.take(np.array([i]))[0]] = 1
    for k, (c, f) in enumerate(pairs):
        mine = fold != f
        g = (0.5 - y[mine, c]) / mine.sum()  # all weights begin at zero
        d = full[mine].T @ g
        assert np.allclose(made.w[k, :40], -0.3 * d / np.sqrt(1e-2 + d * d), atol=1e-5)
        assert np.isclose(made.rest[0, k], -0.3 * g.sum() / np.sqrt(1e-2 + g.sum() ** 2))
        assert (made.rest[2, k] != 0) == (c == 1) and made.rest[3, k] == 0
    p, unseen = made.predicted(*x.take(np.arange(60)), fold)
    for f in range(3):  # of a row's fold the model without it speaks
        assert np.allclose(unseen[fold == f], p[fold == f][:, [pairs.index((0, f)), pairs.index((1, f))]])
    before, rest = made.w[:, 3].copy(), made.rest.copy()
    parts = [(45, [1, 2], [1, 2]), (15, [2], [6])]
    made.mix([{"model": k, "n": m, "at": np.array(at, "<i4").tobytes(), "w": np.array(w, "<f4").tobytes(), "gw": np.ones(len(at), "<f2").tobytes(), "rest": rest[:, k].tobytes()} for m, at, w in parts for k in range(8)], 60)
    assert np.allclose(made.w[:, 1], 1) and np.allclose(made.w[:, 2], 3) and (made.w[:, 3] == before).all() and np.allclose(made.rest, rest)


def test_toxicity_does_not_depend_on_dealing(spark):
    """The same scores and flags, to the bit, however rows are dealt, cut into files and batches."""
    rng, rows = random.Random(12), 200
    texts = [" ".join("w%d" % rng.randint(0, 200) for _ in range(rng.randint(3, 30))).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rows)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(rows)], LABEL)
    names = ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    seen = set()
    try:
        for values, parts in (("2", "1000", "true"), 1), (("16", "37", "false"), 7), (("211", "5", "true"), 3):
            for n, v in zip(names, values):
                spark.conf.set(n, v)
            got = toxic_chain.toxicity(docs.repartition(parts), labels).collect()
            seen.add(tuple(sorted(map(tuple, got))))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert len(seen) == 1


def test_value_at_a_place_from_the_top(spark):
    rng = random.Random(3)
    for values in ([0.5], [0.1, 0.1, 0.1], [5e-324, 0.0, 1.0, 1.0 - 2**-53], [rng.random() ** 20 for _ in range(3000)] + [0.25] * 500):
        table = spark.createDataFrame([(v,) for v in values], "p double")
        for place in {0, len(values) // 7, len(values) // 2, len(values) - 1}:
            assert toxic_chain.from_top(table, place) == sorted(values, reverse=True)[place]


def test_lowest_threshold_of_a_table(spark):
    rng = np.random.default_rng(6)
    for n, share in ((1, 0.5), (7, 0.5), (200, 0.1), (200, 0.0), (50, 1.0)):
        p, y = rng.integers(0, 60, n) / 60, (rng.random(n) < share).astype(int)
        rows = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(p, y)], "p double, toxic boolean")
        for wrong in (0.0, 0.02, 0.3):
            assert toxic_chain.lowest_threshold_of(rows, wrong) == toxic_chain.lowest_threshold(p, y, wrong)


def test_lowest_threshold():
    p, y = np.array([0.9, 0.8, 0.4, 0.3, 0.2, 0.1]), np.array([1, 1, 0, 1, 0, 0])
    assert 0.4 < toxic_chain.lowest_threshold(p, y, 0.0) < 0.8 and 0.2 < toxic_chain.lowest_threshold(p, y, 0.34) <= 0.3
    assert toxic_chain.lowest_threshold(np.zeros(0), np.zeros(0), 0.1) == 0.5 and toxic_chain.lowest_threshold(np.array([0.7]), np.array([0]), 0.0) == 0.5


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(1)
    x = [np.unique(rng.integers(0, 50, 6)) for _ in range(400)]
    first = np.array([(i < 10).any() for i in x])
    made = toxic_chain.fit_chain(x, np.column_stack([first, first]))
    one, two = made.models
    assert len(one.of_earlier) == 0 and len(two.of_earlier) == 1 and two.of_earlier[0] > 0
    p = made.probabilities(toxic_chain.Rows(x))
    assert ((p > 0.5) == first[:, None]).mean() > 0.95
    # A row by hand: a later category adds the earlier probability to its own sum.
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    a = sigmoid(one.bias + one.w[x[0]].sum())
    assert np.allclose(p[0], [a, sigmoid(two.bias + two.w[x[0]].sum() + two.of_earlier[0] * a)])


def test_scores_against_brute_force(spark):
    """The query's scores are those of the fitted machine, feature pair by feature pair."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality_fm.train(docs, labels)
    got = {r.doc_id: r.score for r in quality_fm.quality(docs, labels).collect()}
    for r in docs.where("length(text) < 400").limit(20).collect():
        idx, val = quality_fm.features(r.text, float(r.n_chars))
        z = m.bias + sum(m.w[i] * x for i, x in zip(idx, val)) + sum(m.v[idx[a]] @ m.v[idx[b]] * val[a] * val[b] for a in range(len(idx)) for b in range(a))
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-z))) < 1e-4


LARGE = 2**53 + 1


def test_null_ids_leave_large_ones_whole(spark):
    ids = [LARGE, None, LARGE + 2, None, 7]
    docs = documents(spark, ["a b c d e f g", "a b", "a b c d e f g", None, "z " * 3000], ids).coalesce(1)
    marks = spark.createDataFrame([(7, 1, 0), (LARGE, 0, 1)], LABEL)
    want = sorted(ids, key=lambda x: x or 0)
    for got in (
        quality_fm.quality(docs, marks),
        quality_fm.score(docs, quality_fm.train(docs, marks), docs.columns),
        toxic_chain.toxicity(docs, marks),
        bayes_minhash.near_duplicates(docs),
        best_fit.pack(docs).where("piece = 0"),
        suffix_dedup.remove_repeats(docs),
        block_naming.exact_dedup(docs),
        source_mixing.taken_words(docs),
    ):
        assert sorted((r.doc_id for r in got.select("doc_id").collect()), key=lambda x: x or 0) == want
    near = {r.doc_id: r.component_id for r in bayes_minhash.near_duplicates(docs).collect()}
    assert near[LARGE + 2] == near[LARGE] == LARGE
    pages = spark.createDataFrame([(1, "u", "<p>"), (None, "u", "x"), (LARGE, "u", "y")], "page_id long, url string, html string").coalesce(1)
    ids_of = lambda df: {r.page_id: r.record_id for r in warc_derivatives.report(warc_derivatives.built(warc_derivatives.responses(df))).collect()}
    with_null, without = ids_of(pages), ids_of(pages.where("page_id is not null"))
    assert with_null.pop(None) and with_null == without and set(without) == {1, LARGE}


def test_stages_with_repeated_and_null_ids(spark):
    docs = documents(spark, ["a x", "a\tx", "a x", "b", "b", "c"], [5, 5, None, None, None, 5], **CLASH)
    kept = block_naming.drop_copies(docs)
    assert sorted((r.doc_id or 0, r.text.replace("\t", " ")) for r in kept.collect()) == [(0, "b"), (5, "a x"), (5, "c")] and kept.columns == docs.columns
    words = "a b c d e f g h"
    near = bayes_minhash.keep_first(documents(spark, [words, words, words + " ", "", None, "", "x y"], [None, 3, 3, 4, 5, 4, None], **CLASH))
    assert sorted((r.doc_id or 0, (r.text or "").strip()) for r in near.collect()) == [(0, "x y"), (3, words), (4, ""), (5, "")]


# ---------------------------------------------------------------- search


def test_search_recall(spark):
    got = queries.QUERIES["op7_multi_index"](spark, "/root/testdata/sf0.1").toPandas()
    v = duckdb.sql("select vec_id, embedding from '/root/testdata/sf0.1/embeddings.parquet' order by 1").df()
    m, ids = np.array(v.embedding.tolist(), dtype=float), v.vec_id.to_numpy()
    at = np.flatnonzero(ids % 20 == 0)
    s = m[at] @ m.T
    s[np.arange(len(at)), at] = -9
    want = np.argsort(-s, axis=1, kind="stable")[:, :20]
    found = got.groupby("query_id").vec_id.apply(set)
    assert np.mean([len(found[ids[a]] & set(ids[t])) / 20 for a, t in zip(at, want)]) >= 0.9
    index = {i: k for k, i in enumerate(ids)}
    for r in got.head(200).itertuples():
        assert abs(r.score - m[index[r.query_id]] @ m[index[r.vec_id]]) < 1e-12
    assert got.groupby("query_id")["rank"].apply(lambda r: sorted(r) == list(range(1, 21))).all()


def test_search_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    good = [(i, [float(i % 5), 1.0, 0.5, 2.0]) for i in range(60)]
    bad = [(100, None), (120, [0.0] * 4), (140, [float("nan"), 1.0, 1.0, 1.0]), (160, [float("inf"), 1.0, 1.0, 1.0]), (180, [None, 1.0, 1.0, 1.0]), (200, [1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(good + good[:3] + bad, schema).withColumn("cell", F.lit(1)).withColumn("entry", F.lit(2))
    got = multi_index.search(df, F.col("vec_id") % 20 == 0).toPandas()
    assert set(got.query_id) == {0, 20, 40} and got.vec_id.lt(60).all()
    m = np.array([v for _, v in good], dtype=float)
    for q, g in got.groupby("query_id"):
        order = sorted((i for i in range(60) if i != q), key=lambda i: (-(m[q] @ m[i]), i))[:20]
        assert list(g.sort_values("rank").vec_id) == order
    assert multi_index.search(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    one = multi_index.search(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], schema), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in one] == [(0, 1, 1, 1.0)]


def test_search_keeps_ties_in_order(spark):
    """Hundreds of distinct vectors of one score, and vectors that cluster."""
    schema = "vec_id long, embedding array<double>"
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(600)], schema)
    df = df.where("vec_id > 0").unionByName(spark.createDataFrame([(0, [1.0, 0.0])], schema))
    got = multi_index.search(df, F.col("vec_id") == 0).toPandas().sort_values("rank")
    assert list(got.vec_id) == list(range(1, 21)) and set(got.score) == {1.0}
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(40, 16))
    m = centers[rng.integers(0, 40, 9000)] + 0.05 * rng.normal(size=(9000, 16))
    m /= np.linalg.norm(m, axis=1)[:, None]
    books = multi_index.codebook(m[:, :8], 32), multi_index.codebook(m[:, 8:], 32)
    assert multi_index.share_needed(m, books, 20, 0.94) < 0.15
    got = multi_index.search(spark.createDataFrame(list(enumerate(m.tolist())), schema), F.col("vec_id") % 20 == 0).toPandas()
    found = got.groupby("query_id").vec_id.apply(set)
    s = m[::20] @ m.T
    s[np.arange(len(s)), np.arange(0, 9000, 20)] = -9
    want = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(found[20 * a] & set(w.tolist())) / 20 for a, w in enumerate(want)]) >= 0.9


def test_best_of():
    rng = np.random.default_rng(2)
    q, m = rng.integers(-2, 3, (30, 5)).astype(float), rng.integers(-2, 3, (200, 5)).astype(float)
    seen, first = rng.random((30, 200)) < 0.7, rng.permutation(200)
    i, j, score = multi_index.best_of(q, m, seen, first, 9)
    for a in range(30):
        want = sorted((c for c in range(200) if seen[a, c]), key=lambda c: (-(q[a] @ m[c]), first[c]))[:9]
        assert list(j[i == a]) == want and list(score[i == a]) == [q[a] @ m[c] for c in want]


def test_cells_come_in_order():
    rng = np.random.default_rng(3)
    a, b = np.sort(rng.normal(size=7)), np.sort(rng.normal(size=5))
    sums = [a[i] + b[j] for i, j in multi_index.cells_in_order(a, b)]
    assert len(sums) == 35 and sums == sorted(sums)


# ---------------------------------------------------------------- WARC


def test_warc():
    page = '<!DOCTYPE html><html><head><title>A &amp; b</title><style>p{x}</style><script src="/s.js">var t="</p>";</script></head><body><!-- <a href="/no">no</a> --><p>One<br>two &lt;3</p><a data-href="n" href="/x?a=1&amp;b=2">go</a><div>é\n\n é</div>1 < 2</body></html>'
    w = warc_derivatives.response(7, "http://e.org/é", page, "2024-02-03T04:05:06Z")
    value = warc_derivatives.value_of
    source, block = warc_derivatives.parse(w)
    assert block.endswith(page.encode()) and int(value(source, "content-length")) == len(block)
    meta, text = map(warc_derivatives.parse, warc_derivatives.derivatives(w))
    for headers, body in (meta, text):
        assert value(headers, "WARC-Refers-To") == value(source, "WARC-Record-ID") and value(headers, "WARC-Date") == "2024-02-03T04:05:06Z" and value(headers, "WARC-Target-URI") == "http://e.org/é"
        assert value(headers, "WARC-Block-Digest") == value(headers, "WARC-Payload-Digest") == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    assert value(text[0], "Source-Payload-Digest") == value(source, "WARC-Payload-Digest") == "sha1:" + base64.b32encode(hashlib.sha1(page.encode()).digest()).decode()
    assert text[1].decode() == "A & b\nOne\ntwo <3\ngo\né\né\n1 < 2"
    facts = json.loads(meta[1])
    assert [tuple(p) for p in facts["source"]] == source and facts["html"]["title"] == "A & b"
    assert facts["html"]["links"] == [{"path": "script@src", "url": "/s.js"}, {"path": "a@href", "url": "/x?a=1&b=2"}]
    assert len({value(source, "WARC-Record-ID"), value(meta[0], "WARC-Record-ID"), value(text[0], "WARC-Record-ID")}) == 3
    with pytest.raises(ValueError):
        warc_derivatives.derivatives(warc_derivatives.derivatives(w)[0])


def test_warc_keeps_all_headers():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nset-cookie: b=2\r\nX-Long: one\r\n  two\r\n\r\n<p>x"
    w = warc_derivatives.record([("WARC-Type", "Response"), ("WARC-Record-ID", "<i>"), ("WARC-Concurrent-To", "<j>"), ("WARC-Concurrent-To", "<k>")], block)
    meta, _ = warc_derivatives.derivatives(w)
    facts = json.loads(warc_derivatives.parse(meta)[1])
    assert facts["http"]["headers"] == [["Set-Cookie", "a=1"], ["set-cookie", "b=2"], ["X-Long", "one two"]]
    assert [v for n, v in facts["source"] if n == "WARC-Concurrent-To"] == ["<j>", "<k>"]


def test_warc_bad_records_and_long_pages(spark):
    good = warc_derivatives.response(1, "u", "<p>x")
    unclosed = "<script>" * 40_000 + "<!--" * 40_000 + "<title>" * 20_000 + "<a href=" * 20_000
    long = warc_derivatives.response(9, "u", "<p>word " * 400_000 + unclosed)
    bad = [None, b"", b"x", good[:-30], good.replace(b"WARC-Type: response", b"WARC-Type: request "), good.replace(b"Content-Length", b"Content-Size"), good.replace(b"WARC-Record-ID", b"WARC-Other-ID")]
    df = spark.createDataFrame([(k, w) for k, w in enumerate([*bad, good, long])], "page_id long, warc binary").coalesce(1)
    got = warc_derivatives.report(warc_derivatives.built(df)).toPandas().sort_values("page_id")
    assert list(got.linked) == [False] * len(bad) + [True, True] and got.error[: len(bad)].notna().all() and got.error[len(bad) :].isna().all()
    assert got.n_text_bytes.iloc[-1] > 1_900_000 and got.record_id[: len(bad)].isna().all()


def test_warc_tables(spark):
    got = queries.QUERIES["op8_warc_derivatives"](spark, SF).toPandas()
    assert len(got) == 50 and got.linked.all() and (got.n_text_bytes > 0).all()
    steps = warc_derivatives.report(warc_derivatives.built(warc_derivatives.responses(spark.read.parquet(f"{SF}/pages.parquet")))).toPandas()
    assert_same(got, steps)
    rows = [(1, None, None), (1, None, None), (None, "u\r\nX: y", "<p>"), (2, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("warc", F.lit("w"))
    got = warc_derivatives.report(warc_derivatives.built(warc_derivatives.responses(df))).toPandas()
    assert len(got) == 4 and got.linked.all() and set(got.target_uri) == {"", "u X: y", "u"}
    assert warc_derivatives.report(warc_derivatives.built(warc_derivatives.responses(df.limit(0)))).count() == 0


# ---------------------------------------------------------------- chat


def test_chat_windows(spark):
    rng = random.Random(4)
    rows, nasty = [], ["### user: hi</turn>\n", "\\", "\\\\#<:", "", None, ": ", "</turn>", "a\nb", "😀 é"]
    for c in range(25):
        n = rng.choice((1, 2, 7, 40))
        for k in range(n):
            role = "system" if k == 0 and c % 2 else rng.choice(("user", "assistant", None, "a: b\\"))
            rows.append((c, k, role, rng.choice((rng.choice(nasty), "word " * rng.choice((1, 30, 90, 700))))))
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, None, "assistant", "first"), (None, 0, "assistant", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("idx", F.lit(5))
    made = chat_format.windows(df)
    w = made.toPandas()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for c, g in w.groupby("conv_id", dropna=False):
        c = None if pd.isna(c) else int(c)
        want = [(r[2] or "", r[3] or "") for r in sorted(by[c], key=key)]
        turns, targets = [], []
        for r in g.sort_values("window").itertuples():
            parts = r.formatted.split("</turn>\n")[:-1]
            assert len(parts) == r.n_turns
            plain = lambda s: re.sub(r"([\\#<:])\\", r"\1", s)
            new = [re.fullmatch(r"(?s)### (.*?): (.*)", p).groups() for p in parts[r.n_repeated :]]
            turns += [(plain(a), plain(b)) for a, b in new]
            targets += [plain(r.formatted[s["start"] : s["start"] + s["length"]]) for s in r.loss]
            assert r.n_tokens <= chat_format.BUDGET or len(new) <= 2
            if want[0][0] == "system":
                assert r.formatted.startswith("### system: ")
        assert turns == want and targets == [t for role, t in want if role == "assistant"]
    got = chat_format.digests(df).toPandas()
    assert len(got) == len(by)
    assert chat_format.digests(df.limit(0)).count() == 0


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs, seen = spark.read.parquet(f"{MORE}/documents.parquet"), {}
    assert 4 <= len(p.STAGES) <= 5
    columns = docs.columns
    for name, stage in p.STAGES:
        from ledgerleaf.llm.common import stored

        seen[name] = docs
        docs = stored(stage(spark, docs, MORE), "t")
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
    good = seen["exact"].toPandas()
    labels = duckdb.sql(f"select doc_id, quality from '{MORE}/labels.parquet'").df()
    clean = labels[labels.quality == 1].doc_id
    assert (~clean.isin(good.doc_id)).sum() <= 0.02 * len(clean) and not labels[labels.quality == 0].doc_id.isin(good.doc_id).mean() > 0.05
    norm = good.text.str.replace(r"[\x20\x09-\x0D]+", " ", regex=True)
    assert set(seen["near"].toPandas().doc_id) == set(good.groupby(norm).doc_id.min())
    near = seen["near"].toPandas().sort_values("doc_id").reset_index(drop=True)
    _, label = brute_components(list(near.text), 80)
    assert set(seen["mix"].toPandas().doc_id) == {near.doc_id[i] for i, x in enumerate(label) if i == x}
    assert set(docs.toPandas().doc_id) == set(seen["pack"].toPandas().doc_id)
