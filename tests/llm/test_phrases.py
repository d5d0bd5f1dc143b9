"""Phrase mining against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerleaf.llm import collocations

DOC = "doc_id long, text string, lang string, phrase string, h long, n long, block int, k int"


def by_hand(docs, least, top, percent=80):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        drop = {p[i:j] for p, c in often.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and p[i:j] in often and 100 * c >= percent * often[p[i:j]]}
        found = []
        for p, a in often.items():
            score, cut = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            if p not in drop:
                found.append((-score, -a, " ".join(p).encode(), counts[p[:cut]], counts[p[cut:]]))
        rows += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(rows)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, "p", 1, 2, 3, 4) for i, (t, lang) in enumerate(docs)], DOC)


ODD = [(None, "en"), ("", None), (" \t ", "en"), ("...;;\n", "fr"), ("Ab aB, ab ab. AB ab\x0bab ab", None), ("é\xa0ü \x85 x\x1f y", "en"), ("a b c d e " * 20_000, "long"), ("\x00 b \x00 b", "en")]


def some_docs():
    rng = random.Random(8)
    docs = list(ODD) * 2
    for _ in range(150):
        words = [rng.choice(("the", "The", "quick", "brown", "fox", "w%d" % rng.randint(0, 60), "😀", "É", "é")) for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            words[3:3] = ["new", "york", "city", "council"]
        docs.append(("".join(w + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "!? ")) for w in words), rng.choice(("en", "de", None, ""))))
    return docs


@pytest.mark.parametrize("buckets, chunk, parts", [(1 << 20, 1 << 22, 3), (1 << 16, 300, 1), (1 << 15, 5_000, 7)])
def test_by_hand(spark, buckets, chunk, parts):
    docs = some_docs()
    got = collocations.collocations(frame(spark, docs).repartition(parts), top=40, least=5, buckets=buckets, chunk=chunk).collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 5, 40)


def test_every_bucket_hot_or_one_bit(spark):
    """Bitmaps that tell nothing apart change the cost, not the result."""
    docs = [("x y z x y z x y q", "en")] * 9 + [("x y", "en")]
    got = collocations.collocations(frame(spark, docs), least=2, buckets=8).collect()
    assert sorted(tuple(r) for r in got) == by_hand(docs, 2, 2000)
    assert collocations.collocations(frame(spark, []), least=2, buckets=8).count() == 0
    assert collocations.collocations(frame(spark, [("one two", "en")]), least=2, buckets=8).count() == 0


def test_bitmaps_hold_what_was_put_in(spark):
    hashes = [0, 1, 32_767, 32_768, 65_535, 65_536, -1, 12_345_678_901]
    bits = collocations._hash_bits(spark.createDataFrame([(h,) for h in hashes], "h long"), 1 << 17)
    want = {h & (1 << 17) - 1 for h in hashes}
    assert set(np.flatnonzero(np.unpackbits(bits, bitorder="little"))) == want


def test_counters_add_up_over_tasks(spark):
    """A bucket is hot when tasks' counters, each stopped at the threshold, reach it together."""
    docs = frame(spark, [("a b", "en")] * 6 + [("c d", "en")] * 5).repartition(11)
    texts = docs.select("lang", docs.text.cast("binary").alias("text"))
    made = collocations._pass(texts, 1, 1 << 16, 6, 4, None, None, 1 << 20)
    bits = collocations._hot_buckets(made, 1 << 16, 6)
    assert np.unpackbits(bits).sum() == 1
