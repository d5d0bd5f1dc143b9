"""The guard of a plan: what it reads of texts, and on tables made for it."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerleaf import registry
from ledgerleaf.functions import maps
from ledgerleaf.operators import apply

from .test_large import shuffled


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["trash_guard", "superseded", "apply_summary"])
def test_texts_are_judged_where_they_are(spark, tmp_path, name, no_broadcast, monkeypatch):
    """What is dealt out does not hold texts: these have 3 MB."""
    monkeypatch.setattr(maps, "BITS", 1 << 12)
    pick = random.Random(3)
    rows = [(i, "".join(pick.choice("abcdefghij klmnopqrst uvwxyz ") for _ in range(30_000)), "en", f"src{i % 7}") for i in range(100)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).to_parquet(tmp_path / "documents.parquet")
    got, written = shuffled(spark, lambda: registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert got or name == "superseded"
    assert written < 400_000, written


FILES = "rel string, size long, md5 string, text string, ext string, ids map<string,array<string>>, doc_year int"
DECIDED = "rel string, md5 string, decision string, keeper string, reviewed string, why string, doc_year int"
WORDS = "these are the plain words of a letter that anyone can read "


def test_guard_by_years_and_families(spark):
    """The year is the decided row's; families are those of both files; a keeper that is binned keeps nothing."""
    files = spark.createDataFrame([(f"a/{k}.txt", 2000, k, WORDS + k if k != "junk" else "xzq", ".txt", None, 1999) for k in ("old", "new", "lease one", "lease two", "junk", "copy", "first", "kept")], FILES)
    files = files.withColumn("md5", F.when(F.col("md5").isin("copy", "first"), "same").otherwise(F.col("md5")))
    rows = [("old", None, 1999), ("new", None, 2020), ("lease one", "lease two", 1999), ("junk", None, 2020), ("copy", "first", 1999), ("kept", "old", 1999)]
    decided = spark.createDataFrame([(f"a/{k}.txt", "same" if k == "copy" else k, "trash", keeper and f"a/{keeper}.txt", None, "seen", year) for k, keeper, year in rows], DECIDED)
    guard = {"rules": [{"id": "then", "doc_year_in": [1999]}], "supersedable": [{"id": "lease", "text_contains_any": ["lease"]}]}
    got = {r.rel[2:-4]: (r.status, r.refusal, r.reason) for r in apply.trash_guard(decided, files, {"sensitive": guard}).collect()}
    then = "sensitive (then) — kept"
    assert got == {
        "old": ("refused", then, "seen"),
        "new": ("applied", None, "seen"),
        "lease one": ("applied", None, "seen — superseded edition (lease), replaced by a/lease two.txt"),
        "junk": ("refused", apply.UNREADABLE, "seen"),
        "copy": ("applied", None, "seen — binned only because a/first.txt keeps the same bytes"),
        "kept": ("refused", then, "seen"),
    }


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_no_row_of_a_map_is_lost(spark, bits):
    rows, keys = spark.range(2000).withColumn("key", F.xxhash64("id")), spark.range(0, 2000, 50).select(F.xxhash64("id").alias("key"))
    found = {r.id for r in maps.in_map(rows, F.col("key"), keys, bits).collect()}
    assert found >= set(range(0, 2000, 50))
    assert bits == 64 or len(found) < 60
