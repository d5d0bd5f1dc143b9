"""What steps deal out and make anew, on tables made for it."""

import re

import pandas as pd
import pytest

from ledgerleaf import registry
from ledgerleaf.operators import learn
from ledgerleaf.queries import relational


def shuffled(spark, run):
    """What ``run`` returns, and the bytes that its stages wrote for others."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None))}
    before = stages()
    out = run()
    return out, sum(v for k, v in stages().items() if k not in before)


@pytest.fixture
def texts(tmp_path):
    """300 texts of 400 words of their own; a tenth also says a phrase of its folder."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(400)), ("en", "de")[i // 5 % 2], f"src{i % 7}") for i in range(300)]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame({"event_id": [1], "user_id": [1], "event_type": ["click"], "ts": [pd.Timestamp("2024-01-01")]}).to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["mine_phrase", "mine_rules"])
def test_phrases_are_not_dealt_out_before_they_are_shared(spark, texts, name, monkeypatch):
    monkeypatch.setattr(learn, "MAP_BITS", 1 << 18, raising=False)
    rows, written = shuffled(spark, lambda: registry.QUERIES[name](spark, texts).collect())
    assert len(rows) >= 2
    assert written < 3_000_000, written


def test_a_full_map_changes_no_phrase(spark, monkeypatch):
    want = sorted(map(tuple, registry.QUERIES["mine_phrase"](spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(learn, "MAP_BITS", 64)
    assert sorted(map(tuple, registry.QUERIES["mine_phrase"](spark, "/root/testdata/sf0.001").collect())) == want and want


@pytest.mark.parametrize("name", ["diverging", "unanswered"])
def test_texts_are_brought_into_normal_form_once(spark, name):
    """No filter that the optimizer moves below the rules repeats them: the plans have one normal form of the texts."""
    made = learn.judged_shadows(relational.settled_entries(spark, "/root/testdata/sf0.001")) if name == "diverging" else registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert sum(bool(re.search(r"translate\(replace\(replace\(coalesce\(text#\d+", line)) for line in plan.split("\n")) == 1
