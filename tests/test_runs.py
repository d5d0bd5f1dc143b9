"""Runs of words as numbers, and what of a ledger goes to its last lines."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerleaf import registry
from ledgerleaf.functions import runs
from ledgerleaf.functions import text as t
from ledgerleaf.operators import learn
from ledgerleaf.queries import relational


def grams(said):
    words = re.findall(r"[\w'’-]+", said)
    return {" ".join(words[i : i + n]) for n in range(2, 6) for i in range(len(words) - n + 1)}


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_held_runs_are_those_of_the_map_and_few_others(bits):
    """What a map was made of is found under its own salt; a map that is full finds more, never less."""
    pick = random.Random(5)
    texts = ["", "a", *(" ".join(pick.choice("abcdefgh") for _ in range(pick.randrange(30))) for _ in range(200))]
    salts = [pick.choice("xy") for _ in texts]
    known = sorted(grams(texts[3]) | grams(texts[9]))
    made = np.zeros(bits // 64, "<i8")
    for p in runs.places(known, ["x"] * len(known), bits).tolist():
        made[p >> 6] |= np.int64((1 << (p & 63)) - (1 << 64 if p & 63 == 63 else 0))
    for said, salt, found in zip(texts, salts, runs.held(texts, salts, made), strict=True):
        assert found <= grams(said)
        if salt == "x":
            assert found >= grams(said) & set(known)
        if bits > 64:
            assert found <= (grams(said) & set(known) if salt == "x" else set())


def test_words_are_those_of_the_expressions(spark):
    """Words apart by marks, signs and odd blanks are told as the engine's expressions tell them, in any script."""
    odd = "ab_c d'e f’g h-i ½ x² ⅷ a‍b اًب किख a‿b 𝒳𝒴 𐐀 e.f\x1cg\x85h i　j 한국 ·k #l"
    df = spark.createDataFrame([(odd,), ("",), ("one",)], "text string")
    want = [set(r.g) for r in df.select(t.ngrams(t.norm("text")).alias("g")).collect()]
    bits = runs.map_of(df.select("text", t.ngrams(t.norm("text")).alias("g")).selectExpr("explode(g) AS g"), F.lit(""), F.col("g"), 1 << 20)
    got = [set(r.g) for r in df.select(runs.in_map(t.norm("text"), F.lit(""), bits).alias("g")).collect()]
    assert got == want and len(want[0]) > 40


def test_last_lines_hold_only_what_is_asked(spark):
    """Lines of a ledger are dealt out to find each path's last one with its identifiers, not with all that they say."""
    sf = "/root/testdata/sf0.001"
    e = relational.moved(spark, sf)
    plan = learn.by_identifier(e, learn.moves(e), relational.ledger(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    last = [line for line in plan.split("\n") if "max_by" in line]
    assert last and not any("desc" in line or "md5" in line for line in last)


def test_rules_are_named_from_what_was_found(spark):
    """The last plan, which reads the found rules twice, has none of the steps that find them."""
    plan = registry.QUERIES["mine_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" not in plan and "user_id" not in plan
