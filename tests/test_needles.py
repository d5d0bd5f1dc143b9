"""Many phrases at once against one native pass for each."""

import random

from pyspark.sql import functions as F

from ledgerleaf.functions import needles, text
from ledgerleaf.operators import route
from ledgerleaf.plans import conditions

ENTRY = "rel string, ext string, size long, text string"


def corpus(rng, n=120):
    words = ["Été", "facture", "Straße", "l’usager", "œuvre", "le", "la", "a", "ab", "abc", "bc d", "ﬁn", "né", "x" * 30]
    texts = ["".join(rng.choice(words) + rng.choice((" ", "", "  ", "\n")) for _ in range(rng.randint(0, 25))) for _ in range(n)]
    return [(f"src{i % 3}/{i}.txt", ".txt", len(t or ""), t) for i, t in enumerate([*texts, "", None])]


def phrases(rng, n):
    words = ["été", "FACTURE", "strasse", "l'usager", "le", "la", "a", "ab", "abc", "bcd", "né", "", " ", "xx"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + rng.choice(("", "", str(k))) for k in range(n)]


def test_found_places_are_what_texts_say(spark):
    rng = random.Random(2)
    made = needles.Needles(phrases(rng, 1000))
    assert len(made) > 500
    df = spark.createDataFrame(corpus(rng), ENTRY).withColumn("normal", text.norm(F.coalesce("text", F.lit(""))))
    df = df.withColumn("glue", text.glued(F.col("normal")))
    rows = df.select("normal", "glue", made.found(F.col("normal")).alias("found")).collect()
    for r in rows:
        said = [k for n, k in made.place.items() if n and (n in r.normal or n.replace(" ", "") in r.glue)]
        assert r.found == sorted(said)
    assert any(len(r.found) > 20 for r in rows) and needles.Needles([]).automata()
    assert [r[0] for r in df.select(needles.Needles([]).found(F.col("normal"))).distinct().collect()] == [[]]


def test_random_trees_compile_alike(spark):
    rng = random.Random(7)
    every = phrases(rng, 400)

    def tree(depth):
        made = {rng.choice(("text_contains_any", "text_contains_all")): rng.sample(every, rng.randint(0, 3)) for _ in range(rng.randint(0, 2))}
        if rng.random() < 0.3:
            made["text_contains_any"] = rng.choice(every)  # one phrase, not in a list
        if depth and rng.random() < 0.7:
            kind = rng.choice(("all", "any", "not"))
            made[kind] = tree(depth - 1) if kind == "not" else [tree(depth - 1) for _ in range(rng.randint(0, 2))]
        return made

    trees = [tree(3) for _ in range(60)]
    rows = spark.createDataFrame(corpus(rng, 60), ENTRY)
    told = lambda: [(c := conditions.compiled(t)).match.alias(f"m{i}") for i, t in enumerate(trees)] + [conditions.compiled(t).strength.alias(f"s{i}") for i, t in enumerate(trees)]
    native = conditions.prepared(rows).select("rel", *told())
    with needles.looked_up(trees) as used:
        assert len(used) > 40
        looked_up = conditions.prepared(rows).select("rel", *told())
        assert "text_found" in looked_up._jdf.queryExecution().analyzed().toString()
    assert needles.used() is None and "text_found" not in conditions.prepared(rows).columns
    assert sorted(map(tuple, native.collect())) == sorted(map(tuple, looked_up.collect()))
    with needles.looked_up(trees[:1]) as used:
        assert used is None  # few phrases: native passes


def test_triage_is_the_same_with_many_phrases(spark, monkeypatch):
    rng = random.Random(4)
    words = phrases(rng, 90)
    config = {
        "root": "/r",
        "sensitive": {"text_contains_any": words[:20], "rules": [{"id": "both", "text_contains_all": words[20:22]}]},
        "entities": [{"name": "e", "match": {"text_contains_any": words[22:40]}}, {"name": "f", "match": {"all": [{"text_contains_all": words[40:42]}]}}],
        "rules": [{"id": f"r{k}", "status": rng.choice(("active", "shadow")), "when": {"text_contains_any": words[k : k + 3]}, "destination": "D"} for k in range(42, 84, 3)],
    }
    rows = spark.createDataFrame(corpus(rng, 80), ENTRY)
    columns = ("rel", "triage", "why", "guards", "rule", "entity", "strength", "destination", "shadow")
    many = route.triage(rows, config)
    assert "text_found" in many._jdf.queryExecution().analyzed().toString() and "text_found" not in many.columns
    monkeypatch.setattr(needles, "find_spec", lambda name: None)
    few = route.triage(rows, config)
    assert "text_found" not in few._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, many.select(*columns).collect())) == sorted(map(str, few.select(*columns).collect()))
