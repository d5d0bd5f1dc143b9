"""Audit of how quality filters interact, by inclusion-exclusion (native DataFrame operations).

Each document has a flag per filter: it fails that filter. One aggregate counts, for each part of the corpus and each
of the 2**n sets of filters, the documents that fail every filter of the set: a sum of products of flags. All else
follows from these joint counts, without looking at a document again:

* documents that no filter of a set fails (survivors) are an alternating sum over the set's subsets;
* documents that fail exactly the filters of a set are the Moebius inverse over its supersets;
* what a filter removes after others is a difference of survivors, and what it fails beyond that is redundant;
* the game "documents removed by a set of filters" has Harsanyi dividends (-1)**(|S|+1) * J(S), so a filter's Shapley
  value is the sum of J(S) * (-1)**(|S|+1) / |S| over the sets that hold it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, table

#: The audited filters in order; ``failures`` gives the first four, equality of texts the last.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
MARKS = r"[#$%&*|]"
#: What is counted: all documents, those marked good, those marked toxic.
COUNTS = ("n", "good", "toxic")


def failures(text: Column, words: Column) -> list[Column]:
    """A to D of a text that is not null: too short, words repeat too much, too many capitals, holds an odd mark."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return [n < MIN_WORDS, 100 * distinct.cast("long") < DISTINCT_PERCENT * n.cast("long"), 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long"), text.rlike(MARKS)]


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Different texts with their flags: part, fails (array of A to D), n, good, toxic (rows that hold the text) and
    of each the rows that fail E: n_copy, good_copy, toxic_copy.

    A row fails E where some row of the table has the same text and a smaller id. A text's flags are the same in each
    of its rows, so rows are added up by text before they move. A null id is greater than all others.
    """
    whole = docs.select(F.col(id_col).alias("id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((part_col, "part"), (text_col, "text"))))
    # A column of its own, so that a text is cut into words once.
    cut = whole.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    failing = failures(F.col("text"), F.col("words"))
    rows = cut.select(
        "id",
        "part",
        F.unhex(F.sha2("text", 256)).alias("sha"),  # what tells texts apart: 256 bits
        sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failing)), F.lit(0)).alias("mask"),
    )
    # One row for each id and text: ids may repeat, and one id may hold very many rows.
    rows = rows.groupBy("id", "part", "sha", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    rows = rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in COUNTS[1:]})
    # Within such a group ids differ, so the least id's rows are the group's only ones that may pass E.
    texts = rows.groupBy("sha", "part", "mask", *COUNTS[1:]).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("firsts"))
    # A text has few such groups: at most four for each part.
    least = F.min("first").over(W.partitionBy("sha"))
    texts = texts.withColumn("least", least)
    copies = F.col("n") - F.when(F.col("least").isNull(), F.col("n")).when(F.col("first") == F.col("least"), F.col("firsts")).otherwise(F.lit(0))
    texts = texts.withColumn("copy", copies)
    of = lambda c, n: n if c == "n" else F.when(F.col(c), n).otherwise(F.lit(0))
    return texts.select("part", "mask", *(of(c, F.col("n")).alias(c) for c in COUNTS), *(of(c, F.col("copy")).alias(f"{c}_copy") for c in COUNTS))


def joint_failures(texts: DataFrame) -> DataFrame:
    """part, n, good, toxic: each an array with, at place S, the rows that fail all filters of the set S (a bit mask).

    The sum for a set is one of products of flags: those of A to D belong to the text, that of E to the row.
    """
    flags = texts.withColumns({f"fails_{k}": F.shiftright("mask", k).bitwiseAND(F.lit(1)).cast("long") for k in range(4)})

    def product(counted: str, subset: int) -> str:
        return " * ".join([f"{counted}_copy" if subset >> 4 & 1 else counted, *(f"fails_{k}" for k in range(4) if subset >> k & 1)])

    sums = (f"array({', '.join(f'sum({product(c, s)})' for s in range(32))}) AS {c}" for c in COUNTS)
    return flags.groupBy("part").agg(*map(F.expr, sums))


def _sum(joint: Column, holds, times, n: int = len(FILTERS)) -> Column:
    """Sum of joint[s] * times(s) over the sets s with holds(s)."""
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), holds)
    return F.aggregate(sets, F.lit(0).cast("long"), lambda made, s: made + F.get(joint, s) * times(s))


def _sign(s: Column) -> Column:
    """-1 for sets of an odd number of filters, else 1."""
    return F.lit(1) - 2 * (F.bit_count(s) % 2)


def survivors(joint: Column, n: int = len(FILTERS)) -> Column:
    """An array with, at place S, the documents that fail no filter of S: the alternating sum over the subsets of S."""
    return F.transform(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda of: _sum(joint, lambda s: s.bitwiseAND(of) == s, _sign, n))


def alone(joint: Column, n: int = len(FILTERS)) -> Column:
    """Documents that fail one filter and no other, for each filter: Moebius inversion over the sets that hold it."""
    return F.transform(_singles(n), lambda f: _sum(joint, lambda s: s.bitwiseAND(f) != 0, lambda s: -_sign(s), n))


def shapley(joint: Column, n: int = len(FILTERS)) -> Column:
    """n! times the Shapley value of each filter in "documents removed", by Harsanyi dividends: whole numbers."""
    share = lambda s: (-_sign(s) * F.lit(factorial(n)) / F.bit_count(s)).cast("long")
    return F.transform(_singles(n), lambda f: _sum(joint, lambda s: s.bitwiseAND(f) != 0, share, n))


def _singles(n: int) -> Column:
    return F.array(*(F.lit(1 << k) for k in range(n)))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part,
    each order of the five filters and each of its steps.

    Null texts count as empty; a null part is the empty string. Rows that repeat are documents of their own and share
    their id, so neither is a copy of the other. A document is good or toxic if any of its label's rows says so; a
    null id has no label. Empty table: no rows.
    """
    joint = joint_failures(flagged(docs, labels, **columns))
    parts = joint.select(
        "part",
        *(survivors(F.col(c)).alias(f"left_{c}") for c in COUNTS),
        F.transform(_singles(len(FILTERS)), lambda f: F.get("n", f)).alias("fails"),
        alone(F.col("n")).alias("alone"),
        shapley(F.col("n")).alias("shapley"),
    )
    orders = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = [F.locate(f, F.col("filter_order")) for f in FILTERS]
    upto = lambda last: sum((F.when(b <= last, F.lit(1 << k)).otherwise(F.lit(0)) for k, b in enumerate(bits)), F.lit(0))
    k = F.position(F.substring("filter_order", F.col("step"), F.lit(1)), F.lit(FILTERS)) - 1
    steps = steps.select("*", k.alias("k"), upto(F.col("step") - 1).alias("before"), upto(F.col("step")).alias("after"))
    lost = lambda c: F.get(f"left_{c}", F.col("before")) - F.get(f"left_{c}", F.col("after"))
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.get("left_n", F.col("after")).alias("kept"),
        lost("n").alias("removed"),
        (F.get("fails", F.col("k")) - lost("n")).alias("redundant"),
        F.get("alone", F.col("k")).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        F.get("shapley", F.col("k")).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), flagged AS (
  SELECT t.doc_id, part, [
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    t.doc_id > min(t.doc_id) OVER (PARTITION BY text)] AS fails,
    coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
  FROM t LEFT JOIN labels l ON l.doc_id = t.doc_id
), patterns AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM flagged GROUP BY part, fails
), orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o AS filter_order, unnest(range(1, 6))::INT AS step FROM orders WHERE length(o) = 5
), told AS (
  SELECT part, filter_order, step, n, good, toxic,
         list_filter([1, 2, 3, 4, 5], lambda i: fails[strpos('ABCDE', filter_order[i])])[1] AS gone,
         fails[strpos('ABCDE', filter_order[step])] AS failing,
         len(list_filter(fails, lambda f: f)) AS failed
  FROM steps, patterns
), counted AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (failing AND gone < step), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (failing AND failed = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counted
"""
