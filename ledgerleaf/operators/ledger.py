"""The ledger: an append-only log in which the last line of a path holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerleaf.functions import paths, text

#: Columns of a record that the newest line wins as a whole.
KINDS = ("pass", "triage", "decision", "provenance")


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The line with the greatest seq of each key: one aggregate, combined before rows move, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("_r"))
    return picked.select(*keys, "_r.*").select(*rows.columns)


def files(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.coalesce(F.col("type"), F.lit("file")) != "dir") if "type" in ledger.columns else ledger


def latest(ledger: DataFrame) -> DataFrame:
    """One row per path."""
    return _last(files(ledger), ["path"])


def by_content(ledger: DataFrame) -> DataFrame:
    """One row per md5: the last of its (md5, path) lines. A path that was recorded anew with other bytes stays here
    under its old ones."""
    return _last(files(ledger).where("md5 is not null"), ["md5"])


def paths_by_content(ledger: DataFrame) -> DataFrame:
    """One row per (md5, path)."""
    return _last(files(ledger).where("md5 is not null"), ["md5", "path"])


def stats(ledger: DataFrame) -> DataFrame:
    """kind, value, n: lines, distinct files, files with a description, counts of the latest rows by each kind, and
    for each recorded folder (kind dir, value its path) how many files its line stands for."""
    now = latest(ledger)
    named = F.coalesce(*(F.when(F.grouping(k) == 0, F.lit(k)) for k in KINDS))
    value = F.coalesce(*(F.when(F.grouping(k) == 0, F.col(k)) for k in KINDS))
    grouped = now.groupingSets([[F.col(k)] for k in KINDS], *(F.col(k) for k in KINDS)).agg(named.alias("kind"), value.alias("value"), F.count(F.lit(1)).alias("n")).select("kind", "value", "n")
    none = F.lit(None).cast("string").alias("value")
    lines = ledger.agg(F.lit("lines").alias("kind"), none, F.count(F.lit(1)).alias("n"))
    distinct = now.agg(F.lit("distinct_files").alias("kind"), none, F.count(F.lit(1)).alias("n"))
    described = now.agg(F.lit("with_desc").alias("kind"), none, F.count_if(F.coalesce(F.col("desc"), F.lit("")) != "").alias("n"))
    out = grouped.unionByName(lines).unionByName(distinct).unionByName(described)
    if "type" not in ledger.columns:
        return out
    folders = _last(ledger.where("type = 'dir'"), ["path"])
    n = F.col("count").cast("long") if "count" in ledger.columns else F.lit(None).cast("long")
    return out.unionByName(folders.select(F.lit("dir").alias("kind"), F.col("path").alias("value"), n.alias("n")))


def find(ledger: DataFrame, needle: str) -> DataFrame:
    """Latest rows of files whose description or path has a phrase."""
    return latest(ledger).where(F.contains(text.norm(F.concat(F.coalesce("desc", F.lit("")), F.lit(" "), F.col("path"))), F.lit(text.norm_python(needle))))


def show(ledger: DataFrame, key: str) -> DataFrame:
    """The row a key means: exact md5, else exact path, else a folder's record, else the first path that ends so."""
    rank = lambda df, r, order: df.withColumn("rank", F.lit(r)).withColumn("order", order)
    now = latest(ledger)
    first_seen = files(ledger).groupBy("path").agg(F.min("seq").alias("order"))
    ends = now.where(F.col("path").endswith(key)).join(first_seen, "path").withColumn("rank", F.lit(3))
    found = rank(by_content(ledger).where(F.col("md5") == key), 0, F.lit(0).cast("long")).unionByName(rank(now.where(F.col("path") == key), 1, F.lit(0).cast("long")))
    if "type" in ledger.columns:
        found = found.unionByName(rank(_last(ledger.where("type = 'dir'"), ["path"]).where(F.col("path") == key), 2, F.lit(0).cast("long")))
    return found.unionByName(ends).orderBy("rank", "order").limit(1).drop("rank", "order")


def next_pass(ledger: DataFrame, day: str) -> DataFrame:
    """The id of the pass that starts on ``day``: one more than the passes of that day."""
    n = F.count_distinct(F.when(F.col("pass").startswith(day + "-"), F.col("pass")))
    return ledger.agg(F.concat(F.lit(day + "-"), (n + 1).cast("string")).alias("pass_id"))


def paraphrases_name(desc: Column, path: Column) -> Column:
    """Whether a description only repeats the words of the file's name."""
    d, n = text.tokens(desc), text.tokens(paths.stem(path))
    return F.coalesce((F.size(d) > 0) & (F.size(n) > 0) & (F.size(F.array_except(d, n)) == 0), F.lit(False))


def record(rows: DataFrame) -> DataFrame:
    """Ledger lines of decided rows, and why a line is refused: empty optional values are left out."""
    empty = lambda c: F.when(F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0, F.col(c))
    bad = paraphrases_name(F.col("desc"), F.col("path"))
    return rows.withColumns({"desc": empty("desc"), "rejected": F.when(bad, F.lit("the description repeats the file name"))})


def vote(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """The pass most of ``rows`` (path, ord) were last recorded under; of equals, the one met first."""
    votes = rows.join(latest(ledger).select("path", "pass"), "path").where("pass is not null")
    counted = votes.groupBy("pass").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(1).select("pass", "n")


def appended(ledger: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with seq after the ledger's, growing in ``order``, with gaps; a single writer calls this per batch of
    decided rows. Ranges of the order are sorted side by side."""
    last = ledger.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_last"))
    placed = rows.orderBy(*order).withColumn("_n", F.monotonically_increasing_id() + 1)
    return placed.join(F.broadcast(last)).withColumn("seq", F.col("_last") + F.col("_n")).drop("_last", "_n")  # one row
