"""Selection of candidates and evidence of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, paths, text
from ledgerleaf.sources.scratch import scratch

from . import ledger as log

# Kept characters of a text, bytes from which an unreadable file is worth a look, formats.
TEXT_KEPT, TRIVIAL_BYTES = 4000, 1024
GATED = (".pdf", ".docx", ".odt", ".pptx", ".xlsx", ".dotx", ".xltx", ".potx", ".ott")
CONTAINERS = (".zip", ".tar", ".gz", ".tgz", ".bz2", ".xz", ".7z", ".rar", ".dmg", ".iso")
#: Decisions that leave a file open: it is selected first.
OPEN_DECISIONS = ("unanswered", "refused")


def bands(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """``files`` with band: 0 open decision, 1 in an inbox, 2 elsewhere; null where the ledger has the file.

    A file is seen when size and time agree, or else when the content does; two unknown contents agree.
    """
    last = log.latest(ledger).select(F.col("path").alias("rel"), *(F.col(c).alias(f"old_{c}") for c in ("decision", "size", "mtime", "md5")))
    joined = files.join(last.withColumn("known", F.lit(True)), "rel", "left")
    same_stat = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    same_bytes = F.col("md5").eqNullSafe(F.col("old_md5"))
    band = (
        F.when(F.col("old_decision").isin(*OPEN_DECISIONS), 0)
        .when(F.col("known") & (F.coalesce(same_stat, F.lit(False)) | same_bytes), F.lit(None).cast("int"))
        .when(F.col("inbox").isNotNull(), 1)
        .otherwise(2)
    )
    return joined.withColumn("band", band).select(*files.columns, "band")


def candidates(files: DataFrame, ledger: DataFrame) -> DataFrame:
    return bands(files, ledger).where("band is not null")


def lazy_bands(listed: DataFrame, ledger: DataFrame, digests: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``bands`` of files whose contents are not known yet (``listed``: rel, size, mtime, inbox and what ``digests``
    needs). ``digests`` adds md5; it gets the recorded files whose size or time has changed, and no others."""
    last = log.latest(ledger).select(F.col("path").alias("rel"), *(F.col(c).alias(f"old_{c}") for c in ("decision", "size", "mtime")))
    told = listed.drop("md5").join(last.withColumn("known", F.lit(True)), "rel", "left")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    drifted = F.col("known") & ~F.coalesce(F.col("old_decision").isin(*OPEN_DECISIONS), F.lit(False)) & ~F.coalesce(same, F.lit(False))
    told = told.withColumn("drifted", F.coalesce(drifted, F.lit(False))).drop("known", *(c for c in last.columns if c != "rel"))
    checked = digests(told.where("drifted")).unionByName(told.where("not drifted").withColumn("md5", F.lit(None).cast("string")))
    # A file that is recorded, settled and unchanged has the recorded size and time, so no digest is asked for it.
    return bands(checked.drop("drifted"), ledger)


def lazy_twins(chosen: DataFrame, listed: DataFrame, digests: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Files of ``listed`` with md5 that could have the bytes of one that is ``chosen``: of a chosen file's size, where
    at least two files have it. No other file is opened, and none twice: the digests are written before they are used
    (``first_twin`` and ``duplicates`` take the result, and look at it several times)."""
    real = listed.where("size > 0 and link_to is null").drop("md5")
    sizes = chosen.where("size > 0").select("size").distinct().join(real.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "size")
    found, path = digests(real.join(sizes.select("size"), "size", "left_semi")), scratch(listed.sparkSession, "digests")
    found.write.parquet(path)
    return listed.sparkSession.read.schema(found.schema).parquet(path)


def batch(found: DataFrame, limit: int) -> DataFrame:
    """The first candidates by band, then in the order of a walk."""
    return found.orderBy("band", paths.walk_key(F.col("rel"))).limit(limit)


def pruned_by_folder(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``files`` that lie under no recorded folder (``folders``: path).

    Each file meets its own ancestors, so containment is an equality.
    """
    up = files.select("rel", F.explode(paths.ancestors(F.col("rel"))).alias("path"))
    return files.join(up.join(folders.select("path"), "path").select("rel").distinct(), "rel", "left_anti")


def duplicates(files: DataFrame) -> DataFrame:
    """rel, duplicate_of: the other files of the same bytes; empty files have none.

    One aggregate over (size, md5); a group's list is sorted and its own name left out.
    """
    real = files.where("size > 0 and md5 is not null")
    groups = real.groupBy("size", "md5").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("rel")).alias("all")).where("n > 1")
    return real.join(groups, ["size", "md5"]).select("rel", F.array_except("all", F.array("rel")).alias("duplicate_of"))


def first_twin(files: DataFrame) -> DataFrame:
    """rel, twin, copies: the least other file of the same bytes, without lists, for groups of any size."""
    real = files.where("size > 0 and md5 is not null")
    ranked = real.groupBy("size", "md5").agg(F.count(F.lit(1)).alias("copies"), F.min("rel").alias("least"), F.max("rel").alias("greatest"))
    second = real.join(ranked.where("copies > 1"), ["size", "md5"])
    after = second.where("rel <> least").groupBy("size", "md5").agg(F.min("rel").alias("next"))
    return second.join(after, ["size", "md5"]).select("rel", F.when(F.col("rel") == F.col("least"), F.col("next")).otherwise(F.col("least")).alias("twin"), "copies")


def known_as(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """rel, known_as, known_desc: where the same bytes are recorded under another path that still exists."""
    last = log.by_content(ledger).select("md5", F.col("path").alias("known_as"), F.col("desc").alias("known_desc"))
    alive = last.join(files.select(F.col("rel").alias("known_as")).distinct(), "known_as", "left_semi")
    return files.where("md5 is not null").join(alive, "md5").where("known_as <> rel").select("rel", "known_as", "known_desc")


def evidence(entries: DataFrame, as_of_year: int, identifiers_of: dict | None = None) -> DataFrame:
    """Adds prose, truncated, needs_vision, opaque, dates, doc_year, ids; cuts text after reading all of it.

    ``entries``: rel, ext, size, text (null: could not be read), link_to, error. A document format whose text is
    debris counts as unread.
    """
    e = entries
    link = F.col("link_to").isNotNull()
    prose = text.is_prose(F.col("text"))
    debris = F.col("ext").isin(*GATED) & ~prose
    usable = F.when(~link & ~debris, F.col("text"))
    has = F.length(F.coalesce(usable, F.lit(""))) > 0
    big = F.coalesce("size", F.lit(0)) > TRIVIAL_BYTES
    container = F.col("ext").isin(*CONTAINERS)
    e = e.withColumn("usable", usable).withColumn("prose", prose & ~link)
    e = e.withColumns({"dates": identifiers.extract_dates(F.col("usable")), "ids": identifiers.extract_ids(F.col("usable"), identifiers_of)})
    return e.withColumns(
        {
            "doc_year": identifiers.doc_year(F.col("dates"), as_of_year),
            "truncated": F.length(F.coalesce("usable", F.lit(""))) > TEXT_KEPT,
            "needs_vision": ~link & ~has & ~container & big & F.col("error").isNull(),
            "opaque": F.when(link, F.lit("symlink")).when(~has & container, F.lit("container")).when(~has & ~big, F.lit("no-content")),
            "text": F.substring("usable", 1, TEXT_KEPT),
        }
    ).drop("usable")


def inbox_accounting(found: DataFrame, chosen: DataFrame, inboxes: list[str]) -> DataFrame:
    """inbox, candidates, selected, remaining: a row for each configured inbox."""
    names = found.sparkSession.createDataFrame([(x,) for x in inboxes], "inbox string")
    n = found.where("inbox is not null").groupBy("inbox").agg(F.count(F.lit(1)).alias("candidates"))
    s = chosen.where("inbox is not null").groupBy("inbox").agg(F.count(F.lit(1)).alias("selected"))
    all_ = names.join(n, "inbox", "left").join(s, "inbox", "left").fillna(0, ["candidates", "selected"])
    return all_.withColumn("remaining", F.col("candidates") - F.col("selected"))


def counts(banded: DataFrame, limit: int) -> DataFrame:
    """scanned, candidates, seen, retried, in_inboxes, elsewhere, selected."""
    some = F.count_if(F.col("band").isNotNull())
    return banded.agg(
        F.count(F.lit(1)).alias("scanned"),
        some.alias("candidates"),
        F.count_if(F.col("band").isNull()).alias("seen"),
        F.count_if(F.col("band") == 0).alias("retried"),
        F.count_if(F.col("band") == 1).alias("in_inboxes"),
        F.count_if(F.col("band") == 2).alias("elsewhere"),
        F.least(some, F.lit(limit)).alias("selected"),
    )


def folder_fingerprint(files: DataFrame, folder: Column) -> DataFrame:
    """dir, count, total_size, max_mtime, tree_md5 of each folder; links and Finder's own files are left out."""
    real = files.where(~(paths.basename(F.col("rel")) == ".DS_Store")).withColumn("dir", folder)
    listing = F.sort_array(F.collect_list(F.struct("rel", F.coalesce("md5", F.lit("")).alias("md5"))))
    lines = F.transform(listing, lambda x: F.concat(x["rel"], F.lit(":"), x["md5"], F.lit("\n")))
    return real.groupBy("dir").agg(F.count(F.lit(1)).alias("count"), F.sum("size").alias("total_size"), F.max("mtime").alias("max_mtime"), F.md5(F.array_join(lines, "")).alias("tree_md5"))


def not_own(files: DataFrame, guarded: list[str]) -> DataFrame:
    """``files`` outside the workspace and the code: the engine never reads itself."""
    out = files
    for g in guarded:
        out = out.where(~paths.inside(F.col("rel"), F.lit(g)))
    return out
