"""Compaction: one ledger line for a whole folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerleaf.functions import paths

from . import collect
from . import ledger as log


# Fixed value: blockers that a refusal names.
SHOWN = 20


def _under(path: Column, folder: str) -> Column:
    return path.startswith(folder.rstrip("/") + "/")


def _there(files: DataFrame, folder: str) -> DataFrame:
    """Files of a folder that its fingerprint vouches for: neither links nor Finder's own."""
    there = files.where(_under(F.col("rel"), folder) & (paths.basename(F.col("rel")) != ".DS_Store"))
    return there.where("link_to is null") if "link_to" in files.columns else there


def _collapses(folder: str, keep: list[str]) -> Column:
    """Whether a line's path lies under a folder and no pattern keeps it, by the path within the folder or by name."""
    within = F.substr("path", F.lit(len(folder.rstrip("/")) + 2))
    kept = F.lit(False)
    for g in keep:
        kept = kept | within.rlike(paths.glob_regex(g)) | paths.basename(F.col("path")).rlike(paths.glob_regex(g))
    return _under(F.col("path"), folder) & ~kept


def blockers(files: DataFrame, ledger: DataFrame, folder: str) -> DataFrame:
    """rel, why: files of a folder that no line covers or that nobody decided; compaction must hide none."""
    there = _there(files, folder)
    last = log.latest(ledger).select(F.col("path").alias("rel"), "decision", F.lit(True).alias("known"))
    why = F.when(F.col("known").isNull(), F.lit("no memory line")).when(~(F.coalesce("decision", F.lit("")) != "") | F.col("decision").isin(*collect.OPEN_DECISIONS), F.concat(F.lit("decision="), F.coalesce("decision", F.lit("None"))))
    return there.join(last, "rel", "left").select("rel", why.alias("why")).where("why is not null")


def covered(ledger: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """Latest lines under a folder, but for those that a pattern keeps."""
    return log.latest(ledger).where(_collapses(folder, keep))


def _commonest(name: str) -> Column:
    """The commonest value that is there; of equally common ones the smallest."""
    return F.mode(F.when(F.coalesce(F.col(name), F.lit("")) != "", F.col(name)), True)


def folder_line(files: DataFrame, ledger: DataFrame, folder: str, pass_id: str, reason: str, keep: list[str] | None = None, **given: object) -> DataFrame:
    """The one line that stands for a folder: commonest columns of what it covers, fingerprint of what is there.

    ``given``: desc, tags (a list) or date_doc that take the place of the commonest; empty ones do not.
    """
    tags = F.mode(F.when(F.size("tags") > 0, F.col("tags")), True).alias("tags")
    lines = covered(ledger, folder, keep or []).agg(*(_commonest(c).alias(c) for c in ("triage", "decision", "provenance", "desc", "date_doc")), tags)
    mark = collect.folder_fingerprint(_there(files, folder), F.lit(folder.rstrip("/")))
    both = mark.join(F.broadcast(lines))  # one row
    said = lambda c: F.col(c) if not given.get(c) else (F.array(*map(F.lit, given[c])) if c == "tags" else F.lit(given[c])).alias(c)
    return both.select(
        F.lit("dir").alias("type"),
        F.col("dir").alias("path"),
        F.lit(pass_id).alias("pass"),
        F.coalesce("triage", F.lit("propose")).alias("triage"),
        "decision",
        F.lit(reason).alias("reason"),
        F.coalesce("provenance", F.lit("pass")).alias("provenance"),
        said("desc"),
        said("tags"),
        said("date_doc"),
        "count",
        "total_size",
        "max_mtime",
        "tree_md5",
    )


def remaining(ledger: DataFrame, folder: str, keep: list[str] | None = None) -> DataFrame:
    """The ledger without any line, of whatever age and kind, of what collapses, and without the folder's own: a filter."""
    left = ledger.where(~_collapses(folder, keep or []))
    if "type" not in ledger.columns:
        return left
    own = (F.coalesce("type", F.lit("file")) == "dir") & (F.regexp_replace("path", "/+$", "") == folder.rstrip("/"))
    return left.where(~own)


def compacted(files: DataFrame, ledger: DataFrame, folder: str, pass_id: str, reason: str, keep: list[str] | None = None, **given: object) -> DataFrame:
    """The ledger in which a folder has one line, after all others. Compacting again refreshes that line.

    Refused (ValueError) while any file of the folder is undecided, naming the first of them in the order of a walk,
    and where there is nothing to collapse. The tests run at once; what is written from the result is one new version.
    """
    blocked = blockers(files, ledger, folder)
    first = blocked.orderBy(paths.walk_key(F.col("rel"))).limit(SHOWN).collect()
    if first:
        named = "; ".join(f"{r.rel}: {r.why}" for r in first)
        raise ValueError(f"{blocked.count()} undecided files in {folder}: {named}")
    if covered(ledger, folder, keep or []).isEmpty():
        raise ValueError(f"no line in {folder} that could be collapsed")
    line = folder_line(files, ledger, folder, pass_id, reason, keep, **given)
    last = ledger.agg((F.max("seq") + 1).alias("seq"))
    return remaining(ledger, folder, keep).unionByName(line.join(F.broadcast(last)), allowMissingColumns=True)  # one row each


def folder_states(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """path, state of each recorded folder: ``same`` by number, size and time of its files; ``touched`` where only the
    contents are the recorded ones; ``diverged``; ``gone`` where no file is left. The files of the first two are
    covered (``collect.pruned_by_folder``), those of a diverged folder are candidates again."""
    marks = ("count", "total_size", "max_mtime", "tree_md5")
    lines = log._last(ledger.where("type = 'dir'"), ["path"]).select("path", *(F.col(c).alias(f"old_{c}") for c in marks))
    real = files.where("link_to is null") if "link_to" in files.columns else files
    own = real.withColumn("folder", F.explode(paths.ancestors(F.col("rel")))).join(lines.select(F.col("path").alias("folder")), "folder")
    now = collect.folder_fingerprint(own, F.col("folder")).select(F.col("dir").alias("path"), *marks)
    stat = F.lit(True)
    for c in marks[:3]:
        stat = stat & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    state = F.when(F.col("count").isNull(), "gone").when(stat, "same").when(F.col("tree_md5") == F.col("old_tree_md5"), "touched").otherwise("diverged")
    return lines.join(now, "path", "left").select("path", state.alias("state"))
