"""Reading and writing of ledgers and working files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RECORD = (
    "type string, path string, pass string, triage string, level string, decision string, reason string, size long, mtime long, md5 string, provenance string, "
    "desc string, ids map<string,array<string>>, tags array<string>, date_doc string, count long, total_size long, max_mtime long, tree_md5 string, stat struct<size:long,mtime:long>"
)
#: Places of a batch, or of a part of a foreign file, within seq; and of one task's rows within a batch.
_PLACES, _OF_TASK = 1 << 40, 1 << 26
#: Lines of foreign files count from here up to 0, so a new one moves no other line.
_FOREIGN = 1 << 62
_LINE = "_line"


def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the folders ``prefix``-N below a path, sorted; one listing, no file is read."""
    fs, at = _files(spark, path)
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(int(n[len(prefix) + 1 :]) for n in names if n.startswith(f"{prefix}-") and n[len(prefix) + 1 :].isdigit())


def _committed(rows: DataFrame, path: str, prefix: str) -> int:
    """Write ``rows`` under a hidden name, then rename it to the next ``prefix``-N: readers see all of it or nothing.

    A rename onto a name that another writer has just taken fails, and the next number is tried.
    """
    spark = rows.sparkSession
    hidden = f"{path.rstrip('/')}/.pending-{uuid.uuid4().hex}"
    rows.write.json(hidden)
    fs, source = _files(spark, hidden)
    while True:
        number = max(_numbered(spark, path, prefix), default=0) + 1
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{prefix}-{number:012d}")
        if not fs.exists(target) and fs.rename(source, target):
            return number


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _files(spark, path)
    return fs.exists(at)


def _foreign(spark: SparkSession, path: str) -> str:
    """What tells whether files that ``append`` did not write came or changed: their names, sizes and times."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return ""
    found, open_ = [], [fs.getFileStatus(at)]
    while open_:
        s = open_.pop()
        name = s.getPath().getName()
        if s.isFile():
            found.append(f"{s.getPath().toUri().getPath()}:{s.getLen()}:{s.getModificationTime()}")
        elif s.getPath().equals(at) or not re.match(r"[_.]|batch-\d{12}$", name):
            open_ += [x for x in fs.listStatus(s.getPath()) if not x.getPath().getName().startswith(("_", "."))]
    return "\n".join(sorted(found))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, seq of every line below a path: lines of batches follow their batch's number and their line in it,
    wherever they lie; other files come before all batches, by time of their last change, then name, then place."""
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    raw = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
    batch = F.regexp_extract("file", r"/batch-(\d{12})/[^/]*$", 1)
    raw = raw.withColumn("batch", F.when(batch != "", batch.cast("long")))
    # Parts of foreign files, a row each; one task may order them.
    parts = raw.where("batch is null").select("file", "changed", "block").distinct().withColumn("part", F.row_number().over(W.orderBy("changed", "file", "block")))
    parts = parts.select(F.col("file").alias("_f"), F.col("block").alias("_b"), "part")
    ordered = raw.join(parts, (F.col("file") == F.col("_f")) & (F.col("block") == F.col("_b")) & F.col("batch").isNull(), "left")
    return ordered.select("value", F.when(F.col("batch").isNull(), F.col("part") * _PLACES + F.col("place") - _FOREIGN).otherwise(_batch_seq()).alias("seq"))


def _batch_seq() -> Column:
    return F.col("batch") * _PLACES + F.coalesce(F.get_json_object("value", f"$.{_LINE}").cast("long"), F.col("place"))


def _later(spark: SparkSession, path: str, batches: list[int]) -> DataFrame:
    """value, seq of the lines of some batches; no other file is listed or read."""
    raw = spark.read.text([f"{path.rstrip('/')}/batch-{n:012d}" for n in batches])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    batch = F.regexp_extract("_metadata.file_path", r"/batch-(\d{12})/[^/]*$", 1).cast("long")
    return raw.select("value", batch.alias("batch"), place.alias("place")).select("value", _batch_seq().alias("seq"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """A ledger of JSON lines with seq, its lines' order. Blank and broken lines are left out; ``level`` is an older
    name of triage; size and time may lie in ``stat``.

    Lines that ``append`` wrote follow their batch's number and their line in it, wherever they lie. Other files come
    before all batches, by age. Where ``replace`` put another table in place of the ledger, that table and the batches
    after it.
    """
    made = _numbered(spark, _snapshots(path), "whole")
    return _merged(spark, path, f"whole-{made[-1]:012d}", made[-1]) if made else parsed(_lines(spark, path))


def _snapshots(path: str) -> str:
    return f"{path.rstrip('/')}/_snapshots"  # Spark's readers pass over names that begin so


def _merged(spark: SparkSession, path: str, name: str, batch: int) -> DataFrame:
    """A snapshot and the batches after the one it was made at."""
    kept = spark.read.parquet(f"{_snapshots(path)}/{name}")
    later = [n for n in _numbered(spark, path, "batch") if n > batch]
    if not later:
        return kept
    return kept.unionByName(parsed(_later(spark, path, later)), allowMissingColumns=True)


def live(ledger: DataFrame) -> DataFrame:
    """The last line of each path and content, of files and folders apart: few lines of a long history, from which
    ``latest``, ``by_content``, ``paths_by_content`` and the recorded folders are what they are from all of them."""
    folder = F.coalesce("type", F.lit("file")) == "dir"
    names = {c: f"_{c}" for c in ("path", "md5")}
    keyed = ledger.select(folder.alias("_folder"), *(F.col(c).alias(n) for c, n in names.items()), F.struct(*ledger.columns).alias("_r"), "seq")
    return keyed.groupBy("_folder", *names.values()).agg(F.max_by("_r", "seq").alias("_r")).select("_r.*")


def snapshot(spark: SparkSession, path: str) -> int:
    """Keep the ``live`` lines up to the newest batch, for ``current``; the number of that batch. It grows with paths
    and contents, not with history; the batches stay, and the two newest snapshots. A snapshot is made from the one
    before and the batches after it."""
    number, foreign = max(_numbered(spark, path, "batch"), default=0), _foreign(spark, path)
    _kept(live(current(spark, path).where(F.col("seq") < (number + 1) * _PLACES)), path, "live", number, foreign)
    return number


def replace(rows: DataFrame, path: str) -> int:
    """Put ``rows`` (with seq; a compacted ledger, say) in place of all lines so far, of which they may be made; later
    batches follow. The lines themselves stay where they are. No batch may be appended meanwhile: if one is, nothing
    is replaced (RuntimeError)."""
    spark = rows.sparkSession
    before = max(_numbered(spark, path, "batch"), default=0)
    # An empty batch marks the moment, so that snapshots of before are older than the replacement.
    placed = rows.withColumn("seq", F.least("seq", F.lit((before + 1) * _PLACES - 1)))
    number = before + 1
    pending = _pending(placed, path, "")
    if append(spark.createDataFrame([], "path string, seq long"), path) != number:
        fs, at = _files(spark, pending)
        fs.delete(at, True)
        raise RuntimeError("the ledger was appended to while it was being replaced")
    _shown(spark, pending, path, "whole", number)
    return number


def _pending(rows: DataFrame, path: str, foreign: str) -> str:
    """Where ``rows`` are kept under a hidden name, with a mark of the foreign files they were made from."""
    spark = rows.sparkSession
    hidden = f"{_snapshots(path)}/.pending-{uuid.uuid4().hex}"
    rows.write.parquet(hidden)
    fs, mark = _files(spark, f"{hidden}/_foreign")
    out = fs.create(mark, True)
    out.write(bytearray(foreign.encode()))
    out.close()
    return hidden


def _mark(spark: SparkSession, at: str) -> str:
    fs, mark = _files(spark, f"{at}/_foreign")
    stream = fs.open(mark)
    said = bytes(stream.readAllBytes()).decode()
    stream.close()
    return said


def _shown(spark: SparkSession, pending: str, path: str, prefix: str, number: int) -> None:
    at = _snapshots(path)
    fs, source = _files(spark, pending)
    target = f"{at}/{prefix}-{number:012d}"
    if fs.exists(_files(spark, target)[1]):
        fs.delete(_files(spark, target)[1], True)  # of the same batches, with other foreign files
    fs.rename(source, _files(spark, target)[1])
    for old in _numbered(spark, at, prefix)[:-2]:
        fs.delete(_files(spark, f"{at}/{prefix}-{old:012d}")[1], True)


def _kept(rows: DataFrame, path: str, prefix: str, number: int, foreign: str) -> None:
    spark = rows.sparkSession
    if number in _numbered(spark, _snapshots(path), prefix) and _mark(spark, f"{_snapshots(path)}/{prefix}-{number:012d}") == foreign:
        return
    _shown(spark, _pending(rows, path, foreign), path, prefix, number)


def current(spark: SparkSession, path: str) -> DataFrame:
    """A ledger's lines as far as the last ones matter: the newest ``snapshot`` and the batches after it, merged on
    read. Every view of last lines (``operators.ledger``: latest, by_content, paths_by_content, folders) is the same as
    of ``load``; counts of lines and passes need ``load``. Without a snapshot, or where foreign files have changed
    since, it is ``load``."""
    made = _numbered(spark, _snapshots(path), "live")
    whole = max(_numbered(spark, _snapshots(path), "whole"), default=-1)
    if not made or made[-1] < whole or _mark(spark, f"{_snapshots(path)}/live-{made[-1]:012d}") != _foreign(spark, path):
        return load(spark, path)
    return _merged(spark, path, f"live-{made[-1]:012d}", made[-1])


def parsed(raw: DataFrame) -> DataFrame:
    """Records of lines (value, seq)."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    rows = raw.where(F.trim("value") != "").withColumn("r", F.from_json("value", RECORD + ", _broken string", options)).where("r._broken is null and r.path is not null")
    out = rows.select("seq", "r.*").drop("_broken")
    return out.withColumns({"triage": F.coalesce("triage", "level"), "size": F.coalesce("size", "stat.size"), "mtime": F.coalesce("mtime", "stat.mtime")}).drop("level", "stat")


def append(rows: DataFrame, path: str, *order: str | Column) -> int:
    """Add lines as one batch, in the order of ``order`` (seq, where it is not given and there is one; else as they
    lie); the number of the batch. The batch becomes visible as a whole or not at all."""
    by = order or (("seq",) if "seq" in rows.columns else ())
    lines = rows.orderBy(*by) if by else rows
    # Sorted partitions follow each other, so task and place give the order.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    fits = (place < _OF_TASK) & (F.spark_partition_id() < _PLACES // _OF_TASK)
    number = F.when(fits, F.spark_partition_id().cast("long") * _OF_TASK + place).otherwise(F.raise_error(F.lit("too many lines for one batch")).cast("long"))
    return _committed(lines.select(*(c for c in rows.columns if c != "seq"), number.alias(_LINE)), path, "batch")


def load_entries(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A working file: a JSON list of entries, or an object that holds one under ``entries``; of a table that
    ``write_entries`` wrote, the newest version."""
    versions = _numbered(spark, path, "version")
    if versions:
        return spark.read.schema(schema).json(f"{path.rstrip('/')}/version-{versions[-1]:012d}")
    both = spark.read.schema(f"{schema}, entries array<struct<{schema}>>").json(path, multiLine=True)
    plain = both.where("entries is null").drop("entries")
    return plain.unionByName(both.where("entries is not null").select(F.explode("entries").alias("e")).select("e.*"))


def write_entries(rows: DataFrame, path: str) -> int:
    """Replace a working table by a new version; ``rows`` may come from the one before. Readers have the old version
    until the new one is whole. The last two versions stay, so that a reader in progress ends."""
    spark = rows.sparkSession
    number = _committed(rows, path, "version")
    for old in _numbered(spark, path, "version")[:-2]:
        fs, at = _files(spark, f"{path.rstrip('/')}/version-{old:012d}")
        fs.delete(at, True)
    return number


AUDIT = "rule string, candidates long, audited long, unreadable long, touched array<struct<path:string,strength:int,destination:string>>"


def write_audit(rule: str, touched: DataFrame, counts: DataFrame, logs: str) -> DataFrame:
    """Keep what a full audit found (``learn.full_audit``, ``learn.full_audit_counts``) as one record, for a person to
    judge; an audit reads a bounded number of files, so the record is bounded. The record, as it lies in the log."""
    row = F.struct(F.col("rel").alias("path"), F.col("strength").cast("int").alias("strength"), "destination")
    found = touched.agg(F.sort_array(F.collect_list(row)).alias("touched"))
    one = counts.join(F.broadcast(found)).select(F.lit(rule).alias("rule"), "candidates", "audited", "unreadable", "touched")  # one row each
    path = f"{logs.rstrip('/')}/full-audit-{rule}"
    write_entries(one, path)
    return load_entries(one.sparkSession, path, AUDIT)


def archive(spark: SparkSession, bench: str, logs: str, pass_id: str) -> str:
    """Move the working folder of a closed pass whole to the first free of ``logs``/pass, pass-2, pass-3; its path."""
    fs, source = _files(spark, bench)
    if not fs.exists(source):
        raise FileNotFoundError(bench)
    fs.mkdirs(_files(spark, logs)[1])
    number = 1
    while True:
        path = f"{logs.rstrip('/')}/{pass_id}" + (f"-{number}" if number > 1 else "")
        target = _files(spark, path)[1]
        if not fs.exists(target) and fs.rename(source, target):
            return path
        number += 1
