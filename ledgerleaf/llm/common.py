"""Shared pieces of the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and word as the contracts define them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session may go without it (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = spark.conf.get("ledgerleaf.shared.dir", None)
        if not at:
            at = tempfile.mkdtemp(prefix="ledgerleaf-")
            spark.conf.set("ledgerleaf.shared.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    It cuts lineage: a lost executor costs no recomputation beyond this table, and values that depend on how rows
    were dealt (row keys, ranks, names) are fixed once and read alike by every later stage.
    """
    path = f"{shared_dir(df.sparkSession)}/ledgerleaf/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_anew(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows with integer keys as new expressions, which a join on them deals out itself.

    An aggregate's rows lie where its keys put them, and a join would take both sides as they lie, in the same tasks
    as the aggregate. Dealt anew, the other side's rows of a key that very many have can be split.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys})


def removed(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote and nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for name in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(name).getParent()
            if "/ledgerleaf/" in path.toString():
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """``removed``, and let Spark free shuffles out of use."""
    removed(*tables)
    freed(tables[0].sparkSession)


def freed(spark: SparkSession) -> None:
    """Let Spark remove shuffle files that no plan refers to any more; it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def free_name(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def row_key(seed: int, id_: Column, text: Column) -> Column:
    """What finds a row of a table again: 256 bits (SHA-2) of seed, id and text, so that no two different rows of any
    corpus have one key. Rows that repeat do."""
    null = lambda c: F.when(c.isNull(), F.lit("null")).otherwise(F.lit("said"))
    id_, text = id_.cast("string"), text.cast("string")
    said = F.concat(F.lit(f"{seed} "), null(id_), null(text), F.sha2(F.coalesce(id_, F.lit("")), 256), F.coalesce(text, F.lit("")))
    return F.unhex(F.sha2(said, 256))


def rows_of(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is the one column of ``kept``, whose values are distinct; of rows that share
    a key, one."""
    name = free_name("row_key", docs)
    found = docs.withColumn(name, key).join(kept.toDF(name), name, "left_semi")
    # Only keys that repeat move; where none does, nothing is dealt out.
    many = docs.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name)
    if not many.take(1):
        return found.select(*docs.columns)
    once = found.join(many, name, "left_anti").unionByName(found.join(many, name, "left_semi").dropDuplicates([name]))
    return once.select(*docs.columns)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python workers no more than ``rows`` at a time, where the session still has Spark's default.

    A worker holds a batch several times over (Arrow, strings, results), and whole texts are long.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def with_arrow(batch, **columns):
    """An Arrow batch with more columns, or others under the same names; all else stays as it is, nulls included."""
    import pyarrow as pa

    have = dict(zip(batch.schema.names, batch.columns, strict=True)) | {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays(list(have.values()), names=list(have))


def normal_space(text: Column) -> Column:
    """Null as empty; each run of white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def power_of_two(at_least: float, most: int) -> int:
    """The smallest n with 2**n >= at_least, from 0 to most."""
    return min(most, max(0, int(at_least - 1).bit_length()))
