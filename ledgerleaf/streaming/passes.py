"""Passes as a stream: each micro-batch of entries is routed and its lines are appended to the ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerleaf.operators import collect, route
from ledgerleaf.sources import doctree, ledger_file


def lines(entries: DataFrame, config: dict, ledger: DataFrame | None, pass_id: str) -> DataFrame:
    """Ledger lines of a batch, without those that a first attempt at this pass wrote already."""
    made = route.triage(entries, config, ledger)
    rows = made.select(F.lit("file").alias("type"), F.col("rel").alias("path"), F.lit(pass_id).alias("pass"), "triage", F.lit(None).cast("string").alias("decision"), F.col("why").alias("reason"), "size", *(("mtime",) if "mtime" in made.columns else ()), "md5", F.lit("pass").alias("provenance"))
    if ledger is None:
        return rows
    return rows.join(ledger.where(F.col("pass") == pass_id).select("path"), "path", "left_anti")


def start(stream: DataFrame, config: dict, read: Callable[[], DataFrame | None], write: Callable[[DataFrame], None], checkpoint: str, day: str) -> StreamingQuery:
    """Start routing ``stream``. A batch's number names its pass, so a batch that is run again adds nothing."""

    def batch(entries: DataFrame, number: int) -> None:
        write(lines(entries, config, read(), f"{day}-{number + 1}"))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def from_folder(spark: SparkSession, roots: list[str], config: dict, ledger: str, checkpoint: str, day: str, as_of_year: int, **options) -> StreamingQuery:
    """Passes over what changes below ``roots``: each micro-batch is what changed since the one before, its evidence is
    derived, routed and appended to the ledger at the path ``ledger``. ``options`` are those of the tree."""
    files = doctree.stream(spark, roots, **options).where("kind = 'file'").drop("why").withColumn("error", F.lit(None).cast("string"))
    kinds = config.get("identifiers")

    def read() -> DataFrame | None:
        return ledger_file.current(spark, ledger) if ledger_file.exists(spark, ledger) else None

    def write(made: DataFrame) -> None:
        ledger_file.append(made, ledger, "path")

    return start(collect.evidence(files, as_of_year, kinds), config, read, write, checkpoint, day)
