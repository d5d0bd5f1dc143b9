"""How the given tables stand in for a corpus: documents as entries, events as a ledger, orders as dated texts.

Each view exists twice, as a DataFrame and as a common table expression of the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "/corpus"
YEAR = 2025


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rel = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select("doc_id", rel.alias("rel"), F.lit(".txt").alias("ext"), F.octet_length("text").cast("long").alias("size"), F.md5("text").alias("md5"), "text", "source", "lang")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    decision = F.when(F.col("event_type") == "click", "none").when(F.col("event_type") == "error", "refused").when(F.col("event_type") == "purchase", "move").when(F.col("event_type") == "signup", "tag").otherwise("unanswered")
    lane = F.element_at(F.array(*(F.lit(x) for x in ("route", "propose", "residual", "skip"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path"),
        F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-1")).alias("pass"),
        lane.alias("triage"),
        decision.alias("decision"),
        F.col("event_type").alias("reason"),
        (F.col("event_id") % 1000).alias("size"),
        F.unix_timestamp("ts").alias("mtime"),
        F.md5(F.concat((F.col("user_id") % 50).cast("string"), F.col("event_type"))).alias("md5"),
        F.when(F.col("event_id") % 7 == 0, "human-decision").otherwise("pass").alias("provenance"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_type"), F.lit(" par l’usager "), F.col("user_id").cast("string"))).alias("desc"),
        F.date_format("ts", "yyyy-MM-dd").alias("date_doc"),
        F.array("event_type").alias("tags"),
        F.lit(None).cast("map<string,array<string>>").alias("ids"),
    )


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    said = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(", due "), F.date_format(F.date_add("o_orderdate", 40), "dd/MM/yyyy"), F.lit(" or "), F.date_format("o_orderdate", "MM/yyyy"), F.lit(" at 2045 Main Street"))
    return o.select("o_orderkey", said.alias("text"), F.concat(F.lit("orders/"), F.col("o_orderpriority"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("rel"), F.lit(".pdf").alias("ext"), F.length(said).cast("long").alias("size"))


def norm_sql(x: str) -> str:
    return rf"""trim(regexp_replace(strip_accents(replace(lower(translate({x},'’‘ʼ“”–—'||chr(160),'''''''""-- ')),'ß','ss')),'\s+',' ','g'))"""


def flat_sql(x: str) -> str:
    return rf"trim(regexp_replace({x},'\s+',' ','g'))"


# Forms of a date, as in functions/identifiers, in SQL.
DATES_SQL = (
    r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.]\d{1,2}[/.]\d{2,4}\b|\b\d{1,2}(?:er|st|nd|rd|th)?\s+(?:jan(?:vier|uary)?|f[eé]v(?:rier)?|feb(?:ruary)?|mar(?:s|ch)?|avr(?:il)?|apr(?:il)?|mai|may|juin|june?|juil(?:let)?|july?|"
    r"ao[uû]t|aug(?:ust)?|sep(?:t(?:embre|ember)?)?|oct(?:obre|ober)?|nov(?:embre|ember)?|d[eé]c(?:embre|ember)?)\s+\d{4}\b|\b(?:0[1-9]|1[0-2])/\d{4}\b"
)
ENTRIES = f"""e AS (
  SELECT doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS rel, '.txt' AS ext, strlen(text) AS size, md5(text) AS md5, text, source, lang,
    {norm_sql('text')} AS tn, replace({norm_sql('text')}, ' ', '') AS tg FROM documents)"""
LEDGER = """l AS (
  SELECT event_id AS seq, 'u' || (user_id % 20) || '/' || user_id || '.txt' AS path, strftime(ts, '%Y-%m-%d') || '-1' AS pass,
    ['route', 'propose', 'residual', 'skip'][event_id % 4 + 1] AS triage,
    CASE event_type WHEN 'click' THEN 'none' WHEN 'error' THEN 'refused' WHEN 'purchase' THEN 'move' WHEN 'signup' THEN 'tag' ELSE 'unanswered' END AS decision,
    event_type AS reason, event_id % 1000 AS size, floor(epoch(ts))::BIGINT AS mtime, md5((user_id % 50) || event_type) AS md5,
    CASE WHEN event_id % 7 = 0 THEN 'human-decision' ELSE 'pass' END AS provenance,
    CASE WHEN event_id % 3 = 0 THEN event_type || ' par l’usager ' || user_id END AS descr, strftime(ts, '%Y-%m-%d') AS date_doc FROM events),
now AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1)"""
DATED = """o AS (
  SELECT o_orderkey, 'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ', due ' || strftime(o_orderdate::DATE + 40, '%d/%m/%Y') || ' or ' || strftime(o_orderdate, '%m/%Y') || ' at 2045 Main Street' AS text,
    'orders/' || o_orderpriority || '/' || o_orderkey || '.pdf' AS rel FROM orders)"""
