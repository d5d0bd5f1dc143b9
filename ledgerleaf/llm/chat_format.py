"""Chat formatting in budgeted windows with a loss mask (native DataFrame operations only).

A turn is written ``### role: text</turn>`` and a newline. Inside roles and texts a backslash follows each of the
characters ``\\ # < :``, so no mark occurs there and the text can be read back.

Prefix sums of a conversation's turn tokens cut it into spans of whole turns; each span becomes one window: the system
turn, as many of the turns just before the span as fit the history budget, then the span's own turns. Only the
assistant texts of the span itself are targets; repeated history and system turns are masked. So each assistant text
is a target exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

BUDGET = 512
HISTORY = 128
#: Tokens of a turn's own marks.
MARKS = 4
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"
END = "</turn>\n"
NASTY = r"\### Assistant: </turn> ok"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<:])", r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<:])\\", "$1")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escaped(role), F.lit(": "), escaped(text), F.lit(END))


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, idx, role, body, tokens, head (the system turn that opens its conversation).

    Turns are ordered by turn, then role, then text; null roles and texts are empty, null turns come first, and
    repeated rows are turns of their own. Rows of a null conv_id are one conversation.
    """
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    tokens = F.regexp_count("text", F.lit(TOKEN)) + F.regexp_count("role", F.lit(TOKEN)) + MARKS
    idx = F.row_number().over(order)
    return clean.select("conv_id", idx.alias("idx"), "role", rendered(F.col("role"), F.col("text")).alias("body"), F.length(escaped(F.col("text"))).alias("text_len"), tokens.cast("long").alias("tokens")).withColumn(
        "head", (F.col("idx") == 1) & (F.col("role") == "system")
    )


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, formatted, n_repeated, n_turns, n_tokens, loss (array of start, length into ``formatted``).

    n_repeated turns lead a window without being new in it; n_turns counts all its turns. A window keeps within
    ``budget`` tokens unless a single turn alone does not fit; such a turn is the only new one of its window.
    Positions count code points from 0. Empty table: no windows.
    """
    t = turns(rows)
    conv, ordered = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy("idx")
    before = ordered.rowsBetween(W.unboundedPreceding, -1)
    system = F.max(F.when(F.col("head"), F.col("tokens")).otherwise(0)).over(conv)
    start = F.coalesce(F.sum(F.when(~F.col("head"), F.col("tokens"))).over(before), F.lit(0))
    t = t.withColumn("system", system).withColumn("start", start)
    # Half of what system turn and history leave: turns that start in the same half-room, none longer than it, fit.
    t = t.withColumn("room", F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system")) / 2))).withColumn("cell", F.floor(F.col("start") / F.col("room")))
    long = F.col("tokens") > F.col("room")
    lag = lambda c: F.lag(c).over(ordered)
    opens = F.coalesce(lag(F.col("cell")) != F.col("cell"), F.lit(True)) | long | F.coalesce(lag(long), F.lit(False)) | F.coalesce(lag(F.col("head")), F.lit(False))
    # The head joins the first span; where it is alone, it is that span.
    opens = F.when(F.col("idx") == 1, F.lit(True)).when(lag(F.col("head")), F.lit(False)).otherwise(opens)
    t = t.withColumn("window", F.sum(opens.cast("int")).over(ordered) - 1)
    first = opens & (F.col("window") > 0)
    t = t.withColumn("first", first).withColumn("turn", F.struct("idx", "role", "body", "text_len", "tokens")).select("conv_id", "head", "start", "window", "first", "turn")

    # A turn goes into its own window and, as history, into those that begin up to `history` tokens after it (every
    # turn has some, so they are few); the system turn goes with the first turn of each later window. All of it is
    # known where a conversation lies, so texts are dealt out once and joined with nothing.
    placed = lambda window, part, turn: F.struct(window.cast("long").alias("window"), F.lit(part).alias("part"), turn.alias("turn"))
    own = F.array(F.when(F.col("head"), placed(F.col("window"), 0, F.col("turn"))).otherwise(placed(F.col("window"), 2, F.col("turn"))))
    none = F.slice(own, 1, 0)
    ahead = conv.orderBy(F.when(~F.col("head"), F.col("start")).asc_nulls_first()).rangeBetween(1, history)
    later = F.collect_list(F.when(F.col("first"), F.col("window"))).over(ahead) if history else F.array().cast("array<long>")
    t = t.withColumns({"later": later, "system": F.max(F.when(F.col("head"), F.col("turn"))).over(conv)})
    repeated = F.when(~F.col("head"), F.transform("later", lambda w: placed(w, 1, F.col("turn")))).otherwise(none)
    lead = F.when(F.col("first") & F.col("system").isNotNull(), F.array(placed(F.col("window"), 0, F.col("system")))).otherwise(none)
    out = t.select("conv_id", F.inline(F.concat(own, repeated, lead))).select("conv_id", "window", "part", "turn.*")

    # A window holds at most its budget of tokens, and every turn has some, so these arrays are bounded.
    parts = out.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("part", "idx", "role", "body", "text_len", "tokens"))).alias("turns"))
    is_new = lambda x: (x["part"] == 2) | ((x["part"] == 0) & (F.col("window") == 0))
    empty = F.lit([]).cast("array<struct<start:int,length:int>>")
    spot = lambda acc, x: F.array(F.struct((acc["at"] + F.length(x["body"]) - len(END) - x["text_len"]).cast("int").alias("start"), x["text_len"].cast("int").alias("length")))
    loss = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), empty.alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["body"])).alias("at"),
            F.when((x["part"] == 2) & (x["role"] == "assistant"), F.concat(acc["loss"], spot(acc, x))).otherwise(acc["loss"]).alias("loss"),
        ),
        lambda acc: acc["loss"],
    )
    return parts.select(
        "conv_id",
        "window",
        F.array_join(F.transform("turns", lambda x: x["body"]), "").alias("formatted"),
        F.size(F.filter("turns", lambda x: ~is_new(x))).alias("n_repeated"),
        F.size("turns").alias("n_turns"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"),
        loss.alias("loss"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """conv_id, window, turns (array of role, text: the turns that are new in the window), targets (array of text)."""
    chunks = F.slice(F.split("formatted", END), F.col("n_repeated") + 1, F.col("n_turns") - F.col("n_repeated"))
    # The first ": " ends the role: inside a role a backslash follows every colon.
    part = lambda c, k: unescaped(F.regexp_extract(c, r"(?s)^### (.*?): (.*)$", k))
    turn = lambda c: F.struct(part(c, 1).alias("role"), part(c, 2).alias("text"))
    target = lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    return made.select("conv_id", "window", F.length("formatted").cast("long").alias("chars"), F.transform(chunks, turn).alias("turns"), F.transform("loss", target).alias("targets"))


def digests(rows: DataFrame, **options) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    back = read_back(windows(rows, **options))
    piece = back.select(
        "conv_id",
        "window",
        "chars",
        F.size("turns").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("targets", "").alias("targets"),
    )
    # A digest of a whole conversation needs the conversation's text in one row.
    whole = piece.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("window", "turns", "targets"))).alias("all"))
    text = lambda f: F.array_join(F.transform("all", lambda x: x[f]), "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(text("turns"), 256).alias("turns_sha256"),
        F.length(text("targets")).cast("long").alias("loss_chars"),
        F.sha2(text("targets"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nasty = spark.sql("SELECT -7L AS conv_id, posexplode(array('user', 'assistant')) AS (turn, role)").select("conv_id", F.col("turn").cast("long"), "role", F.lit(NASTY).alias("text"))
    return digests(rows.unionByName(nasty))


ORACLE = rf"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '{NASTY}' FROM range(2) x(t)
), e AS (
  SELECT *, regexp_replace(role, '([\\#<:])', '\1\\', 'g') AS erole, regexp_replace(text, '([\\#<:])', '\1\\', 'g') AS etext,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx,
    len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) + len(regexp_extract_all(role, '[\p{{L}}\p{{N}}]+|[^\s\p{{L}}\p{{N}}]')) + {MARKS} AS tokens
  FROM r
), h AS (
  SELECT *, length('### ' || erole || ': ' || etext || '</turn>') + 1 AS chars, idx = 1 AND role = 'system' AS head FROM e
), p AS (
  SELECT *, max(CASE WHEN head THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
    coalesce(sum(CASE WHEN head THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM h
), c AS (
  SELECT *, greatest(1, floor(({BUDGET} - {HISTORY} - sys) / 2)) AS room FROM p
), o AS (
  SELECT *, CASE WHEN idx = 1 THEN 1 WHEN lag(head) OVER w THEN 0
    WHEN floor(start / room) <> lag(floor(start / room)) OVER w OR tokens > room OR lag(tokens > room) OVER w THEN 1 ELSE 0 END AS opens
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY idx)
), s AS (
  SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS win FROM o
), spans AS (
  SELECT conv_id, win, min(CASE WHEN NOT head THEN start END) AS span_start FROM s GROUP BY 1, 2
), f AS (
  SELECT conv_id, chars FROM s
  UNION ALL SELECT s.conv_id, s.chars FROM s JOIN spans USING (conv_id) WHERE NOT s.head AND s.start < span_start AND span_start - s.start <= {HISTORY}
  UNION ALL SELECT s.conv_id, s.chars FROM s JOIN spans ON s.conv_id = spans.conv_id AND spans.win > 0 WHERE s.head
), fc AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM f GROUP BY 1),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '') AS loss
  FROM e GROUP BY 1
)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM d JOIN fc USING (conv_id)
"""
