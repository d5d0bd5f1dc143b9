"""Ledger, selection, triage, plan, learning and compaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, paths
from ledgerleaf.functions import text as t
from ledgerleaf.operators import apply, collect, compact, learn, route
from ledgerleaf.operators import ledger as log
from ledgerleaf.plans.conditions import prepared, sensitive_hit

from .standins import DATED, DATES_SQL, ENTRIES, LEDGER, ROOT, YEAR, dated, entries, flat_sql, ledger, norm_sql, table
from .text import ORACLES as TEXT_ORACLES
from .text import _says

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- ledger


@query(f"WITH {LEDGER} SELECT path, seq, decision, md5 FROM now")
def ledger_latest(spark, sf):
    return log.latest(ledger(spark, sf)).select("path", "seq", "decision", "md5")


@query(f"WITH {LEDGER} SELECT md5, path, seq FROM l QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY seq DESC) = 1")
def ledger_by_md5(spark, sf):
    return log.by_content(ledger(spark, sf)).select("md5", "path", "seq")


@query(
    f"""WITH {LEDGER} SELECT 'pass' AS kind, pass AS value, count(*) AS n FROM now GROUP BY 2 UNION ALL SELECT 'triage', triage, count(*) FROM now GROUP BY 2
UNION ALL SELECT 'decision', decision, count(*) FROM now GROUP BY 2 UNION ALL SELECT 'provenance', provenance, count(*) FROM now GROUP BY 2
UNION ALL SELECT 'lines', NULL, count(*) FROM l UNION ALL SELECT 'distinct_files', NULL, count(*) FROM now UNION ALL SELECT 'with_desc', NULL, count(descr) FROM now"""
)
def ledger_stats(spark, sf):
    return log.stats(ledger(spark, sf))


@query(f"WITH {LEDGER} SELECT path, seq FROM now WHERE contains({norm_sql("coalesce(descr, '') || ' ' || path")}, 'click par l''usager')")
def ledger_find(spark, sf):
    return log.find(ledger(spark, sf), "CLICK par l'usager").select("path", "seq")


@query(f"WITH {LEDGER}, f AS (SELECT path, min(seq) AS first FROM l GROUP BY 1) SELECT now.path, now.seq FROM now JOIN f USING (path) WHERE ends_with(now.path, '7.txt') ORDER BY first LIMIT 1")
def ledger_show(spark, sf):
    return log.show(ledger(spark, sf), "7.txt").select("path", "seq")


@query("SELECT '2024-01-01-' || (count(DISTINCT pass) FILTER (starts_with(pass, '2024-01-01-')) + 1) AS pass_id FROM (SELECT strftime(ts, '%Y-%m-%d') || '-' || (event_id % 3) AS pass FROM events)")
def next_pass(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("-"), (F.col("event_id") % 3).cast("string")).alias("pass"))
    return log.next_pass(e, "2024-01-01")


@query(
    f"""WITH {LEDGER}, v AS (SELECT now.pass, count(*) AS n, min(u.user_id) AS first FROM (SELECT DISTINCT user_id FROM events) u JOIN now ON now.path = 'u' || (u.user_id % 20) || '/' || u.user_id || '.txt' GROUP BY 1)
SELECT pass, n FROM v ORDER BY n DESC, first LIMIT 1"""
)
def pass_vote(spark, sf):
    u = table(spark, sf, "events").select("user_id").distinct()
    rows = u.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path"), F.col("user_id").alias("ord"))
    return log.vote(rows, ledger(spark, sf))


@query(
    rf"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE d END AS descr, CASE WHEN p_partkey % 4 <> 0 AND list_has_all(b, a) AND len(a) > 0 THEN 'the description repeats the file name' END AS rejected
FROM (SELECT *, list_filter(regexp_split_to_array(lower(d), '[^a-z0-9]+'), lambda x: length(x) > 2) AS a, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 2) AS b
  FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS d FROM part))"""
)
def ledger_record(spark, sf):
    d = F.when(F.col("p_partkey") % 4 == 0, "  ").when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_type"))
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("x/"), "p_name", F.lit(".pdf")).alias("path"), d.alias("desc"))
    return log.record(p).select("p_partkey", F.col("desc").alias("descr"), "rejected")


@query(
    """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE event_id END AS seq, 'p' || user_id AS path, event_type, event_id % 4 AS k FROM events)
SELECT event_id, path, event_type AS decision, CASE k WHEN 2 THEN 'route' ELSE 'propose' END AS triage, event_id AS size FROM x WHERE k >= 2"""
)
def ledger_load(spark, sf):
    """Lines of several forms, written as text and loaded; their size is their event."""
    from ledgerleaf.sources import ledger_file
    from ledgerleaf.sources.scratch import scratch

    e = table(spark, sf, "events")
    path, said = F.concat(F.lit('"path": "p'), F.col("user_id").cast("string"), F.lit('"')), F.concat(F.lit('"decision": "'), "event_type", F.lit('"'))
    number = F.col("event_id").cast("string")
    full = F.concat(F.lit("{"), path, F.lit(", "), said, F.lit(', "triage": "route", "size": '), number, F.lit("}"))
    older = F.concat(F.lit("{"), path, F.lit(", "), said, F.lit(', "level": "propose", "stat": {"size": '), number, F.lit(', "mtime": 1}}'))
    line = F.when(F.col("event_id") % 4 == 0, "  ").when(F.col("event_id") % 4 == 1, F.concat(F.lit("{"), path, F.lit(", oops"))).when(F.col("event_id") % 4 == 2, full).otherwise(older)
    path = scratch(spark, "lines")
    e.select(line.alias("value")).write.text(path)
    return ledger_file.load(spark, path).select(F.col("size").alias("event_id"), "path", "decision", "triage", "size")


@query(f"WITH {LEDGER} SELECT path, decision, triage, size FROM l QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq % 10 <> 0 DESC, seq DESC) = 1")
def ledger_append(spark, sf):
    """A small batch of lines, then a large one; the last line of each path as it is loaded again."""
    from ledgerleaf.sources import ledger_file
    from ledgerleaf.sources.scratch import scratch

    rows, path = ledger(spark, sf), scratch(spark, "ledger")
    ledger_file.append(rows.where("seq % 10 = 0").repartition(7), path)
    ledger_file.append(rows.where("seq % 10 <> 0").repartition(3), path)
    return log.latest(ledger_file.load(spark, path)).select("path", "decision", "triage", "size")


# ---------------------------------------------------------------- selection

#: A walk in which some files are as recorded, some touched, some changed, some new, some in an inbox.
_WALK = """w AS (SELECT p.rel, CASE p.k % 3 WHEN 0 THEN p.size ELSE p.size + 1 END AS size, p.mtime, CASE WHEN p.k % 3 = 2 THEN md5(p.md5) ELSE p.md5 END AS md5, CASE WHEN p.k % 5 = 0 THEN 'in' END AS inbox FROM
  (SELECT path AS rel, size, mtime, md5, regexp_extract(path, '/(\\d+)', 1)::BIGINT AS k FROM now UNION ALL SELECT 'new/' || s_suppkey || '.txt', s_suppkey, 0, md5(s_name), s_suppkey FROM supplier) p)"""
_BANDS = f"""{LEDGER}, {_WALK.replace(chr(92) * 2, chr(92))}, b AS (SELECT w.*, CASE WHEN now.decision IN ('unanswered', 'refused') THEN 0 WHEN now.path IS NOT NULL AND ((w.size = now.size AND w.mtime = now.mtime) OR w.md5 IS NOT DISTINCT FROM now.md5) THEN NULL
  WHEN w.inbox IS NOT NULL THEN 1 ELSE 2 END AS band FROM w LEFT JOIN now ON w.rel = now.path)"""


def walk(spark, sf):
    now = log.latest(ledger(spark, sf)).select(F.col("path").alias("rel"), "size", "mtime", "md5", F.regexp_extract("path", r"/(\d+)", 1).cast("long").alias("k"))
    new = table(spark, sf, "supplier").select(F.concat(F.lit("new/"), F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("rel"), F.col("s_suppkey").alias("size"), F.lit(0).cast("long").alias("mtime"), F.md5("s_name").alias("md5"), F.col("s_suppkey").alias("k"))
    p = now.unionByName(new)
    return p.select("rel", F.when(F.col("k") % 3 == 0, F.col("size")).otherwise(F.col("size") + 1).alias("size"), "mtime", F.when(F.col("k") % 3 == 2, F.md5("md5")).otherwise(F.col("md5")).alias("md5"), F.when(F.col("k") % 5 == 0, "in").alias("inbox"))


@query(f"WITH {_BANDS} SELECT rel, band FROM b WHERE band IS NOT NULL")
def select_candidates(spark, sf):
    return collect.candidates(walk(spark, sf), ledger(spark, sf)).select("rel", "band")


@query(f"WITH {_BANDS} SELECT rel, band FROM b WHERE band IS NOT NULL ORDER BY band, split_part(rel, '/', 1), split_part(rel, '/', 2) LIMIT 60")
def batch_select(spark, sf):
    return collect.batch(collect.candidates(walk(spark, sf), ledger(spark, sf)), 60).select("rel", "band")


@query(f"WITH {_BANDS} SELECT count(*) AS scanned, count(band) AS candidates, count(*) - count(band) AS seen, count(*) FILTER (band = 0) AS retried, count(*) FILTER (band = 1) AS in_inboxes, count(*) FILTER (band = 2) AS elsewhere, least(count(band), 60) AS selected FROM b")
def collect_counts(spark, sf):
    return collect.counts(collect.bands(walk(spark, sf), ledger(spark, sf)), 60)


@query(
    f"""WITH {_BANDS}, s AS (SELECT * FROM b WHERE band IS NOT NULL ORDER BY band, split_part(rel, '/', 1), split_part(rel, '/', 2) LIMIT 60), i AS (SELECT unnest(['in', 'empty']) AS inbox)
SELECT inbox, (SELECT count(*) FROM b WHERE b.inbox = i.inbox AND band IS NOT NULL) AS candidates, (SELECT count(*) FROM s WHERE s.inbox = i.inbox) AS selected,
  (SELECT count(*) FROM b WHERE b.inbox = i.inbox AND band IS NOT NULL) - (SELECT count(*) FROM s WHERE s.inbox = i.inbox) AS remaining FROM i"""
)
def inbox_accounting(spark, sf):
    found = collect.candidates(walk(spark, sf), ledger(spark, sf))
    return collect.inbox_accounting(found, collect.batch(found, 60), ["in", "empty"])


@query(f"WITH {ENTRIES}, g AS (SELECT size, md5, list_sort(list(rel)) AS rels FROM e WHERE size > 0 GROUP BY 1, 2 HAVING count(*) > 1) SELECT e.rel, array_to_string(list_filter(g.rels, lambda x: x <> e.rel), '|') AS twins FROM e JOIN g USING (size, md5)")
def duplicates(spark, sf):
    return collect.duplicates(entries(spark, sf)).select("rel", F.array_join("duplicate_of", "|").alias("twins"))


@query(
    f"""WITH {LEDGER}, {_WALK.replace(chr(92) * 2, chr(92))}, m AS (SELECT md5, path, descr FROM l QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY seq DESC) = 1)
SELECT w.rel, m.path AS known_as FROM w JOIN m USING (md5) WHERE m.path <> w.rel AND m.path IN (SELECT rel FROM w)"""
)
def known_as(spark, sf):
    return collect.known_as(walk(spark, sf), ledger(spark, sf)).select("rel", "known_as")


@query(f"WITH {ENTRIES} SELECT doc_id FROM e WHERE NOT (source IN ('src3', 'src4') OR starts_with(rel, 'src5/fr/'))")
def dir_prune(spark, sf):
    folders = spark.createDataFrame([("src3",), ("src4",), ("src5/fr",)], "path string")
    return collect.pruned_by_folder(entries(spark, sf), folders).select("doc_id")


@query(f"WITH {ENTRIES} SELECT source AS dir, count(*) AS count, sum(size)::BIGINT AS total_size, max(doc_id) AS max_mtime, md5(string_agg(rel || ':' || md5 || chr(10), '' ORDER BY rel, md5)) AS tree_md5 FROM e GROUP BY 1")
def dir_fingerprint(spark, sf):
    return collect.folder_fingerprint(entries(spark, sf).withColumn("mtime", F.col("doc_id")), F.col("source"))


@query(
    f"""WITH {DATED} SELECT o_orderkey, (o_orderkey % 6) AS k, CASE WHEN o_orderkey % 6 IN (0, 1, 2) THEN NULL ELSE text END AS text,
  CASE WHEN o_orderkey % 6 = 0 THEN 'symlink' WHEN o_orderkey % 6 = 1 THEN 'no-content' END AS opaque, o_orderkey % 6 = 2 AS needs_vision, CASE WHEN o_orderkey % 6 >= 3 THEN year(o_orderdate::DATE + 40) ELSE 0 END AS doc_year FROM o JOIN orders USING (o_orderkey)"""
)
def evidence(spark, sf):
    k = F.col("o_orderkey") % 6
    d = dated(spark, sf).select("o_orderkey", "rel", "ext", F.when(k >= 3, F.col("text")).when(k == 2, "/12 /33 /29").alias("text"), F.when(k == 2, 5000).otherwise(F.when(k == 1, 100).otherwise(F.col("size"))).cast("long").alias("size"), F.when(k == 0, "x").alias("link_to"), F.lit(None).cast("string").alias("error"))
    return collect.evidence(d, YEAR + 10).select("o_orderkey", k.alias("k"), "text", "opaque", "needs_vision", F.coalesce("doc_year", F.lit(0)).alias("doc_year"))


# ---------------------------------------------------------------- triage

RULES = [
    {"id": "old", "status": "retired", "when": {"has_text": True}, "destination": "Never/"},
    {"id": "license", "status": "active", "when": {"text_contains_any": ["license"]}, "destination": "Legal/{ext}"},
    {"id": "src1", "status": "active", "when": {"path_under": ["src1"]}},
    {"id": "long", "status": "shadow", "when": {"size_gt": 5000}, "destination": "Long/{stem}"},
    {"id": "und", "status": "shadow", "when": {"text_contains_any": ["und"], "has_text": True}, "tags": ["en"]},
    {"id": "dated", "when": {"ext": [".txt"], "size_gt": 9000}, "destination": "{doc_year}/x"},
]
CONFIG = {"root": ROOT, "inboxes": [{"path": "src0"}], "sensitive": {"id_kind_present": ["email"]}, "rules": RULES, "entities": []}
_MAIL = rf"regexp_matches({flat_sql('text')}, '{identifiers.PATTERNS['email']}')"
_TRIAGE = f"""{ENTRIES}, f AS (SELECT *, {_MAIL} AS mail, count(*) OVER (PARTITION BY size, md5) > 1 AND size > 0 AS dup, {_says('license')} AS lic, contains('/' || rel, '/src1') AS p FROM e),
r AS (SELECT *, CASE WHEN mail THEN 'sensitive' WHEN dup THEN 'duplicate' WHEN source = 'src0' THEN 'inbox' WHEN lic THEN 'license' WHEN p THEN 'src1' ELSE 'none' END AS who FROM f),
t AS (SELECT *, CASE WHEN who = 'license' THEN 'route' WHEN who = 'none' THEN 'residual' ELSE 'propose' END AS triage FROM r)"""


def triaged(spark, sf):
    e = entries(spark, sf).withColumn("ids", identifiers.extract_ids(F.col("text")))
    twins = collect.first_twin(e).select("rel", F.array("twin").alias("duplicate_of"))
    return route.triage(e.join(twins, "rel", "left"), CONFIG)


@query(f"WITH {_TRIAGE} SELECT triage, who AS decided_by, count(*) AS n FROM t GROUP BY 1, 2")
def triage_documents(spark, sf):
    made = triaged(spark, sf)
    by = F.when(F.size("guards") > 0, F.get("guards", 0)).otherwise(F.coalesce("rule", F.lit("none")))
    return made.groupBy("triage", by.alias("decided_by")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_TRIAGE}, w AS (SELECT rel, size, md5, lag(rel) OVER (PARTITION BY size, md5 ORDER BY rel) AS a, first(rel) OVER (PARTITION BY size, md5 ORDER BY rel) AS b, lead(rel) OVER (PARTITION BY size, md5 ORDER BY rel) AS c FROM e)
SELECT t.rel, triage, CASE who WHEN 'sensitive' THEN 'sensitive (id_kind_present: email)' WHEN 'duplicate' THEN 'byte-identical to ' || CASE WHEN w.b = t.rel THEN w.c ELSE w.b END || ' (md5 ' || t.md5 || ')'
  WHEN 'inbox' THEN 'sitting in inbox src0 — never a silent route' WHEN 'license' THEN 'rule license (evidence strength 2)' WHEN 'src1' THEN 'rule src1 matched on the path or filename alone'
  ELSE CASE WHEN trim(text) = '' THEN 'no text to reason on' ELSE 'no rule matched' END END AS why,
  array_to_string(list_filter([CASE WHEN mail THEN 'sensitive' END, CASE WHEN dup THEN 'duplicate' END, CASE WHEN source = 'src0' THEN 'inbox' END], lambda x: x IS NOT NULL), ',') AS guards,
  CASE WHEN who = 'license' THEN 'Legal/txt/' END AS destination FROM t JOIN w USING (rel)"""
)
def route_triage(spark, sf):
    return triaged(spark, sf).select("rel", "triage", "why", F.array_join("guards", ",").alias("guards"), "destination")


@query(f"WITH {_TRIAGE}, x AS (SELECT unnest(['route', 'propose', 'residual', 'skip', 'withdrawn']) AS triage) SELECT x.triage, count(t.rel) AS n FROM x LEFT JOIN (SELECT rel, CASE WHEN doc_id % 10 = 3 THEN 'withdrawn' ELSE triage END AS triage FROM t) t USING (triage) GROUP BY 1")
def triage_counts(spark, sf):
    e = entries(spark, sf).withColumn("ids", identifiers.extract_ids(F.col("text"))).withColumn("decision", F.when(F.col("doc_id") % 10 == 3, "unanswered"))
    twins = collect.first_twin(e).select("rel", F.array("twin").alias("duplicate_of"))
    made = route.acting_rules_are_active(route.routed(e.join(twins, "rel", "left"), CONFIG), CONFIG)
    return route.lane_counts(made)


@query(
    f"""WITH {_TRIAGE} SELECT 'rule' AS kind, who AS rule, count(*) AS n FROM t WHERE who IN ('license', 'src1') GROUP BY 2 UNION ALL SELECT 'shadow', 'long', count(*) FROM t WHERE size > 5000 HAVING count(*) > 0
UNION ALL SELECT 'shadow', 'und', count(*) FROM t WHERE {_says('und')} AND text <> '' HAVING count(*) > 0 UNION ALL SELECT 'shadow', 'dated', count(*) FROM t WHERE size > 9000 HAVING count(*) > 0"""
)
def by_rule(spark, sf):
    return route.rule_counts(triaged(spark, sf))


@query(f"WITH {ENTRIES} SELECT rel, CASE WHEN {_says('license')} THEN 'license' WHEN contains('/' || rel, '/src1') THEN 'src1' END AS rule, CASE WHEN {_says('license')} THEN 2 WHEN contains('/' || rel, '/src1') THEN 1 ELSE 0 END AS strength FROM e")
def route_rules(spark, sf):
    return route.triage(entries(spark, sf), {"root": ROOT, "rules": RULES}).select("rel", "rule", F.coalesce("strength", F.lit(0)).alias("strength"))


ENTITIES = [
    {"name": "Acme", "ids": ["7"], "match": {"text_contains_any": ["license"]}},
    {"name": "Globex", "match": {"text_contains_any": ["und"]}, "bucket": "Glo"},
    {"name": "Initech", "match": {"path_under": ["src2"]}},
    {"name": "Hooli", "match": {"name_matches": r"^\d*5\.txt$"}},
]


@query(
    f"""WITH {ENTRIES}, g AS (SELECT rel, CASE WHEN doc_id % 7 = 0 THEN 3 WHEN {_says('license')} THEN 2 ELSE 0 END AS a, CASE WHEN {_says('und')} THEN 2 ELSE 0 END AS b, CASE WHEN contains('/' || rel, '/src2') THEN 1 ELSE 0 END AS c, CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS d FROM e),
m AS (SELECT rel, greatest(a, b, c, d) AS top, list_filter([CASE WHEN a = greatest(a, b, c, d) AND a > 0 THEN 'Acme' END, CASE WHEN b = greatest(a, b, c, d) AND b > 0 THEN 'Globex' END, CASE WHEN c = greatest(a, b, c, d) AND c > 0 THEN 'Initech' END, CASE WHEN d = greatest(a, b, c, d) AND d > 0 THEN 'Hooli' END], lambda x: x IS NOT NULL) AS best FROM g)
SELECT rel, CASE WHEN len(best) = 1 THEN replace(best[1], 'Globex', 'Glo') END AS entity, CASE WHEN len(best) > 1 THEN array_to_string(best, ',') ELSE '' END AS rivals FROM m"""
)
def entity_best(spark, sf):
    ids = F.create_map(F.lit("k"), F.array((F.col("doc_id") % 7 + 7).cast("string")))
    e = prepared(entries(spark, sf).withColumn("ids", F.when(F.col("doc_id") % 7 == 0, ids)))
    return route.with_entity(e, ENTITIES).select("rel", "entity", F.array_join("rivals", ",").alias("rivals"))


@query(
    f"""WITH {ENTRIES} SELECT rel, 'long' AS rule, 1 AS strength, 'Long/' || doc_id || '/' AS destination, NULL AS unresolved, NULL AS tags FROM e WHERE size > 5000
UNION ALL SELECT rel, 'und', 2, NULL, NULL, 'en' FROM e WHERE {_says('und')} AND text <> '' UNION ALL SELECT rel, 'dated', 1, NULL, 'doc_year', NULL FROM e WHERE size > 9000"""
)
def shadow_predictions(spark, sf):
    made = route.triage(entries(spark, sf), {"root": ROOT, "rules": RULES}).select("rel", F.explode("shadow").alias("s"))
    return made.select("rel", "s.rule", "s.strength", "s.destination", "s.unresolved", F.array_join("s.tags", ",").alias("tags"))


@query(f"WITH {LEDGER} SELECT path AS rel, 'already settled by hand in pass ' || pass || ': ' || reason AS settled FROM now WHERE provenance = 'human-decision' AND decision IN ('none', 'move', 'rename')")
def settled_guard(spark, sf):
    return route.settled(ledger(spark, sf))


GUARD = {"text_contains_any": ["license", "moron"], "path_under": ["src3", "src4"], "id_kind_present": ["email"], "text_contains_all": ["the"], "rules": [{"id": "big", "size_gt": 30000}, {"all": [{"ext": [".txt"]}, {"size_lt": 60}]}]}


@query(
    f"""WITH {ENTRIES} SELECT doc_id, CASE WHEN {_says('license')} THEN 'text_contains_any: license' WHEN {_says('moron')} THEN 'text_contains_any: moron' WHEN contains('/' || rel, '/src3') THEN 'path_under: src3'
  WHEN contains('/' || rel, '/src4') THEN 'path_under: src4' WHEN {_MAIL} THEN 'id_kind_present: email' WHEN size > 30000 THEN 'big' WHEN size < 60 THEN 'sensitive-rule' END AS hit FROM e"""
)
def sensitive_guard(spark, sf):
    e = entries(spark, sf).withColumn("ids", identifiers.extract_ids(F.col("text")))
    return prepared(e).select("doc_id", sensitive_hit(GUARD).alias("hit"))


@query(f"WITH {ENTRIES} SELECT doc_id, CASE WHEN starts_with(rel, 'src1/fr/') THEN 'src1/fr' WHEN source = 'src1' THEN '/corpus/SRC1' WHEN source = 'src9' THEN 'src9/' END AS inbox FROM e")
def inbox_of(spark, sf):
    box = route.inbox_of(F.concat(F.lit(ROOT + "/"), F.col("rel")), [{"path": "src1/fr"}, {"path": "/corpus/SRC1"}, {"path": "src9/"}], ROOT)
    return entries(spark, sf).select("doc_id", box.alias("inbox"))


@query(f"WITH {ENTRIES} SELECT doc_id FROM e WHERE doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def vision_barrier(spark, sf):
    e = entries(spark, sf).withColumns({"needs_vision": F.col("doc_id") % 3 == 0, "text": F.when(F.col("doc_id") % 2 == 0, " ").otherwise("x"), "decision": F.when(F.col("doc_id") % 5 == 0, "none"), "known_as": F.when(F.col("doc_id") % 7 == 0, "y")})
    return route.unread(e).select("doc_id")


# ---------------------------------------------------------------- plan

_DECIDED = """d AS (SELECT *, doc_id AS ord, CASE doc_id % 8 WHEN 0 THEN 'move' WHEN 1 THEN 'rename' WHEN 2 THEN 'trash' WHEN 3 THEN 'tag' WHEN 4 THEN 'none' WHEN 5 THEN 'burn' WHEN 6 THEN 'unanswered' ELSE 'trash' END AS decision,
  CASE WHEN doc_id % 8 = 0 THEN 'Filed/' WHEN doc_id % 16 = 1 THEN 'Named/' || (doc_id % 5) || '.txt' WHEN doc_id % 32 = 9 THEN '/elsewhere/x' END AS dst FROM e)"""


def decided(spark, sf):
    k = F.col("doc_id")
    names = ("move", "rename", "trash", "tag", "none", "burn", "unanswered", "trash")
    decision = F.element_at(F.array(*(F.lit(x) for x in names)), (k % 8 + 1).cast("int"))
    dst = F.when(k % 8 == 0, "Filed/").when(k % 16 == 1, F.concat(F.lit("Named/"), (k % 5).cast("string"), F.lit(".txt"))).when(k % 32 == 9, "/elsewhere/x")
    none = F.lit(None).cast("string")
    return files(spark, sf).withColumns({"ord": k, "decision": decision, "dst": dst, "keeper": none, "reviewed": none, "why": F.lit("seen"), "desc": none})


def files(spark, sf):
    return entries(spark, sf).withColumn("ids", identifiers.extract_ids(F.col("text")))


@query(
    f"""WITH {ENTRIES}, {_DECIDED}, w AS (SELECT rel, ord, CASE WHEN dst = 'Filed/' THEN dst || doc_id || '.txt' ELSE dst END AS want FROM d WHERE dst IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY want ORDER BY ord) + CASE WHEN want = 'Named/3.txt' THEN 1 ELSE 0 END AS n FROM w)
SELECT rel, CASE n WHEN 1 THEN want WHEN 2 THEN CASE WHEN want = '/elsewhere/x' THEN want || ' (2)' ELSE replace(want, '.txt', ' (2).txt') END END AS final, CASE WHEN n > 2 THEN 'a file is already there, and so is its (2)' END AS why FROM m"""
)
def collision_suffix(spark, sf):
    """Every move; one of the names has a file already."""
    moves = decided(spark, sf).where("dst is not null").select("rel", "dst", "ord")
    there = files(spark, sf).select("rel").unionByName(spark.range(1).select(F.lit("Named/3.txt").alias("rel")))
    return apply.placed(moves, there).select("rel", "final", "why")


TRASH_CONFIG = {"root": ROOT, "sensitive": {"text_contains_any": ["license"], "path_under": ["src1/"], "supersedable": [{"id": "notice", "text_contains_any": ["license"]}]}}


_PROSE = f"pr AS (SELECT doc_id, prose FROM ({TEXT_ORACLES['prose_gate']}))"


@query(
    f"""WITH {ENTRIES}, {_PROSE}, s AS (SELECT e.*, pr.prose, {_says('license')} AS lic, first_value(rel) OVER (PARTITION BY size, md5 ORDER BY rel) AS head, count(*) OVER (PARTITION BY size, md5) AS copies FROM e JOIN pr USING (doc_id)),
k AS (SELECT max(rel) AS newest FROM s WHERE lic)
SELECT rel, CASE WHEN copies > 1 THEN 'applied' WHEN size > 1024 AND NOT prose THEN 'refused' WHEN contains('/' || rel, '/src1') AND NOT lic THEN 'refused' ELSE 'applied' END AS status
FROM s CROSS JOIN k WHERE NOT (copies > 1 AND rel = head) AND rel IS DISTINCT FROM newest"""
)
def trash_guard(spark, sf):
    """Every file against the guard but those that stay: the first copy of each repeated content and the newest license."""
    from pyspark.sql import Window as W

    from ledgerleaf.sources.scratch import kept

    f = files(spark, sf)
    marked = kept(prepared(f).select("rel", "size", "md5", t.says(F.col("text_norm"), F.col("text_glued"), "license").alias("lic")), "licenses")
    last = marked.where("lic").agg(F.max("rel").alias("newest"))
    same = W.partitionBy("size", "md5")
    d = marked.select("rel", "md5", "lic", F.min("rel").over(same).alias("first"), F.count(F.lit(1)).over(same).alias("copies")).join(F.broadcast(last))
    repeated = F.col("copies") > 1
    d = d.where(~(repeated & (F.col("rel") == F.col("first"))) & ~F.col("rel").eqNullSafe(F.col("newest")))
    keeper = F.when(repeated, F.col("first")).when(F.col("lic"), F.col("newest"))
    d = d.select("rel", "md5", F.lit("trash").alias("decision"), keeper.alias("keeper"), F.lit(None).cast("string").alias("reviewed"), F.lit("").alias("why"))
    return apply.trash_guard(d, f, TRASH_CONFIG).select("rel", "status")


@query(f"""WITH {ENTRIES}, g AS (SELECT *, first(rel) OVER (PARTITION BY size, md5 ORDER BY rel) AS keep, row_number() OVER (PARTITION BY size, md5 ORDER BY rel) AS n FROM e)
SELECT rel, keep AS keeper, true AS same FROM g WHERE n > 1 UNION ALL SELECT g.rel, e2.rel, false FROM g JOIN e e2 ON e2.doc_id = 0 WHERE g.n = 1 AND g.doc_id % 9 = 4 AND g.md5 <> e2.md5""")
def keeper_proof(spark, sf):
    from pyspark.sql import Window as W

    f = files(spark, sf)
    w = W.partitionBy("size", "md5").orderBy("rel")
    zero = f.where("doc_id = 0").select(F.col("rel").alias("zero"))
    g = f.withColumns({"first": F.first("rel").over(w), "n": F.row_number().over(w)}).join(F.broadcast(zero))
    d = g.select("rel", "md5", F.when(F.col("n") > 1, "trash").when(F.col("doc_id") % 9 == 4, "tag").alias("decision"), F.when(F.col("n") > 1, F.col("first")).when(F.col("doc_id") % 9 == 4, F.col("zero")).alias("keeper"))
    return apply.keepers(d, f).select("rel", "keeper", "same")


@query(f"""WITH {ENTRIES}, k AS (SELECT rel, {_says('license')} AS a, {_says('the')} AS b, lag(rel) OVER (PARTITION BY source, lang ORDER BY doc_id) AS keep FROM e), j AS (SELECT k.rel, k.keep, k.a, k.b, o.a AS a2, o.b AS b2 FROM k JOIN k o ON k.keep = o.rel)
SELECT rel, keep AS keeper, CASE WHEN a AND a2 THEN 'license' ELSE 'supersedable' END AS family FROM j WHERE (a AND a2) OR (b AND b2)""")
def superseded(spark, sf):
    from pyspark.sql import Window as W

    f = files(spark, sf)
    d = f.select("rel", "md5", F.lit("tag").alias("decision"), F.lag("rel").over(W.partitionBy("source", "lang").orderBy("doc_id")).alias("keeper"))
    return apply.superseded(d, f, [{"id": "license", "text_contains_any": ["license"]}, {"text_contains_any": ["the"]}])


PLAN_CONFIG = {"root": ROOT, "sensitive": {"text_contains_any": ["license"], "path_under": ["src1/"]}, "workspace_rel": "src19"}
_PLAN = f"""{ENTRIES}, {_PROSE}, {_DECIDED}, k AS (SELECT d.*, size > 1024 AND NOT prose AS unread, {_says('license')} AS lic, contains('/' || rel, '/src1') AS protected,
  row_number() OVER (PARTITION BY CASE WHEN dst = 'Filed/' THEN dst || doc_id || '.txt' ELSE dst END ORDER BY ord) AS n FROM d JOIN pr USING (doc_id)),
s AS (SELECT *, CASE WHEN decision = 'unanswered' THEN 'undecided' WHEN decision = 'burn' OR source = 'src19' THEN 'failed' WHEN decision = 'trash' AND (unread OR lic OR protected) THEN 'refused'
  WHEN decision = 'rename' AND (dst IS NULL OR starts_with(dst, '/') OR n > 2) THEN 'failed' ELSE 'applied' END AS st FROM k)"""


def planned(spark, sf):
    return apply.plan(decided(spark, sf), files(spark, sf), PLAN_CONFIG, "2025-01-01-1")


@query(
    f"""WITH {_PLAN} SELECT rel, decision, st AS status,
  CASE WHEN st = 'applied' THEN CASE decision WHEN 'move' THEN 'Filed/' || doc_id || '.txt' WHEN 'rename' THEN CASE n WHEN 1 THEN dst ELSE replace(dst, '.txt', ' (2).txt') END WHEN 'trash' THEN 'bin' ELSE rel END END AS final FROM s"""
)
def apply_plan(spark, sf):
    return planned(spark, sf).select("rel", "decision", "status", "final")


@query(f"WITH {_PLAN} SELECT CASE WHEN st = 'applied' THEN 'applied:' || decision ELSE st END AS kind, count(*) AS n FROM s GROUP BY 1 UNION ALL SELECT 'memory_lines', count(*) FILTER (st IN ('applied', 'refused')) FROM s")
def apply_summary(spark, sf):
    return apply.summary(planned(spark, sf))


@query(
    f"""WITH {_PLAN} SELECT rel AS path, '2025-01-01-1' AS pass, 'refused' AS decision, 'trash refused: ' || CASE WHEN unread THEN '{apply.UNREADABLE}' ELSE 'sensitive (' || CASE WHEN lic THEN 'text_contains_any: license' ELSE 'path_under: src1/' END || ') — kept' END AS reason
FROM s WHERE st = 'refused'"""
)
def refused_rows(spark, sf):
    return apply.refused_rows(planned(spark, sf)).select("path", "pass", "decision", "reason")


@query(
    f"""WITH {LEDGER}, d AS (SELECT DISTINCT path, md5, decision, seq FROM l WHERE pass = (SELECT max(pass) FROM l) AND decision = 'move'),
m AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY md5, path ORDER BY seq DESC) = 1)
SELECT 'gone/' || d.seq AS rel, arg_min(m.path, m.seq) AS final, true AS recorded FROM d JOIN m ON d.md5 = m.md5 AND m.decision = 'move' AND m.pass = (SELECT max(pass) FROM l) JOIN (SELECT path, md5 FROM now) f ON f.path = m.path AND f.md5 = d.md5 GROUP BY d.seq"""
)
def reconcile(spark, sf):
    rows = ledger(spark, sf)
    first = rows.agg(F.max("pass")).first()[0]
    d = rows.where((F.col("pass") == first) & (F.col("decision") == "move")).select(F.concat(F.lit("gone/"), F.col("seq").cast("string")).alias("rel"), "md5", "decision", F.lit(None).cast("string").alias("dst"))
    there = log.latest(rows).select(F.col("path").alias("rel"), "md5")
    return apply.reconcile(d, there, rows, first)


# ---------------------------------------------------------------- learning

_FINAL = f"""{ENTRIES}, s AS (SELECT e.*, l.quality, CASE WHEN l.quality = 1 THEN 'moved' WHEN l.quality = 0 THEN 'refused' END AS result, CASE WHEN l.quality = 1 THEN 'Long/' || CASE WHEN e.doc_id % 3 = 0 THEN e.doc_id ELSE 0 END || '/' || e.doc_id || '.txt' END AS final FROM e LEFT JOIN labels l USING (doc_id))"""


def settled_entries(spark, sf):
    made = route.triage(entries(spark, sf), {"root": ROOT, "rules": RULES})
    k = F.col("doc_id")
    good = F.col("quality") == 1
    final = F.when(good, F.concat(F.lit("Long/"), F.when(k % 3 == 0, k).otherwise(0).cast("string"), F.lit("/"), k.cast("string"), F.lit(".txt")))
    joined = made.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    result = F.when(good, "moved").when(F.col("quality") == 0, "refused")
    return joined.withColumns({"result": result, "final": final, "tags": F.array("lang"), "decision": F.when(k % 11 == 0, "unanswered"), "reason": F.lit(None).cast("string")})


_JUDGED = f"""{_FINAL}, j AS (SELECT 'long' AS rule, coalesce(final, rel) AS final, 'Long/' || doc_id || '/' AS wanted, CASE WHEN result IS NOT NULL THEN starts_with(lower(coalesce(final, rel)), 'long/' || doc_id || '/') END AS ok FROM s WHERE size > 5000
  UNION ALL SELECT 'und', coalesce(final, rel), 'en', CASE WHEN result IS NOT NULL THEN lang = 'en' END FROM s WHERE {_says('und')} AND text <> '' UNION ALL SELECT 'dated', coalesce(final, rel), NULL, NULL FROM s WHERE size > 9000)"""


@query(f"WITH {_JUDGED} SELECT rule, count(*) AS hits, count(*) FILTER (ok) AS agreed, count(*) FILTER (NOT ok) AS disagreed FROM j GROUP BY 1")
def score_shadow(spark, sf):
    return learn.scores(settled_entries(spark, sf))


@query(
    f"""WITH {_JUDGED}, x AS (SELECT rule, final || ' (rule wanted ' || wanted || ')' AS said, row_number() OVER (PARTITION BY rule ORDER BY final, wanted) AS n FROM j WHERE NOT ok)
SELECT rule, count(*) AS n, string_agg(said, ' ; ' ORDER BY n) FILTER (n <= 3) AS examples FROM x GROUP BY 1"""
)
def diverging(spark, sf):
    return learn.diverging(settled_entries(spark, sf)).select("rule", "n", F.array_join("examples", " ; ").alias("examples"))


@query(
    """WITH r AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'shadow' END AS status, s_suppkey % 6 AS cycle, s_suppkey % 13 AS passes, s_suppkey % 8 AS hits, s_suppkey % 4 AS agreed, CASE WHEN s_suppkey % 5 = 0 THEN 1 END AS disagreed FROM supplier),
k AS (SELECT id, cycle, passes + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS passes, hits + CASE WHEN id % 2 = 0 THEN 2 ELSE 0 END AS hits, agreed + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END AS agreed, coalesce(disagreed, 0) AS disagreed FROM r WHERE coalesce(status, 'shadow') = 'shadow')
SELECT id::VARCHAR AS id, passes, hits, agreed, disagreed, passes >= 5 AND hits >= 5 AND disagreed = 0 AS ripe, cycle > 3 OR (passes >= 10 AND hits = 0) AS retire FROM k"""
)
def rule_ripe(spark, sf):
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier")
    rules = s.select(k.cast("string").alias("id"), F.when(k % 3 == 0, "active").when(k % 3 == 1, "shadow").alias("status"), (k % 6).alias("cycle"), (k % 13).alias("passes"), (k % 8).alias("hits"), (k % 4).alias("agreed"), F.when(k % 5 == 0, 1).alias("disagreed"))
    deltas = s.where("s_suppkey % 2 = 0").select(k.cast("string").alias("rule"), F.lit(2).alias("hits"), F.lit(1).alias("agreed"), F.lit(0).alias("disagreed"))
    return learn.report(rules, deltas).drop("cycle")


def moved(spark, sf):
    """Files that move by language and last digit; the moves of a folder share a phrase, a name or an identifier."""
    e = files(spark, sf)
    k = F.col("doc_id")
    memo = (k % 5 == 1) & ~F.col("source").isin("src0", "src3")
    dest = F.when(k % 5 == 0, F.concat(F.lit("Archive/2024 "), "lang")).when(memo, F.concat(F.lit("Second/"), "lang"))
    marked = F.when(k % 5 == 0, F.concat(F.lit("dossier de "), "lang", F.lit(" archive "), "text")).otherwise(F.col("text"))
    ids = F.when(k % 5 == 1, F.create_map(F.lit("no"), F.array(F.concat(F.when(memo, "A").otherwise("C"), "lang"), F.lit("B"))))
    return e.select("doc_id", F.when(k % 5 == 1, F.concat_ws("/", F.lit("in"), "lang", F.concat(F.when(memo, "mémo-").otherwise("note-"), "lang", F.lit("-"), k.cast("string"), F.lit(".md")))).otherwise(F.col("rel")).alias("rel"), F.when(k % 5 == 1, ".md").otherwise(".txt").alias("ext"), marked.alias("text"), ids.alias("ids"), F.when(dest.isNotNull(), "moved").alias("result"), F.concat(dest, F.lit("/"), k.cast("string"), F.lit(".txt")).alias("final"), F.lit(2024).alias("doc_year"))


_MOVED = r"""v AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'Archive/2024 ' || lang WHEN doc_id % 5 = 1 AND source NOT IN ('src0', 'src3') THEN 'Second/' || lang END AS dest,
  CASE WHEN doc_id % 5 = 0 THEN 'dossier de ' || lang || ' archive ' || text ELSE text END AS text, doc_id % 5 = 1 AS memo FROM documents), g AS (SELECT dest, count(*) AS n FROM v WHERE dest IS NOT NULL GROUP BY 1 HAVING count(*) >= 3), vg AS (SELECT v.*, g.n FROM v JOIN g USING (dest))"""


@query(
    rf"""WITH {_MOVED}, w AS (SELECT doc_id, dest, regexp_extract_all({norm_sql('text')}, '[\p{{L}}\p{{M}}\p{{N}}_''’-]+') AS w FROM v),
x AS (SELECT doc_id, dest, unnest(list_distinct(flatten(list_transform(range(2, 6), lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i+n-1], ' ')))))) AS gram FROM w),
c AS (SELECT x.dest, gram, count(*) AS have FROM x JOIN g USING (dest) GROUP BY 1, 2, g.n HAVING count(*) = g.n), u AS (SELECT gram, count(*) AS total FROM x GROUP BY 1)
SELECT dest, gram AS phrase FROM c JOIN u USING (gram) WHERE total = have QUALIFY row_number() OVER (PARTITION BY dest ORDER BY length(gram), gram) = 1"""
)
def mine_phrase(spark, sf):
    return learn.by_phrase(moved(spark, sf))


@query(
    f"""WITH {_MOVED}, i AS (SELECT doc_id, dest, unnest([CASE WHEN dest IS NOT NULL THEN 'A' ELSE 'C' END || lang, 'B']) AS value FROM v WHERE memo), c AS (SELECT i.dest, value, count(*) AS have FROM i JOIN g USING (dest) GROUP BY 1, 2, g.n HAVING count(*) = g.n),
t AS (SELECT value, count(*) AS total FROM i GROUP BY 1) SELECT dest, min(value) AS value FROM c JOIN t USING (value) WHERE total = have GROUP BY 1"""
)
def mine_identifier(spark, sf):
    e = moved(spark, sf)
    return learn.by_identifier(e, learn.moves(e), ledger(spark, sf))


@query(
    f"""WITH {_MOVED}, m AS (SELECT dest, min('memo-' || lang || '-' || doc_id || '.md') AS lo, max('memo-' || lang || '-' || doc_id || '.md') AS hi FROM vg WHERE memo GROUP BY 1)
SELECT dest, lo[1:list_max(list_filter(range(1, length(lo) + 1), lambda i: lo[1:i] = hi[1:i]))] AS prefix FROM m"""
)
def mine_prefix(spark, sf):
    e = moved(spark, sf)
    return learn.by_prefix(e, learn.moves(e))


@query(f"WITH {_MOVED}, d AS (SELECT dest, CASE WHEN starts_with(dest, 'Arch') THEN '2024-' || lower(dest[14:]) ELSE lower(dest[8:]) END AS base FROM g) SELECT dest, CASE WHEN base = 'fr' THEN 'fr-3' ELSE base END AS id FROM d")
def mine_rule_ids(spark, sf):
    e = moved(spark, sf)
    return learn.rule_ids(learn.moves(e).select("dest").distinct(), ["fr", "fr-2", "x"])


@query()
def mine_rules(spark, sf):
    return learn.mined_rules(moved(spark, sf), ledger(spark, sf), "2025-01-01-1", ["fr"])


@query(f"WITH {_FINAL} SELECT rel, CASE WHEN {_says('license')} THEN 'rule license (evidence strength 2)' WHEN contains('/' || rel, '/src1') THEN 'rule src1 matched on the path or filename alone' WHEN trim(text) = '' THEN 'no text to reason on' ELSE 'no rule matched' END AS reason FROM s WHERE result IS NULL OR doc_id % 11 = 0")
def unanswered(spark, sf):
    return learn.unanswered(settled_entries(spark, sf))


@query(f"""WITH {_FINAL} SELECT unnest(['entries', 'unanswered', 'refused', 'answered_withdrawals']) AS kind, unnest([count(*), count(*) FILTER (result IS NULL OR doc_id % 11 = 0), count(*) FILTER (result = 'refused'), 0]) AS n FROM s""")
def learn_report(spark, sf):
    return learn.learn_report(settled_entries(spark, sf))


AUDITED = {"id": "x", "when": {"any": [{"text_contains_any": ["purchase"]}, {"size_gt": 500}]}, "destination": "u1"}


@query(
    f"""WITH {LEDGER}, m AS (SELECT * FROM now WHERE decision NOT IN ('unanswered', 'refused') AND (contains(lower(coalesce(descr, '')), 'purchase') OR size > 500))
SELECT count(*) AS matched, count(*) FILTER (starts_with(path, 'u1/')) AS agreed, count(*) FILTER (NOT starts_with(path, 'u1/')) AS disagreed, count(*) FILTER (path IS NULL) AS unjudged FROM m"""
)
def audit_rule(spark, sf):
    return learn.audit(ledger(spark, sf), AUDITED)


AUDITED_NAMES = {"id": "z", "when": {"size_gt": 500}, "destination": "u{stem}"}
AUDITED_YEARS = {"id": "w", "when": {"size_gt": 500}, "destination": "u{entity}"}


@query(
    f"""WITH {LEDGER}, m AS (SELECT * FROM now WHERE decision NOT IN ('unanswered', 'refused') AND size > 500)
SELECT 'z' AS rule, count(*) AS matched, count(*) FILTER (starts_with(path, 'u' || regexp_extract(path, '/([0-9]+)', 1))) AS agreed, count(*) FILTER (NOT starts_with(path, 'u' || regexp_extract(path, '/([0-9]+)', 1))) AS disagreed, 0 AS unjudged FROM m
UNION ALL SELECT 'w', count(*), 0, 0, count(*) FROM m"""
)
def audit_rule_judged(spark, sf):
    """A rule whose destination each row fills, and one that no row can fill."""
    rows = ledger(spark, sf)
    return learn.audit(rows, AUDITED_NAMES).select(F.lit("z").alias("rule"), "*").unionByName(learn.audit(rows, AUDITED_YEARS).select(F.lit("w").alias("rule"), "*"))


FULL = {"id": "y", "when": {"text_contains_any": ["license"], "path_under": ["src1"], "size_gt": 200}, "destination": "Out/{doc_year}"}


@query(f"WITH {ENTRIES} SELECT doc_id FROM e WHERE contains('/' || rel, '/src1') AND size > 200")
def full_audit_candidates(spark, sf):
    return learn.cheap_candidates(entries(spark, sf), FULL).select("doc_id")


_YEARS = f"list_max(list_filter(list_transform(regexp_extract_all(array_to_string((list_distinct(regexp_extract_all({flat_sql('text')}, '(?i){DATES_SQL}')))[1:5], ' '), '\\b(?:19|20)\\d{{2}}\\b'), lambda y: y::INT), lambda y: y BETWEEN 1900 AND {YEAR + 1}))"
#: Candidates of a full audit; a third of the texts get a date, some of them two.
_FULL = f"""{ENTRIES}, c AS (SELECT * REPLACE (CASE doc_id % 3 WHEN 0 THEN 'Signed 12/03/' || (2000 + doc_id % 20) || CASE WHEN doc_id % 2 = 0 THEN ', due 2024-01-0' || (doc_id % 9 + 1) ELSE '' END || '. ' || text ELSE text END AS text) FROM e
  WHERE contains('/' || rel, '/src1') AND size > 200 ORDER BY rel LIMIT 500)"""


def dated_entries(spark, sf):
    k = F.col("doc_id")
    due = F.when(k % 2 == 0, F.concat(F.lit(", due 2024-01-0"), (k % 9 + 1).cast("string"))).otherwise("")
    signed = F.concat(F.lit("Signed 12/03/"), (k % 20 + 2000).cast("string"), due, F.lit(". "), "text")
    return entries(spark, sf).withColumn("text", F.when(k % 3 == 0, signed).otherwise(F.col("text")))


@query(f"WITH {_FULL} SELECT rel, 2 AS strength, coalesce('Out/' || {_YEARS} || '/', 'unresolved: doc_year') AS destination FROM c WHERE {_says('license')}")
def full_audit_rule(spark, sf):
    return learn.full_audit(dated_entries(spark, sf), FULL, YEAR)


@query(f"WITH {ENTRIES}, c AS (SELECT *, row_number() OVER (ORDER BY rel) AS n FROM e WHERE contains('/' || rel, '/src1') AND size > 200) SELECT count(*) AS candidates, count(*) FILTER (n <= 500) AS audited, count(*) FILTER (n <= 500 AND doc_id % 4 = 0) AS unreadable FROM c")
def full_audit_counts(spark, sf):
    unread = entries(spark, sf).withColumn("text", F.when(F.col("doc_id") % 4 != 0, F.col("text")))
    return learn.full_audit_counts(unread, FULL)


@query(f"""WITH {_FULL}, t AS (SELECT rel, coalesce('Out/' || {_YEARS} || '/', 'unresolved: doc_year') AS destination FROM c WHERE {_says('license')}), n AS (SELECT count(*) AS candidates, least(count(*), 500) AS audited FROM e WHERE contains('/' || rel, '/src1') AND size > 200)
SELECT 'y' AS rule, candidates, audited, 0 AS unreadable, rel AS path, 2 AS strength, destination FROM n, t""")
def full_audit_log(spark, sf):
    """The record of a full audit, as it is read back from the log."""
    from ledgerleaf.sources import ledger_file
    from ledgerleaf.sources.scratch import scratch

    rows = dated_entries(spark, sf)
    kept = ledger_file.write_audit("y", learn.full_audit(rows, FULL, YEAR), learn.full_audit_counts(rows, FULL), scratch(spark, "logs"))
    return kept.select("rule", "candidates", "audited", "unreadable", F.explode("touched").alias("t")).select("rule", "candidates", "audited", "unreadable", "t.*")


@query(
    """WITH a AS (SELECT item_id, unnest(['src1', 'no/where', '/run', 'wiki/state.md', 'a b/c', '~/x/' || item_id]) AS pointer FROM benchmark)
SELECT item_id::VARCHAR AS anchor, pointer FROM a WHERE pointer NOT IN ('/run', 'wiki/state.md', 'a b/c') AND NOT (pointer = 'src1' AND EXISTS (SELECT 1 FROM documents WHERE source = 'src1'))"""
)
def dead_anchors(spark, sf):
    said = F.concat(F.lit("see `src1/`, `no/where`, `/run`, `wiki/state.md`, `a b/c`, `code` and `~/x/"), F.col("item_id").cast("string"), F.lit("`"))
    anchors = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("anchor"), said.alias("body"))
    known = entries(spark, sf).select(F.explode(paths.ancestors(F.col("rel"))).alias("rel")).unionByName(spark.createDataFrame([(".triage/wiki/state.md",)], "rel string"))
    return learn.dead_anchors(anchors, known, ".triage").select("anchor", F.regexp_replace("pointer", "/+$", "").alias("pointer"))


# ---------------------------------------------------------------- compaction


@query(f"WITH {LEDGER}, {_WALK.replace(chr(92) * 2, chr(92))} SELECT w.rel, CASE WHEN now.path IS NULL THEN 'no memory line' ELSE 'decision=' || now.decision END AS why FROM (SELECT rel FROM w UNION ALL SELECT 'u3/x' || s_suppkey FROM supplier) w LEFT JOIN now ON w.rel = now.path WHERE starts_with(w.rel, 'u3/') AND (now.path IS NULL OR now.decision IN ('unanswered', 'refused'))")
def compact_blockers(spark, sf):
    extra = table(spark, sf, "supplier").select(F.concat(F.lit("u3/x"), F.col("s_suppkey").cast("string")).alias("rel"))
    return compact.blockers(walk(spark, sf).select("rel").unionByName(extra), ledger(spark, sf), "u3")


_COMPACT = f"""{LEDGER}, {_WALK.replace(chr(92) * 2, chr(92))}, d AS (SELECT * REPLACE (CASE WHEN starts_with(path, 'u3/') AND decision IN ('unanswered', 'refused') THEN 'none' ELSE decision END AS decision) FROM l),
c AS (SELECT * FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE starts_with(path, 'u3/') AND NOT regexp_matches(path, '/[^/]*1[.]txt$')),
f AS (SELECT count(*) AS count, sum(size)::BIGINT AS total_size, max(mtime) AS max_mtime, md5(string_agg(rel || ':' || md5 || chr(10), '' ORDER BY rel, md5)) AS tree_md5 FROM w WHERE starts_with(rel, 'u3/')),
line AS (SELECT (SELECT triage FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS triage, (SELECT decision FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS decision, (SELECT provenance FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS provenance,
  (SELECT descr FROM c WHERE descr IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS descr, (SELECT reason FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS tags, (SELECT date_doc FROM c GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS date_doc)"""


def all_decided(spark, sf):
    """The ledger in which every file of one folder is decided."""
    open_ = F.col("path").startswith("u3/") & F.col("decision").isin("unanswered", "refused")
    return ledger(spark, sf).withColumn("decision", F.when(open_, "none").otherwise(F.col("decision")))


@query(f"WITH {_COMPACT} SELECT 'dir' AS type, 'u3' AS path, '2025-01-01-compact' AS pass, line.*, 'old' AS reason, f.* FROM line, f")
def compact_dir(spark, sf):
    made = compact.folder_line(walk(spark, sf), all_decided(spark, sf), "u3", "2025-01-01-compact", "old", keep=["*1.txt"])
    return made.withColumn("tags", F.array_join("tags", ",")).withColumnRenamed("desc", "descr")


@query(
    f"""WITH {_COMPACT} SELECT 'file' AS type, path, seq, decision, reason, 1 AS count, NULL AS tree_md5 FROM d WHERE NOT starts_with(path, 'u3/') OR regexp_matches(path, '/[^/]*1[.]txt$')
UNION ALL SELECT 'dir', 'u3', (SELECT max(seq) + 1 FROM l), line.decision, 'old', f.count, f.tree_md5 FROM line, f"""
)
def compact_ledger(spark, sf):
    left = compact.compacted(walk(spark, sf), all_decided(spark, sf), "u3", "2025-01-01-compact", "old", keep=["*1.txt"])
    return left.select(F.coalesce("type", F.lit("file")).alias("type"), "path", "seq", "decision", "reason", F.coalesce("count", F.lit(1)).alias("count"), "tree_md5")


@query("SELECT 'u' || k AS path, CASE WHEN k % 4 = 0 THEN 'touched' WHEN k % 4 = 1 THEN 'diverged' ELSE 'same' END AS state FROM (SELECT DISTINCT user_id % 20 AS k FROM events) UNION ALL SELECT 'away', 'gone'")
def folder_states(spark, sf):
    """Folders as they were recorded, after some files were touched, some changed and one folder went."""
    there, k = walk(spark, sf), F.regexp_extract("rel", r"^u(\d+)/", 1).try_cast("int")
    before = there.where(k.isNotNull()).unionByName(spark.createDataFrame([("away/1.txt", 1, 1, "x", None)], there.select("rel", "size", "mtime", "md5", "inbox").schema))
    lines = collect.folder_fingerprint(before, F.regexp_extract("rel", "^[^/]+", 0)).withColumnRenamed("dir", "path")
    now = there.withColumns({"mtime": F.when(k % 4 < 2, F.col("mtime") + 1).otherwise(F.col("mtime")), "md5": F.when(k % 4 == 1, F.md5("md5")).otherwise(F.col("md5"))})
    return compact.folder_states(now, lines.withColumns({"type": F.lit("dir"), "seq": F.lit(1)}))


# ---------------------------------------------------------------- trees

# What a reader keeps of a text, as in sources/readers.
_CLEAN = r"trim(regexp_replace(regexp_replace(substr(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), 1, 8000), '\n{2,}', chr(10), 'g'), '[ \t\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'), ' ' || chr(10))"
_TREE = f"""tree AS (
  SELECT 'documents/' || source || '/' || doc_id || '.txt' AS rel, '.txt' AS ext, doc_id AS k, coalesce(text, '') AS text FROM documents UNION ALL
  SELECT 'pages/' || page_id || '.html', '.html', page_id, coalesce(html, '') FROM pages), said AS (SELECT rel, ext, k, strlen(text) AS size, md5(text) AS md5, {_CLEAN} AS text FROM tree)"""


def written_tree(spark, sf):
    """Every document and page as a file of its own below the shared folder; the root and rel, ext, k, size, md5 of each."""
    from ledgerleaf.sources.doctree import local_folder, written
    from ledgerleaf.sources.scratch import scratch

    d = table(spark, sf, "documents").select(F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel"), F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    p = table(spark, sf, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("rel"), F.col("page_id").alias("k"), F.coalesce("html", F.lit("")).alias("text"))
    both = d.unionByName(p)
    root = local_folder(scratch(spark, "tree"))
    written(both.select("rel", F.col("text").cast("binary").alias("body"), (F.lit(1_700_000_000) + F.col("k")).alias("mtime")), root)
    return root, both.select("rel", "k", F.octet_length("text").cast("long").alias("size"), F.md5("text").alias("md5"))


@query(f"WITH {_TREE} SELECT rel, ext, size, 1700000000 + k AS mtime, md5, length(text) AS chars, md5(text) AS text_md5 FROM said")
def scan_files(spark, sf):
    """Documents and pages written as files, then scanned with content and digests."""
    from ledgerleaf.sources.doctree import scan

    root, _ = written_tree(spark, sf)
    return scan(spark, [root]).where("kind = 'file'").select("rel", "ext", "size", "mtime", "md5", F.length("text").alias("chars"), F.md5("text").alias("text_md5"))


@query(f"""WITH {_TREE}, r AS (SELECT *, CASE WHEN k % 9 = 0 THEN 'new' WHEN k % 9 = 1 THEN 'open' WHEN k % 9 = 2 THEN 'touched' WHEN k % 9 = 3 THEN 'changed' ELSE 'same' END AS state FROM said)
SELECT rel, CASE WHEN state = 'open' THEN 0 WHEN starts_with(rel, 'pages/') THEN 1 ELSE 2 END AS band, CASE WHEN state = 'changed' THEN md5 END AS md5, md5(text) AS text_md5
FROM r WHERE state IN ('new', 'open', 'changed')""")
def scan_lazy(spark, sf):
    """What a pass selects of that tree beside a ledger in which some files are new, open, touched or changed: listed
    without opening one, digests of touched and changed files only, texts of what is selected."""
    from ledgerleaf.sources import doctree

    root, rows = written_tree(spark, sf)
    k = F.col("k") % 9
    recorded = rows.where(k > 0).select(
        F.col("k").alias("seq"),
        F.col("rel").alias("path"),
        F.when(k == 1, "unanswered").otherwise("none").alias("decision"),
        "size",
        (F.lit(1_700_000_000) + F.col("k") - F.when(k.isin(2, 3), 7).otherwise(0)).alias("mtime"),
        F.when(k == 3, F.md5("md5")).otherwise(F.col("md5")).alias("md5"),
    )
    listed = doctree.listing(spark, [root]).where("kind = 'file'").withColumn("inbox", F.when(F.col("rel").startswith("pages/"), "pages"))
    chosen = collect.lazy_bands(listed, recorded, doctree.digested).where("band is not null")
    return doctree.opened(chosen).select("rel", "band", "md5", F.md5("text").alias("text_md5"))


@query(f"WITH {LEDGER} SELECT 'latest' AS view, path AS key, seq AS size, decision, md5 FROM now UNION ALL SELECT 'content', md5, seq, decision, md5 FROM l QUALIFY row_number() OVER (PARTITION BY md5 ORDER BY seq DESC) = 1")
def ledger_snapshot(spark, sf):
    """A ledger written in three batches, with a snapshot after the second; last lines of its snapshot merged with the
    third. A line's size is its event."""
    from ledgerleaf.sources import ledger_file
    from ledgerleaf.sources.scratch import scratch

    rows, path = ledger(spark, sf).withColumn("size", F.col("seq")), scratch(spark, "ledger")
    ends = rows.agg(F.expr("cast(max(seq) * 0.5 as long)").alias("a"), F.expr("cast(max(seq) * 0.9 as long)").alias("b")).first()
    ledger_file.append(rows.where(F.col("seq") <= ends.a), path)
    ledger_file.append(rows.where((F.col("seq") > ends.a) & (F.col("seq") <= ends.b)), path)
    ledger_file.snapshot(spark, path)
    ledger_file.append(rows.where(F.col("seq") > ends.b), path)
    now = ledger_file.current(spark, path)
    view = lambda name, df, key: df.select(F.lit(name).alias("view"), F.col(key).alias("key"), "size", "decision", "md5")
    return view("latest", log.latest(now), "path").unionByName(view("content", log.by_content(now), "md5"))
