"""Scalar functions on text, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, needles, paths
from ledgerleaf.functions import text as t
from ledgerleaf.operators import tags
from ledgerleaf.plans.conditions import compiled, prepared
from ledgerleaf.sources import readers

from .standins import DATED, DATES_SQL, ENTRIES, YEAR, dated, entries, flat_sql, norm_sql, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS norm_md5, length({norm_sql('text')})::BIGINT AS n FROM documents")
def norm_text(spark, sf):
    d = _docs(spark, sf).withColumn("n", t.norm(F.col("text")))
    return d.select("doc_id", F.md5("n").alias("norm_md5"), F.length("n").cast("long").alias("n"))


@query(f"SELECT doc_id, md5({flat_sql('text')}) AS flat_md5 FROM documents")
def flatten_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.flatten(F.col("text"))).alias("flat_md5"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\n{2,}', chr(10), 'g'), '[\t\r\f\v ]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS clean_md5 FROM documents")
def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.clean(F.col("text"))).alias("clean_md5"))


@query(f"WITH {ENTRIES} SELECT doc_id, contains(tn, 'under this license') OR contains(tg, 'underthislicense') AS says FROM e")
def text_says(spark, sf):
    n = _docs(spark, sf).withColumn("n", t.norm(F.col("text")))
    return n.select("doc_id", t.says(F.col("n"), t.glued(F.col("n")), "Under  this Licénse").alias("says"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '([a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])', '\1 \2', 'g')) AS deglued_md5 FROM documents")
def deglue(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(t.deglue(F.col("text"))).alias("deglued_md5"))


@query(
    r"""WITH w AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{M}\p{N}_''’-]+') AS w FROM benchmark),
g AS (SELECT item_id, unnest(list_distinct(flatten(list_transform(range(2, 6), lambda n: list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i:i+n-1], ' ')))))) AS g FROM w)
SELECT item_id, count(*) AS n_grams, md5(string_agg(g, '|' ORDER BY g)) AS grams_md5 FROM g GROUP BY 1"""
)
def ngrams(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("g", t.ngrams(F.col("text"))).where(F.size("g") > 0)
    return b.select("item_id", F.size("g").cast("long").alias("n_grams"), F.md5(F.array_join(F.sort_array("g"), "|")).alias("grams_md5"))


#: Letters that the data has and the vowels of the prose test lack.
_CONSONANTS = "bcdfghjklmnpqrstvwxzßñçáíóú"


@query(
    rf"""WITH f AS (SELECT doc_id, {flat_sql('text')} AS t FROM documents),
k AS (SELECT doc_id, t, string_split(t, ' ') AS p FROM f),
s AS (SELECT doc_id, CASE WHEN len(p) >= 8 AND len(list_filter(p, lambda x: length(x) = 1)) > 0.5 * len(p) THEN replace(t, ' ', '') ELSE t END AS t FROM k),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[\p{{L}}\p{{M}}]{{3,}}') AS w FROM s)
SELECT doc_id, t <> '' AND len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(lower(x), '[{t.VOWELS}]') AND NOT regexp_matches(lower(x), '[{_CONSONANTS}]{{5,}}')
  AND NOT (x <> upper(x) AND length(x) > 1 AND length(regexp_replace(x[2:], '\P{{Lu}}', '', 'g')) > 0.4 * (length(x) - 1)))) >= 0.6 * len(w) AS prose FROM w"""
)
def prose_gate(spark, sf):
    return _docs(spark, sf).select("doc_id", t.is_prose(F.col("text")).alias("prose"))


@query(
    """WITH d AS (SELECT c_custkey, (c_custkey * 7919 + 12345)::VARCHAR AS v FROM customer),
x AS (SELECT c_custkey, v, list_reverse(string_split(v, '')) AS r FROM d)
SELECT c_custkey, length(v) >= 2 AND list_sum(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN i % 2 = 1 THEN r[i]::INT WHEN r[i]::INT > 4 THEN r[i]::INT * 2 - 9 ELSE r[i]::INT * 2 END)) % 10 = 0 AS ok FROM x"""
)
def luhn(spark, sf):
    v = (F.col("c_custkey") * 7919 + 12345).cast("string")
    return table(spark, sf, "customer").select("c_custkey", identifiers.luhn_ok(v).alias("ok"))


@query(
    """WITH d AS (SELECT c_custkey, 'FR' || lpad((c_custkey % 100)::VARCHAR, 2, '0') || ' 1234 5678 9000 0' || lpad(c_custkey::VARCHAR, 6, '0') || ' 050' AS v FROM customer),
x AS (SELECT c_custkey, v, upper(replace(v, ' ', '')) AS s FROM d)
SELECT c_custkey, list_reduce(list_prepend(0, list_transform(string_split(s[5:] || s[1:4], ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)),
  lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c) % 97 END) = 1 AS ok FROM x"""
)
def iban(spark, sf):
    key = F.col("c_custkey")
    v = F.concat(F.lit("FR"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit(" 1234 5678 9000 0"), F.lpad(key.cast("string"), 6, "0"), F.lit(" 050"))
    return table(spark, sf, "customer").select("c_custkey", identifiers.iban_ok(v).alias("ok"))


@query(
    r"""WITH v AS (SELECT s_suppkey, unnest([substr(lpad(s_suppkey::VARCHAR, 9, '1'), 1, 3) || '.' || substr(lpad(s_suppkey::VARCHAR, 9, '1'), 4, 3) || ' ' || substr(lpad(s_suppkey::VARCHAR, 9, '1'), 7, 3), s_name || ' @ a.b']) AS v FROM supplier)
SELECT s_suppkey, v, CASE WHEN regexp_full_match(translate(v, ' .', ''), '\d+') THEN translate(v, ' .', '') ELSE regexp_replace(v, '\s+', '', 'g') END AS normal FROM v"""
)
def normalise_id(spark, sf):
    n = F.lpad(F.col("s_suppkey").cast("string"), 9, "1")
    dotted = F.concat(F.substring(n, 1, 3), F.lit("."), F.substring(n, 4, 3), F.lit(" "), F.substring(n, 7, 3))
    v = table(spark, sf, "supplier").select("s_suppkey", F.explode(F.array(dotted, F.concat("s_name", F.lit(" @ a.b")))).alias("v"))
    return v.select("s_suppkey", "v", identifiers.normalise_id(F.col("v")).alias("normal"))


_EMAIL = identifiers.PATTERNS["email"]


@query()
def extract_ids(spark, sf):
    ids = identifiers.extract_ids(F.col("text"), {"siren": {"pattern": r"\b\d{3}[ ]?\d{3}[ ]?\d{3}\b"}})
    d = _docs(spark, sf).select("doc_id", ids.alias("ids"))
    return d.where(F.map_contains_key("ids", F.lit("email"))).select("doc_id", F.array_join(F.element_at("ids", "email"), ",").alias("emails"))


def _uniq(x: str) -> str:
    """First occurrences, in order."""
    return f"list_transform(list_filter(list_zip({x}, range(1, len({x}) + 1)), lambda z: list_position({x}, z[1]) = z[2]), lambda z: z[1])"


_A = f"regexp_extract_all(t, '{_EMAIL}')"
_B = rf"regexp_extract_all(regexp_replace(t, '([a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])', '\1 \2', 'g'), '{_EMAIL}')"
ORACLES["extract_ids"] = f"""WITH f AS (SELECT doc_id, {flat_sql('text')} AS t FROM documents),
p AS (SELECT doc_id, ({_uniq(_A)})[1:5] AS a, {_uniq(_B)} AS b FROM f)
SELECT doc_id, array_to_string((a || list_filter(b, lambda x: NOT list_contains(a, x)))[1:5], ',') AS emails FROM p WHERE len(a) + len(b) > 0"""

_D = rf"regexp_extract_all(text, '(?i){DATES_SQL}')"


@query(f"WITH {DATED} SELECT o_orderkey, array_to_string(({_uniq(_D)})[1:5], '|') AS dates FROM o")
def extract_dates(spark, sf):
    return dated(spark, sf).select("o_orderkey", F.array_join(identifiers.extract_dates(F.col("text")), "|").alias("dates"))


@query(rf"WITH {DATED} SELECT o_orderkey, list_max(list_filter(list_transform(regexp_extract_all(array_to_string({_D}, ' '), '\b(?:19|20)\d{{2}}\b'), lambda y: y::INT), lambda y: y BETWEEN 1900 AND {YEAR + 1})) AS year FROM o")
def doc_year(spark, sf):
    return dated(spark, sf).select("o_orderkey", identifiers.doc_year(identifiers.extract_dates(F.col("text")), YEAR).alias("year"))


@query(rf"WITH {DATED} SELECT o_orderkey, rel, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Orders/' || (1990 + o_orderkey % 30) || '/pdf/' || o_orderkey || '/' END AS folder, CASE WHEN o_orderkey % 5 = 0 THEN 'doc_year' END AS missing FROM o")
def render_destination(spark, sf):
    year = F.when(F.col("o_orderkey") % 5 != 0, (F.lit(1990) + F.col("o_orderkey") % 30).cast("int"))
    values = paths.destination_values(F.col("rel"), F.col("ext"), year, F.lit(None).cast("string"))
    folder, missing = paths.render_destination("Orders/{doc_year}/{ext}/{stem}//", values)
    return dated(spark, sf).select("o_orderkey", "rel", folder.alias("folder"), missing.alias("missing"))


_PATH = "'/home/u/' || CASE p_partkey % 3 WHEN 0 THEN 'corpus/' WHEN 1 THEN 'mail/' ELSE '../../srv/' END || p_brand || '/' || p_name"


@query(
    f"""WITH p AS (SELECT p_partkey, replace({_PATH}, '/home/u/../../', '/') AS path FROM part)
SELECT p_partkey, path, CASE WHEN starts_with(path, '/home/u/corpus/') THEN path[16:] WHEN starts_with(path, '/home/u/') THEN '~/' || path[9:] ELSE path END AS rel FROM p"""
)
def rel_key(spark, sf):
    top = F.when(F.col("p_partkey") % 3 == 0, "/home/u/corpus/").when(F.col("p_partkey") % 3 == 1, "/home/u/mail/").otherwise("/srv/")
    p = table(spark, sf, "part").select("p_partkey", F.concat(top, "p_brand", F.lit("/"), "p_name").alias("path"))
    return p.select("p_partkey", "path", paths.rel_key(F.col("path"), "/home/u/corpus", "/home/u").alias("rel"))


_NAMES = "unnest(['a/' || p_name || '.TXT', 'a.b/' || p_partkey, '.bash' || p_partkey, '..' || p_partkey || '.Tar.GZ', 'x' || p_partkey || '.']) AS rel"


@query(
    rf"""WITH p AS (SELECT p_partkey, {_NAMES} FROM part), n AS (SELECT *, regexp_extract(rel, '[^/]*$') AS name FROM p)
SELECT rel, CASE WHEN regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1) = '' THEN '?' ELSE lower(regexp_extract(name, '^\.*[^.].*?(\.[^.]*)$', 1)) END AS ext FROM n"""
)
def ext_of(spark, sf):
    key = F.col("p_partkey").cast("string")
    names = F.array(F.concat(F.lit("a/"), "p_name", F.lit(".TXT")), F.concat(F.lit("a.b/"), key), F.concat(F.lit(".bash"), key), F.concat(F.lit(".."), key, F.lit(".Tar.GZ")), F.concat(F.lit("x"), key, F.lit(".")))
    return table(spark, sf, "part").select(F.explode(names).alias("rel")).select("rel", paths.ext_of(F.col("rel")).alias("ext"))


@query(f"WITH {ENTRIES} SELECT doc_id, md5 FROM e")
def content_md5(spark, sf):
    return entries(spark, sf).select("doc_id", "md5")


@query("SELECT p_partkey, length(p_name) < 25 OR (regexp_matches(lower(p_name), '^(image |photo |video |vidéo |fichier |document |capture |screenshot )') AND length(p_name) < 60) AS generic FROM part")
def generic_desc(spark, sf):
    return table(spark, sf, "part").select("p_partkey", tags.generic(F.col("p_name")).alias("generic"))


@query("SELECT doc_id, array_to_string(list_filter([source, lang, 'kept'], lambda x: x NOT IN ('kept', 'fr', 'en', 'src1')), ',') AS off FROM documents")
def off_taxonomy_tags(spark, sf):
    made = tags.off_taxonomy(F.array("source", "lang", F.lit("kept")), ["kept", "fr", "en", "src1"])
    return _docs(spark, sf).select("doc_id", F.array_join(made, ",").alias("off"))


@query(
    """WITH x AS (SELECT event_id, [event_type, 'Facture'] AS a, [upper(event_type), 'view', 'facture', 'View', 'new' || (event_id % 3)] AS b FROM events),
f AS (SELECT event_id, a, list_filter(b, lambda x: NOT list_contains(list_transform(a, lambda y: lower(y)), lower(x))) AS b FROM x)
SELECT event_id, array_to_string(a || list_transform(list_filter(list_zip(b, range(1, len(b) + 1)), lambda z: list_position(list_transform(b, lambda y: lower(y)), lower(z[1])) = z[2]), lambda z: z[1]), ',') AS tags FROM f"""
)
def tag_merge(spark, sf):
    e = table(spark, sf, "events")
    added = F.array(F.upper("event_type"), F.lit("view"), F.lit("facture"), F.lit("View"), F.concat(F.lit("new"), (F.col("event_id") % 3).cast("string")))
    return e.select("event_id", F.array_join(tags.merged(F.array("event_type", F.lit("Facture")), added), ",").alias("tags"))


@query("SELECT event_id, list_has_all([event_type, 'a', 'click'], ['click', CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'view' END]) AS ok FROM events")
def tags_subset(spark, sf):
    some = F.array(F.lit("click"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("view"))
    return table(spark, sf, "events").select("event_id", tags.contained(some, F.array("event_type", F.lit("a"), F.lit("click"))).alias("ok"))


@query(
    rf"""WITH x AS (SELECT p_partkey, unnest([p_name, p_brand || ' Étude', p_name || ' extra words']) AS d, p_brand || '/' || p_name || '.pdf' AS path FROM part),
k AS (SELECT p_partkey, d, list_distinct(list_filter(regexp_split_to_array({norm_sql('d')}, '[^a-z0-9]+'), lambda x: length(x) > 2)) AS a,
  list_filter(regexp_split_to_array({norm_sql("regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '')")}, '[^a-z0-9]+'), lambda x: length(x) > 2) AS b FROM x)
SELECT p_partkey, d, len(a) > 0 AND len(b) > 0 AND list_has_all(b, a) AS repeats FROM k"""
)
def desc_paraphrase(spark, sf):
    from ledgerleaf.operators.ledger import paraphrases_name

    said = F.array(F.col("p_name"), F.concat("p_brand", F.lit(" Étude")), F.concat("p_name", F.lit(" extra words")))
    p = table(spark, sf, "part").select("p_partkey", F.explode(said).alias("d"), F.concat("p_brand", F.lit("/"), "p_name", F.lit(".pdf")).alias("path"))
    return p.select("p_partkey", "d", paraphrases_name(F.col("d"), F.col("path")).alias("repeats"))


_EXTS = [".pdf", ".docx", ".rtf", ".txt", ".css", ".bin", ".jpg"]


@query(
    """WITH x AS (SELECT p_partkey, ['.pdf', '.docx', '.rtf', '.txt', '.css', '.bin', '.jpg'][p_partkey % 7 + 1] AS ext FROM part)
SELECT p_partkey, ext, CASE ext WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'zip' WHEN '.rtf' THEN 'rtf' WHEN '.txt' THEN 'text' WHEN '.css' THEN 'text' ELSE 'sniff' END AS collects,
  CASE ext WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'zip' WHEN '.rtf' THEN 'rtf' WHEN '.txt' THEN 'text' ELSE 'none' END AS audits FROM x"""
)
def reader_dispatch(spark, sf):
    ext = F.element_at(F.array(*(F.lit(x) for x in _EXTS)), (F.col("p_partkey") % 7 + 1).cast("int"))

    def reader(mode: str):
        known = {".pdf", ".rtf", *readers.ZIPPED, *readers.TEXT}
        kinds = F.create_map(*(F.lit(v) for x in sorted(known) for v in (x, readers.reader_of(x, mode))))
        return F.coalesce(F.element_at(kinds, F.col("ext")), F.lit(readers.reader_of("", mode)))

    return table(spark, sf, "part").select("p_partkey", ext.alias("ext")).select("p_partkey", "ext", reader("collect").alias("collects"), reader("audit").alias("audits"))


def condition(name: str, when: dict, sql: str, view: str = "e"):
    """A query of one condition over the entries."""

    def run(spark, sf, when=when):
        return prepared(entries(spark, sf)).select("doc_id", compiled(when).match.alias("hit"))

    QUERIES[name] = run
    ORACLES[name] = f"WITH {ENTRIES} SELECT doc_id, {sql} AS hit FROM {view}"


def _says(x: str) -> str:
    return f"(contains(tn, '{x}') OR contains(tg, '{x.replace(' ', '')}'))"


condition("text_contains_any", {"text_contains_any": ["license", "Idiot thé", "und die"]}, " OR ".join(map(_says, ("license", "idiot the", "und die"))))
condition("text_contains_all", {"text_contains_all": ["the", "and for"]}, " AND ".join(map(_says, ("the", "and for"))))
condition("text_matches", {"text_matches": r"\bthe [a-z]{3,5} and\b"}, r"regexp_matches(tn, '\bthe [a-z]{3,5} and\b', 'i')")
condition("has_text", {"has_text": True}, "text IS NOT NULL AND text <> ''")
condition("ext_in", {"ext_in": [".PDF", ".TXT"], "size_gt": 100}, "size > 100")
condition("size_between", {"size_gt": 500, "size_lt": 5000}, "size > 500 AND size < 5000")
condition("name_matches", {"name_matches": r"^1\d*7\.TXT$"}, r"regexp_matches(doc_id || '.txt', '^1\d*7\.txt$')")
condition("path_under", {"path_under": ["src1", "/src2/en", "*/fr/9"]}, "regexp_matches('/' || rel, '^.*/src1.*$') OR starts_with('/' || rel, '/src2/en') OR contains('/' || rel, '/fr/9')")
condition(
    "cond_tree",
    {"any": [{"text_contains_any": ["license"], "not": {"path_under": ["src1"]}}, {"all": [{"size_gt": 8000}, {"not": {}}, {"ext": [".txt"]}]}, {"nonsense": 1}], "not": {"any": []}},
    f"({_says('license')} AND NOT contains('/' || rel, '/src1')) OR size > 8000",
)


@query(
    rf"""WITH {ENTRIES}, m AS (SELECT doc_id, regexp_matches({flat_sql('text')}, '{_EMAIL}') AS mail, contains('/' || rel, '/src1') AS p, {_says('license')} AS w FROM e)
SELECT doc_id, CASE WHEN mail THEN 3 WHEN w THEN 2 WHEN p THEN 1 ELSE 0 END AS strength FROM m"""
)
def match_strength(spark, sf):
    when = {"any": [{"path_under": ["src1"]}, {"text_contains_any": ["license"]}, {"id_kind_present": ["email"]}]}
    e = entries(spark, sf).withColumn("ids", identifiers.extract_ids(F.col("text")))
    return prepared(e).select("doc_id", compiled(when).strength.alias("strength"))


@query(rf"WITH f AS (SELECT doc_id, regexp_extract_all({flat_sql('text')}, '{_EMAIL}') AS m FROM documents) SELECT doc_id, len(m) > 0 AS hit FROM f")
def id_kind_present(spark, sf):
    e = entries(spark, sf).withColumn("ids", identifiers.extract_ids(F.col("text")))
    return prepared(e).select("doc_id", compiled({"id_kind_present": ["iban", "email"]}).match.alias("hit"))


@query("SELECT c_custkey, (c_custkey % 7 = 0 OR c_custkey % 11 = 0) AS hit FROM customer")
def ids_any(spark, sf):
    key = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.concat("c_mktsegment", F.lit("/"), key.cast("string")).alias("rel"), F.create_map(F.lit("k"), F.array(F.concat((key % 7).cast("string"), F.lit(".7")), F.concat(F.lit("m "), (key % 11).cast("string")))).alias("ids"))
    return prepared(c).select("c_custkey", compiled({"ids_any": ["07", "m.0"]}).match.alias("hit"))


@query(f"WITH {DATED} SELECT o_orderkey, coalesce(o_orderkey % 4 <> 0 AND (1990 + o_orderkey % 30) IN (1995, 2001), false) AS hit FROM o")
def doc_year_in(spark, sf):
    d = dated(spark, sf).withColumn("doc_year", F.when(F.col("o_orderkey") % 4 != 0, (F.lit(1990) + F.col("o_orderkey") % 30).cast("int")))
    return prepared(d).select("o_orderkey", compiled({"doc_year_in": ["1995", 2001]}).match.alias("hit"))


@query(f"WITH {ENTRIES} SELECT doc_id FROM e WHERE NOT (regexp_matches('/' || rel, '^.*/src1/.*$') OR regexp_matches('/' || rel, '^/src2/[de]./.*$') OR regexp_matches('/' || rel, '^.*/[^1-5]..[.]txt$'))")
def exclude_globs(spark, sf):
    return entries(spark, sf).where(~paths.excluded(F.col("rel"), ["src1/*", "/src2/[de]?/*", "[!1-5]??.txt"])).select("doc_id")


@query(f"WITH {ENTRIES} SELECT doc_id, starts_with(rel, 'src3/') AS a, starts_with(rel, 'src1/fr/') AS b, starts_with(rel, 'src1/') AS c FROM e")
def path_inside(spark, sf):
    r = F.col("rel")
    inside = lambda x: paths.inside(r, F.lit(x))
    return entries(spark, sf).select("doc_id", inside("SRC3").alias("a"), inside("src1/fr/").alias("b"), inside("/src1").alias("c"))


@query(f"WITH {ENTRIES} SELECT doc_id FROM e WHERE source NOT IN ('src0', 'src7')")
def self_guard(spark, sf):
    from ledgerleaf.operators.collect import not_own

    return not_own(entries(spark, sf), ["src0", "SRC7"]).select("doc_id")


# Syllables of which the many phrases are made, every pair of them one.
SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu ai".split()
_PAIRS = f"pairs AS (SELECT a.i * 32 + b.i AS place, a.s || b.s AS n FROM (SELECT unnest({SYLLABLES}) AS s, unnest(range(0, 32)) AS i) a, (SELECT unnest({SYLLABLES}) AS s, unnest(range(0, 32)) AS i) b)"


@query(f"WITH {ENTRIES}, {_PAIRS}, d AS (SELECT n, min(place) AS place FROM pairs GROUP BY n), h AS (SELECT rel, n, place FROM e, d WHERE contains(tn, n) OR contains(tg, n)) SELECT e.rel, count(h.n) AS phrases, coalesce(min(h.place // 32), -1)::BIGINT AS first_rule FROM e LEFT JOIN h USING (rel) GROUP BY 1")
def many_needles(spark, sf):
    """1,024 phrases in 32 rules: how many of them each text has, and the first rule that matches it."""
    rules = [{"text_contains_any": [a + b for b in SYLLABLES]} for a in SYLLABLES]
    with needles.looked_up(rules):
        e = prepared(entries(spark, sf))
        first = F.coalesce(*(F.when(compiled(r).match, F.lit(k)) for k, r in enumerate(rules)))
        return e.select("rel", F.size(needles.FOUND).cast("long").alias("phrases"), F.coalesce(first.cast("long"), F.lit(-1).cast("long")).alias("first_rule"))
