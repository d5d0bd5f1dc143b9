"""Conditions against an interpreter, a golden corpus on disk, ledger files, plans, learning, a stream of passes."""

import json
import os
import random
import re
from fnmatch import fnmatchcase

import pytest
from pyspark.sql import functions as F

from ledgerleaf.functions import text
from ledgerleaf.operators import apply, collect, compact, learn, route
from ledgerleaf.operators import ledger as log
from ledgerleaf.plans import conditions, config
from ledgerleaf.sources import ledger_file
from ledgerleaf.sources.doctree import scan
from ledgerleaf.streaming import passes

ENTRY = "rel string, text string, ext string, size long, ids map<string,array<string>>, doc_year int"


# ---------------------------------------------------------------- conditions

ROWS = [
    ("src1/a.txt", "Quittance de loyer, août", ".txt", 900, {"siren": ["842931073"]}, 2024),
    ("src10/Facture 7.PDF", "facture n° 12", ".pdf", 12_000, {}, None),
    ("x/é.md", "", ".md", 0, None, 2020),
    ("x/y.bin", None, ".bin", None, None, None),
]


def facts(row):
    rel, body, ext, size, ids, year = row
    n = text.norm_python(body or "")
    values = {v.replace(" ", "").replace(".", "") for vs in (ids or {}).values() for v in vs}
    says = lambda x: text.norm_python(x) in n or text.norm_python(x).replace(" ", "") in n.replace(" ", "")
    under = lambda p: fnmatchcase(text.norm_python("/" + rel), text.norm_python((p if p.startswith(("/", "*")) else "*/" + p).rstrip("/") + "*"))
    return {
        "text_contains_any": lambda v: any(map(says, v)),
        "text_contains_all": lambda v: all(map(says, v)),
        "text_matches": lambda v: bool(re.search(v, n, re.I)),
        "ids_any": lambda v: bool(values & {x.replace(" ", "") for x in v}),
        "id_kind_present": lambda v: any(k in (ids or {}) for k in v),
        "has_text": lambda v: bool(body) is v,
        "doc_year_in": lambda v: year in v,
        "ext": lambda v: ext in v,
        "name_matches": lambda v: bool(re.search(v, text.norm_python(rel.rsplit("/", 1)[-1]), re.I)),
        "path_under": lambda v: any(map(under, v)),
        "size_gt": lambda v: (size or 0) > v,
        "size_lt": lambda v: (size or 0) < v,
    }


LEAVES = [
    ("text_contains_any", ["LOYER", "x y"]),
    ("text_contains_all", ["facture", "12"]),
    ("text_matches", r"ao[uû]t|n° \d"),
    ("ids_any", ["842 931 073"]),
    ("id_kind_present", ["iban", "siren"]),
    ("has_text", True),
    ("has_text", False),
    ("doc_year_in", [2020, 2021]),
    ("ext", [".pdf", ".md"]),
    ("name_matches", r"^facture \d"),
    ("path_under", ["src1"]),
    ("path_under", ["/x/"]),
    ("size_gt", 899),
    ("size_lt", 900),
    ("unknown", 1),
]


def tree(rng, depth):
    made = {}
    for _ in range(rng.randint(0, 2)):
        key, value = rng.choice(LEAVES)
        made[key] = value
    if depth and rng.random() < 0.7:
        kind = rng.choice(("all", "any", "not"))
        made[kind] = tree(rng, depth - 1) if kind == "not" else [tree(rng, depth - 1) for _ in range(rng.randint(0, 2))]
    return made


def strength(when, f):
    if not conditions.interpreted(when, f):
        return 0
    best = 1
    for k, v in when.items():
        if k in ("all", "any"):
            best = max([best, *(strength(c, f) for c in v)])
        elif k != "not":
            best = max(best, conditions.grade(k))
    return best


def test_conditions_against_interpreter(spark):
    rng = random.Random(9)
    trees = [tree(rng, 3) for _ in range(80)] + [{}, None, {"not": {}}, {"all": []}, {"any": []}, {"not": {"unknown": 1}}]
    df = conditions.prepared(spark.createDataFrame(ROWS, ENTRY))
    for at in range(0, len(trees), 30):
        some = [conditions.compiled(t) for t in trees[at : at + 30]]
        got = df.select("rel", *(F.struct(m.match, m.strength).alias(f"t{i}") for i, m in enumerate(some))).collect()
        for r in got:
            f = facts(next(x for x in ROWS if x[0] == r.rel))
            for i, t in enumerate(trees[at : at + 30]):
                assert tuple(r[f"t{i}"]) == (conditions.interpreted(t, f), strength(t, f)), (r.rel, t)


def test_cheap_part_never_loses_a_match(spark):
    rng = random.Random(10)
    df = conditions.prepared(spark.createDataFrame(ROWS, ENTRY))
    some = [conditions.compiled(tree(rng, 3)) for _ in range(40)]
    assert df.where(" or ".join("false" for _ in some) or "false").count() == 0
    for r in df.select(*((m.match & ~m.cheap).alias(f"t{i}") for i, m in enumerate(some))).collect():
        assert not any(r)


# ---------------------------------------------------------------- golden corpus

CONFIG = {
    "root": "",
    "inboxes": ["Inbox"],
    "identifiers": {"siren": r"\b\d{3}[ .]?\d{3}[ .]?\d{3}\b", "siret": r"\b\d{3}[ .]?\d{3}[ .]?\d{3}[ .]?\d{5}\b"},
    "sensitive": {"text_contains_any": ["passeport", "relevé d'identité bancaire", "bulletin de paie", "résultats d'analyses"], "id_kind_present": ["iban"]},
    "entities": [
        {"name": "Acme", "match": {"text_contains_any": ["acme industries"]}},
        {"name": "Globex", "match": {"text_contains_any": ["globex services"]}},
    ],
    "rules": [
        {"id": "rent-receipt", "status": "active", "when": {"text_contains_any": ["quittance de loyer"]}, "destination": "Archive/Loyer/{doc_year}"},
        {"id": "invoice", "status": "active", "when": {"text_contains_any": ["facture", "note d'honoraires"]}, "destination": "Archive/Factures"},
    ],
}
PROSE = "Madame, Monsieur, veuillez trouver ci-joint le document demandé pour votre dossier personnel."
GOLDEN = {
    "Docs/Loyer/quittance-01.txt": ("Quittance de loyer 03/2025 " + PROSE, "route"),
    "Docs/Loyer/quittance-sans-date.txt": ("Quittance de loyer " + PROSE, "propose"),
    "Docs/Loyer/quittance-accents.txt": ("QUITTANCE DE LOYER février 12 mars 2025", "route"),
    "Docs/Factures/facture-001.txt": ("Facture Acme SIREN 842 931 073 " + PROSE, "route"),
    "Perso/passeport.txt": ("Passeport de la République", "propose"),
    "Perso/rib.txt": ("Relevé d’IdentitéBancaire FR76 1234 5678 9000 0246 8130 050", "propose"),
    "Docs/notes.txt": (PROSE, "residual"),
    "Traps/Casse-Test.txt": ("un premier fichier assez long", "residual"),
    "Traps/casse-test.txt": ("un second fichier assez long", "residual"),
    "Traps/attestation.txt": ("attestation sur honneur", "propose"),
    "Docs/attestation-copie.txt": ("attestation sur honneur", "propose"),
    "Traps/Dossier d’archive/note.txt": ("Note d’honoraires du cabinet", "route"),
    "Traps/vide.txt": ("", "residual"),
    "Traps/vide2.txt": ("", "residual"),
    "Traps/Icon\r": ("", "residual"),
    "Traps/.cache": ("texte sans règle", "residual"),
    "Traps/archive.zip": (b"PK\3\4 broken", "residual"),
    "Inbox/quittance-avril.txt": ("Quittance de loyer 04/2025", "propose"),
    "Inbox/liste.txt": ("pain lait beurre", "propose"),
    "Docs/contrat-cadre.txt": ("Contrat entre Acme Industries et Globex Services", "propose"),
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    for rel, (body, _) in GOLDEN.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    os.symlink(root / "nowhere", root / "Traps/lien-mort.pdf")
    os.symlink(root / "Docs/notes.txt", root / "Traps/lien.txt")
    (root / ".triage").mkdir()
    (root / ".triage/ledger.jsonl").write_text("{}")
    return root


def entries_of(spark, root):
    found = scan(spark, [str(root)], guarded=str(root / ".triage"))
    files = found.where("kind = 'file'").withColumn("error", F.lit(None).cast("string"))
    e = collect.evidence(files, 2025, config.normal({**CONFIG, "root": str(root)})["identifiers"])
    return found, e.join(collect.duplicates(files.where("link_to is null")), "rel", "left")


def test_golden_corpus(spark, corpus):
    found, e = entries_of(spark, corpus)
    ignored = {r.rel: r.why for r in found.where("kind = 'ignored'").collect()}
    assert ignored == {"Traps/lien-mort.pdf": "dangling symlink"}
    got = {r.rel: r for r in route.triage(e, config.normal({**CONFIG, "root": str(corpus)})).collect()}
    assert set(got) == {*GOLDEN, "Traps/lien.txt"}
    assert {rel: r.triage for rel, r in got.items() if rel in GOLDEN} == {rel: lane for rel, (_, lane) in GOLDEN.items()}
    assert got["Docs/Loyer/quittance-sans-date.txt"].why == "destination variable unresolved: doc_year"
    assert got["Docs/Loyer/quittance-01.txt"].destination == "Archive/Loyer/2025/"
    assert got["Docs/contrat-cadre.txt"].guards == ["entity-tie"] and got["Inbox/quittance-avril.txt"].guards == ["inbox"]
    assert got["Perso/rib.txt"].why.startswith("sensitive (text_contains_any: relevé")
    assert got["Traps/attestation.txt"].duplicate_of == ["Docs/attestation-copie.txt"] and got["Traps/vide.txt"].duplicate_of is None
    assert got["Traps/archive.zip"].opaque == "container" and "pointer" in got["Traps/lien.txt"].why
    lanes = {r.triage: r.n for r in route.lane_counts(route.triage(e, config.normal({**CONFIG, "root": str(corpus)}))).collect()}
    assert sum(lanes.values()) == len(got) and lanes["skip"] == lanes["withdrawn"] == 0


def test_audit_walk_differs(spark, corpus):
    found = scan(spark, [str(corpus)], audit=True, exclude="perso|*.zip")
    names = {r.rel for r in found.where("kind = 'file'").collect()}
    assert "Traps/.cache" not in names and "Perso/rib.txt" not in names and "Traps/archive.zip" not in names and "Traps/lien-mort.pdf" not in names
    assert "Docs/notes.txt" in names and "Traps/lien.txt" in names  # a live link is a candidate


def test_unreadable_root_is_named(spark, tmp_path):
    found = scan(spark, [str(tmp_path / "absent")]).collect()
    assert [(r.kind, r.why) for r in found] == [("ignored", "No such file or directory")]


def test_roots_fold():
    c = config.normal({"root": "/r", "inboxes": ["in", {"path": "/other/box"}, "/other/box/deep"]})
    assert config.walk_roots(c) == ["/r", "/other/box"]
    with pytest.raises(ValueError):
        config.normal({})
    assert config.inert_rules({"rules": [{"id": "a"}, {"id": "b", "status": "off"}]}) == ["b"]


# ---------------------------------------------------------------- ledger

LINES = [
    {"path": "a/x.txt", "pass": "2025-01-01-1", "triage": "route", "decision": "move", "size": 5, "mtime": 9, "md5": "m1", "provenance": "pass", "desc": "Un café"},
    None,
    "oops {",
    {"path": "a/y.txt", "level": "propose", "decision": "none", "stat": {"size": 7, "mtime": 8}, "md5": "m2", "provenance": "migrated"},
    {"path": "a/x.txt", "pass": "2025-01-02-1", "triage": "propose", "decision": "none", "size": 6, "mtime": 10, "md5": "m3", "provenance": "human-decision", "reason": "mine\nreally"},
    {"path": "b/z.txt", "pass": "2025-01-02-1", "decision": "unanswered", "md5": "m3"},
    {"path": "b/w.txt", "pass": "2025-01-02-2", "decision": "refused", "md5": None},
    {"type": "dir", "path": "c", "pass": "2025-01-02-compact", "decision": "move", "count": 3},
    {"path": "~/in/q.txt", "decision": "tag", "tags": ["a"], "ids": {"k": ["1"]}},
]


@pytest.fixture(scope="module")
def ledger(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("ledger") / "ledger.jsonl"
    p.write_text("\n".join("" if x is None else x if isinstance(x, str) else json.dumps(x) for x in LINES) + "\n")
    return ledger_file.load(spark, str(p))


def test_ledger_file(spark, ledger):
    rows = ledger.orderBy("seq").collect()
    assert len(rows) == 7 and [r.path for r in rows][:2] == ["a/x.txt", "a/y.txt"]
    assert (rows[1].triage, rows[1].size, rows[1].mtime) == ("propose", 7, 8)
    now = {r.path: r for r in log.latest(ledger).collect()}
    assert set(now) == {"a/x.txt", "a/y.txt", "b/z.txt", "b/w.txt", "~/in/q.txt"} and now["a/x.txt"].decision == "none"
    content = {r.md5: r.path for r in log.by_content(ledger).collect()}
    assert content == {"m1": "a/x.txt", "m2": "a/y.txt", "m3": "b/z.txt"}  # m1 stays although its path has other bytes now
    assert log.next_pass(ledger, "2025-01-02").first()[0] == "2025-01-02-4"
    assert [r.path for r in log.show(ledger, "m3").collect()] == ["b/z.txt"]
    assert [r.path for r in log.show(ledger, "c").collect()] == ["c"] and [r.path for r in log.show(ledger, "x.txt").collect()] == ["a/x.txt"]
    assert log.show(ledger, "nothing").count() == 0
    settled = {r.rel: r.settled for r in route.settled(ledger).collect()}
    assert settled == {"a/x.txt": "already settled by hand in pass 2025-01-02-1: mine really"}
    stats = {(r.kind, r.value): r.n for r in log.stats(ledger).collect()}
    assert stats[("lines", None)] == 7 and stats[("distinct_files", None)] == 5 and stats[("decision", "none")] == 2


def test_candidates(spark, ledger):
    rows = [
        ("a/x.txt", 6, 10, "zz", None),  # as recorded: seen
        ("a/y.txt", 7, 99, "m2", None),  # touched, same bytes: seen
        ("b/z.txt", 1, 1, "q", None),  # open: first
        ("b/w.txt", 1, 1, None, "in"),  # refused: first
        ("n/new.txt", 1, 1, "n", None),
        ("in/new.txt", 1, 1, "n", "in"),
        ("~/in/q.txt", 1, 1, None, None),  # both digests unknown: seen
    ]
    files = spark.createDataFrame(rows, "rel string, size long, mtime long, md5 string, inbox string")
    got = collect.batch(collect.candidates(files, ledger), 10).collect()
    assert [(r.rel, r.band) for r in got] == [("b/w.txt", 0), ("b/z.txt", 0), ("in/new.txt", 1), ("n/new.txt", 2)]
    twins = {r.rel: r.duplicate_of for r in collect.duplicates(files).collect()}
    assert twins == {"n/new.txt": ["in/new.txt"], "in/new.txt": ["n/new.txt"]}
    assert {r.rel: (r.twin, r.copies) for r in collect.first_twin(files).collect()} == {"n/new.txt": ("in/new.txt", 2), "in/new.txt": ("n/new.txt", 2)}


def test_append_and_entries(spark, ledger, tmp_path):
    rows = ledger.where("path = 'a/x.txt'").orderBy("seq").limit(1).drop("seq").withColumn("path", F.lit("new"))
    more = log.appended(ledger, rows, ["path"])
    assert more.first().seq > ledger.agg(F.max("seq")).first()[0]
    assert ledger_file.append(more, str(tmp_path / "out")) == 1
    assert ledger_file.load(spark, str(tmp_path / "out")).first().path == "new"
    for data in ([{"rel": "a", "n": 1}, {"rel": "b"}], {"entries": [{"rel": "a", "n": 1}, {"rel": "b"}]}):
        p = tmp_path / f"w{isinstance(data, dict)}.json"
        p.write_text(json.dumps(data, indent=1))
        assert sorted((r.rel, r.n) for r in ledger_file.load_entries(spark, str(p), "rel string, n int").collect()) == [("a", 1), ("b", None)]


def test_last_line_wins_across_appends(spark, tmp_path):
    """One line, then a larger batch, then one line: what is written last holds, whatever the sizes of the files."""
    path = tmp_path / "ledger"
    schema = "path string, reason string, seq long"
    ledger_file.append(spark.createDataFrame([("a", "old", 0), ("b", "old", 1)], schema).coalesce(1), str(path))
    big = [("x%d" % k, "pad " * 50, k) for k in range(2000)] + [("a", "new", 5000), ("a", "newer", 5001), ("a", "middle", 2500)]
    ledger_file.append(spark.createDataFrame(big, schema).repartition(5), str(path))
    last = lambda: {r.path: r.reason for r in log.latest(ledger_file.load(spark, str(path))).where("path in ('a', 'b')").collect()}
    assert last() == {"a": "newer", "b": "old"}
    ledger_file.append(spark.createDataFrame([("b", "last", 0)], schema), str(path))
    assert last() == {"a": "newer", "b": "last"}
    # A foreign file comes before the batches; foreign files follow their age.
    for name, age, reason in (("z.jsonl", 100, "oldest"), ("a.jsonl", 200, "older")):
        (path / name).write_text(json.dumps({"path": "f", "reason": reason}) + "\n" + json.dumps({"path": "b", "reason": reason}) + "\n")
        os.utime(path / name, (age, age))
    got = {r.path: r.reason for r in log.latest(ledger_file.load(spark, str(path))).where("path in ('b', 'f')").collect()}
    assert got == {"f": "older", "b": "last"}
    assert not [p for p in path.iterdir() if p.name.startswith(".pending")]


def test_working_table_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "w")
    ledger_file.write_entries(spark.createDataFrame([("a", 1), ("b", 2)], "rel string, n int"), path)
    for _ in range(3):  # from what it replaces
        now = ledger_file.load_entries(spark, path, "rel string, n int")
        ledger_file.write_entries(now.withColumn("n", F.col("n") + 1), path)
    assert sorted((r.rel, r.n) for r in ledger_file.load_entries(spark, path, "rel string, n int").collect()) == [("a", 4), ("b", 5)]
    assert len([p for p in (tmp_path / "w").iterdir() if p.name.startswith("version-")]) == 2


# ---------------------------------------------------------------- plan

FILES = "rel string, size long, md5 string, text string, ext string, ids map<string,array<string>>"
DECIDED = "rel string, decision string, dst string, keeper string, reviewed string, why string, desc string, md5 string, ord int"
GUARDED = {"root": "/r", "sensitive": {"text_contains_any": ["passeport"], "supersedable": [{"id": "copy", "text_contains_any": ["attestation"]}]}}


def test_order_of_the_plan(spark):
    """General failures come before the guard, the guard before what a decision needs; inboxes are sources."""
    files = [(".triage/x.txt", 5, "a", "passeport"), ("~/in/p.txt", 5, "b", "passeport"), ("~/else/p.txt", 5, "c", "x"), ("ok.txt", 5, "d", "fine words")]
    decided = [(".triage/x.txt", "trash", "a", {}), ("~/in/p.txt", "trash", "b", {}), ("~/else/p.txt", "tag", "c", {}), ("ok.txt", "tag", "d", {}), ("gone.txt", "trash", "e", {})]
    got = plan_of(spark, files, decided, {**GUARDED, "inboxes": [{"path": "~/in"}]})
    assert {k: v.status for k, v in got.items()} == {".triage/x.txt": "failed", "~/in/p.txt": "refused", "~/else/p.txt": "failed", "ok.txt": "applied", "gone.txt": "failed"}
    assert got["~/else/p.txt"].why == apply.OUTSIDE and got[".triage/x.txt"].why == apply.OWN and got["gone.txt"].why == "not found"


def test_resumed_plan(spark):
    """Rows with a result are done; a gesture that the interrupted run recorded is not done again."""
    f = spark.createDataFrame([("F/a.txt", 5, "a", "x", ".txt", None), ("b.txt", 5, "b", "x", ".txt", None)], FILES)
    d = spark.createDataFrame([("a.txt", "move", "F/", None, None, "w", None, "a", 0, None), ("b.txt", "tag", None, None, None, "w", None, "b", 1, "tagged"), ("c.txt", "tag", None, None, None, "w", None, None, 2, None)], DECIDED + ", result string")
    ledger = spark.createDataFrame([(0, "F/a.txt", "p", "move", "a")], "seq long, path string, pass string, decision string, md5 string")
    got = {r.rel: (r.status, r.kind, r.final) for r in apply.plan(d, f, GUARDED, "p", ledger, resume=True).collect()}
    assert got == {"a.txt": ("applied", "reconcile", "F/a.txt"), "b.txt": ("done", None, None), "c.txt": ("failed", None, None)}
    plain = {r.rel: r.status for r in apply.plan(d, f, GUARDED, "p").collect()}
    assert plain == {"a.txt": "failed", "b.txt": "applied", "c.txt": "failed"}


def plan_of(spark, files, decided, cfg=GUARDED):
    f = spark.createDataFrame([(r, s, m, t, ".txt", None) for r, s, m, t in files], FILES)
    d = spark.createDataFrame([(r, a, o.get("dst"), o.get("keeper"), o.get("reviewed"), "w", o.get("desc"), m, i) for i, (r, a, m, o) in enumerate(decided)], DECIDED)
    return {r.rel: r for r in apply.plan(d, f, cfg, "p").collect()}


def test_trash_ladder(spark):
    p = "Mon passeport est valable pour tous les voyages"
    files = [("s1", 10, "A", p), ("s2", 10, "A", p), ("s3", 10, "B", p), ("s4", 10, "A", p), ("big", 9000, "C", "/12 /33"), ("seen", 9000, "D", "/12"), ("small", 10, "E", ""), ("ok", 10, "F", "simple note de travail"), ("o1", 10, "G", p + " attestation"), ("o2", 10, "H", p + " attestation 2")]
    decided = [
        ("s1", "trash", "A", {"keeper": "s2"}),  # same bytes stay
        ("s3", "trash", "B", {"keeper": "s2"}),  # other bytes, another family
        ("s4", "trash", "A", {"keeper": "s4"}),  # not its own keeper
        ("big", "trash", "C", {}),
        ("seen", "trash", "D", {"reviewed": "vision"}),
        ("small", "trash", "E", {}),
        ("ok", "trash", "F", {}),
        ("o1", "trash", "G", {"keeper": "o2"}),
    ]
    got = plan_of(spark, files, decided)
    assert {r: x.status for r, x in got.items()} == {"s1": "applied", "s3": "refused", "s4": "refused", "big": "refused", "seen": "applied", "small": "applied", "ok": "applied", "o1": "applied"}
    both = plan_of(spark, files, [("s1", "trash", "A", {"keeper": "s2"}), ("s2", "trash", "A", {"keeper": "s1"})])
    assert {x.status for x in both.values()} == {"refused"}  # each other's keeper, both going
    gone = plan_of(spark, files, [("s1", "trash", "A", {"keeper": "absent"})])
    assert gone["s1"].status == "refused"
    free = plan_of(spark, files, decided, {"root": "/r"})
    assert {x.status for x in free.values()} == {"refused"} and "config declares no" in free["ok"].why


def test_moves(spark):
    files = [(r, 10, r, "texte") for r in ("a.txt", "b/a.txt", "c/a.txt", "d/a.txt", "in/a.txt", "in/a (2).txt", "f")]
    decided = [
        ("a.txt", "move", "1", {"dst": "out/"}),
        ("b/a.txt", "move", "2", {"dst": "out/"}),
        ("c/a.txt", "move", "3", {"dst": "out/"}),
        ("d/a.txt", "rename", "4", {"dst": "d/a.txt"}),
        ("f", "move", "5", {"dst": "in/a.txt"}),
        ("in/a.txt", "move", "6", {}),
        ("missing", "none", "7", {}),
        ("in/a (2).txt", "none", "8", {"desc": "a (2)"}),
    ]
    got = plan_of(spark, files, decided)
    assert {r: (x.status, x.final) for r, x in got.items()} == {
        "a.txt": ("applied", "out/a.txt"),
        "b/a.txt": ("applied", "out/a (2).txt"),
        "c/a.txt": ("failed", None),
        "d/a.txt": ("applied", "d/a.txt"),
        "f": ("failed", None),
        "in/a.txt": ("failed", None),
        "missing": ("failed", None),
        "in/a (2).txt": ("applied", "in/a (2).txt"),
    }


# ---------------------------------------------------------------- learning

MOVED = "rel string, ext string, text string, ids map<string,array<string>>, doc_year int, result string, final string"


def mined(spark, rows, existing=()):
    empty = spark.createDataFrame([], "seq long, path string, ids map<string,array<string>>")
    e = spark.createDataFrame(rows, MOVED)
    return [(r.id, r.form, json.loads(r.condition), r.destination) for r in learn.mined_rules(e, empty, "p", list(existing)).collect()]


def move(i, name, ext, body, ids=None, year=None, dest="Out/Bills 2024", src="in"):
    return (f"{src}/{name}", ext, body, ids, year, "moved", f"{dest}/{i}{ext}")


def other(i, name, ext, body, ids=None, src="in"):
    return (f"{src}/{name}", ext, body, ids, None, None, None)


def test_five_forms(spark):
    one = [move(i, f"{i}.csv", ".csv", None, year=2024) for i in range(3)] + [other(9, "9.txt", ".txt", None)]
    assert mined(spark, one, ["bills-2024"]) == [("bills-2024-2", 1, {"ext": [".csv"], "path_under": ["in"]}, "Out/Bills {doc_year}")]
    two = [move(i, f"Relevé-{i}.csv", ".csv", None) for i in range(3)] + [other(9, "z.csv", ".csv", None)]
    assert mined(spark, two) == [("bills-2024", 2, {"name_matches": r"^releve\-"}, "Out/Bills 2024")]
    three = [move(i, f"{i}.csv", ".csv", f"alpha beta {i} gamma delta") for i in range(3)] + [other(9, "z.csv", ".csv", "alpha beta")]
    assert mined(spark, three) == [("bills-2024", 3, {"text_contains_any": ["gamma delta"]}, "Out/Bills 2024")]
    four = [move(i, f"{i}.csv", ".csv", None, {"k": ["7 7", "8"]}) for i in range(3)] + [other(9, "z.csv", ".csv", None, {"k": ["8"]})]
    assert mined(spark, four) == [("bills-2024", 4, {"ids_any": ["77"]}, "Out/Bills 2024")]
    five = [move(i, f"{i}.csv", ".csv", "alpha beta") for i in range(3)] + [other(8, "z.csv", ".csv", "x y"), other(9, "z.txt", ".txt", "alpha beta")]
    assert mined(spark, five) == [("bills-2024", 5, {"ext": [".csv"], "text_contains_any": ["alpha beta"]}, "Out/Bills 2024")]
    assert mined(spark, five + [other(7, "q.csv", ".csv", "alpha beta")]) == []
    assert mined(spark, one[:2]) == []  # two moves make no pattern


def test_reconcile_and_blockers(spark, ledger):
    files = spark.createDataFrame([("out/q.txt", "m9")], "rel string, md5 string")
    d = spark.createDataFrame([("gone.txt", "move", "out/q.txt", "m9"), ("lost.txt", "move", "out/r.txt", "m8"), ("bin.txt", "trash", None, "m3")], "rel string, decision string, dst string, md5 string")
    assert [(r.rel, r.final, r.recorded) for r in apply.reconcile(d, files, ledger, "2025-01-02-1").collect()] == [("gone.txt", "out/q.txt", False)]
    there = spark.createDataFrame([("b/z.txt",), ("b/w.txt",), ("b/new",), ("b/.DS_Store",), ("a/x.txt",)], "rel string")
    assert {r.rel: r.why for r in compact.blockers(there, ledger, "b").collect()} == {"b/z.txt": "decision=unanswered", "b/w.txt": "decision=refused", "b/new": "no memory line"}
    left = {r.path for r in compact.remaining(ledger, "a", ["y.*"]).collect()}
    assert left == {"a/y.txt", "b/z.txt", "b/w.txt", "c", "~/in/q.txt"}


def test_compaction(spark, ledger):
    there = spark.createDataFrame([("a/x.txt", 3, 5, "q"), ("a/y.txt", 4, 9, None), ("b/z.txt", 1, 1, "m3"), ("a/.DS_Store", 1, 99, "f")], "rel string, size long, mtime long, md5 string")
    with pytest.raises(ValueError, match="1 undecided files in b: b/z.txt: decision=unanswered"):
        compact.compacted(there, ledger, "b", "p", "why")
    with pytest.raises(ValueError, match="no line in a"):
        compact.compacted(there, ledger, "a", "p", "why", keep=["*.txt"])
    once = compact.compacted(there, ledger, "a/", "p", "why", tags=["t"], date_doc="2024-01-02")
    line = once.where("path = 'a'").collect()
    assert len(line) == 1 and (line[0].type, line[0]["count"], line[0].total_size, line[0].max_mtime, line[0].tags, line[0].date_doc) == ("dir", 2, 7, 9, ["t"], "2024-01-02")
    assert line[0].seq > ledger.agg(F.max("seq")).first()[0] and once.where("path like 'a/%'").count() == 0
    states = lambda files: {r.path: r.state for r in compact.folder_states(files, once.where("path = 'a'")).collect()}
    assert states(there) == {"a": "same"} and states(there.where("rel = 'b/z.txt'")) == {"a": "gone"}
    assert states(there.withColumn("mtime", F.col("mtime") + 1)) == {"a": "touched"}
    assert states(there.withColumns({"mtime": F.col("mtime") + 1, "md5": F.lit("new")})) == {"a": "diverged"}


def test_logs(spark, tmp_path):
    bench, logs = tmp_path / "bench", tmp_path / "logs"
    for i, name in enumerate(["2025-01-01-1", "2025-01-01-1-2", "2025-01-01-1-3"]):
        bench.mkdir()
        (bench / "entries.json").write_text(str(i))
        assert ledger_file.archive(spark, str(bench), str(logs), "2025-01-01-1") == str(logs / name)
        assert (logs / name / "entries.json").read_text() == str(i) and not bench.exists()
    with pytest.raises(FileNotFoundError):
        ledger_file.archive(spark, str(bench), str(logs), "2025-01-01-1")
    none = spark.createDataFrame([], "rel string, strength int, destination string")
    counts = spark.createDataFrame([(0, 0, 0)], "candidates long, audited long, unreadable long")
    assert [tuple(r) for r in ledger_file.write_audit("r", none, counts, str(logs)).collect()] == [("r", 0, 0, 0, [])]


def test_scan_deals_evenly(spark, tmp_path):
    """More entries than parts, nested folders, a long text: every file once, texts as before."""
    from ledgerleaf.sources import doctree, readers

    for i in range(20):
        for j in range(20):
            d = tmp_path / f"d{i}" / f"e{j}"
            d.mkdir(parents=True)
            (d / "f.txt").write_text(f"{i} {j}")
    (tmp_path / "long.txt").write_text("é\r\n" * 50_000, newline="")
    (tmp_path / "d0" / ".triage").mkdir()
    (tmp_path / "d0" / ".triage" / "own.txt").write_text("own")
    found = scan(spark, [str(tmp_path)], guarded=str(tmp_path / "d0" / ".triage"), exclude="d1/*").cache()
    names = [r.rel for r in found.where("kind = 'file'").collect()]
    assert sorted(names) == sorted([f"d{i}/e{j}/f.txt" for i in range(20) for j in range(20) if i != 1] + ["long.txt"])
    assert found.rdd.getNumPartitions() == doctree.PARTS
    assert found.where("rel = 'long.txt'").first().text == readers.clean("é\n" * (readers.CHARS // 2))


def test_barrier(spark):
    rows = [("a", True, " ", None, None), ("b", True, "lu", None, None), ("c", False, "", None, None)]
    df = spark.createDataFrame(rows, "rel string, needs_vision boolean, text string, decision string, known_as string")
    with pytest.raises(ValueError, match="unread: a$"):
        route.checked(df)
    assert route.checked(df.where("rel <> 'a'")).count() == 2


# ---------------------------------------------------------------- stream


def test_stream_of_passes(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "ledger"
    schema = "rel string, text string, ext string, size long, md5 string"
    spark.createDataFrame([("a.txt", "une facture", ".txt", 10, "1"), ("b.txt", "rien", ".txt", 9, "2")], schema).coalesce(1).write.json(str(source / "1"))
    cfg = {"root": "/r", "rules": [{"id": "f", "status": "active", "when": {"text_contains_any": ["facture"]}, "destination": "F"}]}
    read = lambda: ledger_file.load(spark, str(out)) if out.exists() else None
    write = lambda df: ledger_file.append(df, str(out))

    def run():
        stream = spark.readStream.schema(schema).json(str(source / "*"))
        passes.start(stream, cfg, read, write, str(tmp_path / "cp"), "2025-01-01").awaitTermination()

    run()
    assert sorted((r.path, r.triage) for r in read().collect()) == [("a.txt", "route"), ("b.txt", "residual")]
    spark.createDataFrame([("c.txt", "x", ".txt", 1, "3")], schema).coalesce(1).write.json(str(source / "2"))
    run()
    assert sorted(r["pass"] for r in read().collect()) == ["2025-01-01-1", "2025-01-01-1", "2025-01-01-2"]
    again = spark.createDataFrame([("c.txt", "x", ".txt", 1, "3")], schema)
    assert passes.lines(again, cfg, read(), "2025-01-01-2").count() == 0
