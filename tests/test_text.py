import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerleaf.functions import identifiers, paths, text
from ledgerleaf.sources import readers

CASES = ["", "  a b\n\nc ", "L’été d'AOÛT — «x»", "Straße ŒUVRE æ", "étude", "ﬀ x", "İstanbul", "C o n t r a i n t e s a b c"]


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_norm(spark):
    cases = [c for c in CASES if "ﬀ" not in c] + [None]
    assert column(spark, cases, text.norm) == [None if c is None else text.norm_python(c) for c in cases]
    assert column(spark, CASES, text.norm_exact) == [text.norm_python(c) for c in CASES]


def test_norm_of_single_characters(spark):
    chars = [chr(i) for i in range(0x20, 0x24F)] + [chr(i) for i in range(0x370, 0x400)] + [chr(i) for i in range(0x1E00, 0x1EFF)]
    got = column(spark, ["a" + c + "b" for c in chars], text.norm)
    wrong = [c for c, g in zip(chars, got) if g != text.norm_python("a" + c + "b")]
    # What folds to several characters and is not listed differs; all of it is rare.
    assert all(len(unicodedata.normalize("NFD", c.casefold())) > 1 for c in wrong) and len(wrong) < 12, wrong


def test_prose(spark):
    good = ["Quittance de loyer", "mission " * 30, "Facture /uni00A0 numero total", "C o n t r a i n t e s de la vie", "inscription prescription construction"]
    bad = ["", None, "/UNIC0037/UNIC0035/UNIC0041" * 5, "/12 /33 /29", "ÅÁgkIYIr GgIkZ BxQz", "12 345 67"]
    assert column(spark, good, text.is_prose) == [True] * len(good)
    assert column(spark, bad, text.is_prose) == [False] * len(bad)


def test_says_through_lost_spaces(spark):
    df = spark.createDataFrame([("Relevé d’IdentitéBancaire",)], "v string").withColumn("n", text.norm(F.col("v")))
    assert df.select(text.says(F.col("n"), text.glued(F.col("n")), "relevé d'identité bancaire").alias("o")).first().o


def test_clean_and_flatten(spark):
    assert column(spark, ["a\n\n\nb \t c d\n"], text.clean) == ["a\nb c d"]
    assert column(spark, [" a\n b c "], text.flatten) == ["a b c"]


def test_identifiers(spark):
    config = {"siren": r"\b\d{3}[ .]?\d{3}[ .]?\d{3}\b", "siret": r"\b\d{3}[ .]?\d{3}[ .]?\d{3}[ .]?\d{5}\b"}
    texts = [
        "SIREN 842 931 073 et 842931074, SIRET 531 694 206 00024",
        "BankIdentiferCodeFR76 1234 5678 9000 0246 8130 050 ok",
        "write to billing@acme-example.com, a.b+c@x-y.org.",
        None,
    ]
    got = column(spark, texts, lambda c: identifiers.extract_ids(c, config))
    assert got[0] == {"siren": ["842931073"], "siret": ["53169420600024"]}
    assert got[1] == {"iban": ["FR7612345678900002468130050"]}
    assert got[2]["email"][0] == "billing@acme-example.com"
    assert got[3] == {}


@settings(max_examples=60, deadline=None)
@given(st.text("0123456789", max_size=14))
def test_luhn_value(v):
    total = 0
    for i, c in enumerate(reversed(v)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    assert identifiers.luhn_value(v) == (len(v) >= 2 and total % 10 == 0)


def test_dates(spark):
    got = column(spark, ["le 18/12/1993, 3 août 2021, 2020-01-02 et 07/2022; 2045 Main", "1er mars 2019 1er mars 2019", None], identifiers.extract_dates)
    assert got == [["18/12/1993", "3 août 2021", "2020-01-02", "07/2022"], ["1er mars 2019"], []]
    df = spark.createDataFrame([(["18/12/1993", "07/2022"],), (["01/01/2999"],), ([],)], "d array<string>")
    assert [r[0] for r in df.select(identifiers.doc_year(F.col("d"), 2024)).collect()] == [2022, None, None]


def test_paths(spark):
    names = ["a/b.TXT", "a/.bashrc", "a.b/c", "x/..rc.Gz", "x/y.", "Icon\r"]
    assert column(spark, names, paths.ext_of) == [".txt", "?", "?", ".gz", ".", "?"]
    assert column(spark, names, paths.stem) == ["b", ".bashrc", "c", "..rc", "y", "Icon\r"]
    assert column(spark, ["a/b/c", "c"], paths.dirname) == ["a/b", ""]
    assert column(spark, ["/R/a/B/x", "/r/ab/x"], lambda c: paths.inside(c, F.lit("/r/A"))) == [True, False]


def test_walk_order(spark):
    names = ["b/z.txt", "a.txt", "b/a/q", "b/c.txt", "a/x", "z.txt", "b.txt"]
    df = spark.createDataFrame([(n,) for n in names], "rel string").orderBy(paths.walk_key(F.col("rel")))
    assert [r.rel for r in df.collect()] == ["a.txt", "b.txt", "z.txt", "a/x", "b/c.txt", "b/z.txt", "b/a/q"]


def test_globs():
    import fnmatch
    import re

    for g in ("*/src1*", "a?c", "[!a]x", "[a-c]*", "x.y(z)", "[", "a[]]b"):
        for s in ("/a/src12", "abc", "bx", "ax", "c9", "x.y(z)", "[", "a]b", "aXc"):
            assert bool(re.match(paths.glob_regex(g), s)) == fnmatch.fnmatchcase(s, g), (g, s)


def test_destination(spark):
    df = spark.createDataFrame([("a/f.pdf", 2020, "Acme"), ("a/f.pdf", None, None)], "rel string, y int, e string").withColumn("ext", paths.ext_of(F.col("rel")))
    values = paths.destination_values(F.col("rel"), F.col("ext"), F.col("y"), F.col("e"))
    folder, missing = paths.render_destination("{entity}/{doc_year}/{name}", values)
    assert [tuple(r) for r in df.select(folder, missing).collect()] == [("Acme/2020/f.pdf/", None), (None, "entity")]
    _, missing = paths.render_destination("{}/x", values)
    assert df.select(missing).first()[0] == "positional"


def test_readers(tmp_path):
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", "<w:p>Bonjour</w:p><w:p>monde</w:p>")
    assert readers.zipped(buffer.getvalue(), readers.ZIPPED[".docx"]) == "Bonjour monde"
    assert readers.zipped(buffer.getvalue(), readers.ZIPPED[".odt"]) is None
    assert readers.zipped(b"broken", readers.ZIPPED[".docx"]) is None
    assert readers.looks_textual("texte élémentaire".encode()) and not readers.looks_textual(b"a\0b") and not readers.looks_textual(b"")
    assert readers.read(b"x" * 9000, ".txt") == "x" * 8000
    assert readers.read(b"\0\1", ".bin") == "" and readers.read(b"", ".pdf", with_pdf=False) is None


def test_prose_of_long_words(spark):
    """One word of a million letters, letters set apart, capitals sprayed over words, a dotted capital."""
    cases = {"ba" * 500_000: True, "bcdfgh" * 200_000: False, " ".join("bonjour" * 50_000): True, "bOnJoUr sAlUtAtIoNs": False, "BONJOUR LES AMIS": True, "cdfİfgh": True, "cdfxİ bcd fgh": False}
    rows = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert rows.where(~text.is_prose(F.col("t")).eqNullSafe(F.col("want"))).selectExpr("left(t, 40)").collect() == []


def test_norm_is_the_definition_for_every_character(spark):
    every = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" a|".join(every[i : i + 400]) for i in range(0, len(every), 400)] + ["ﬁn ŉ Œuvre İstanbul 한국어 ᾳ", "é 가́"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.norm(F.col("t")).alias("n")).collect()
    assert [r.t for r in rows if r.n != text.norm_python(r.t)] == []


def test_prose_by_arrays_is_that_by_expressions(spark):
    """Every known character's kind; made texts with odd ones, spaced letters, five others in a row and marks."""
    known = [chr(c) for c in (*range(1, text.KNOWN_UP_TO + 1), *range(text.MARKS_FROM, text.MARKS_TO + 1))]
    c = F.col("v")
    said = [c.rlike(f"(?U)^{text._LETTER}$"), c.rlike(f"^{text._VOWEL}$"), c.rlike(r"(?U)^\p{Lu}$"), c != F.upper(c)]
    kinds = column(spark, known, lambda _: sum((x.cast("int") * k for x, k in zip(said[1:], (2, 4, 8))), said[0].cast("int")))
    assert kinds == [int(text._kinds()[ord(x)]) for x in known]
    rng = random.Random(1)
    alphabets = ("aeiouybc", "aebcdfgBCD ", "aebcdfghkABEZéÀßİ'’- _0 1\t\n/—cid:µª", "aeb bc日́ﬁ 한ǅ")
    made = ["".join(rng.choice(a) for _ in range(rng.randint(0, 40))) for a in alphabets for _ in range(1500)]
    made += [" ".join(rng.choice("aebcdE1é") * rng.choice((1, 1, 1, 3)) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    assert column(spark, [*made, None], text.is_prose) == column(spark, [*made, None], text._by_expressions)


def test_prose_is_judged_many_texts_at_a_time(spark):
    """The expressions, which take ten times as long, are left to texts with characters that arrays do not tell."""
    flat = ["Quittance de loyer, payée à l’heure", "ÅÁgkIYIr GgIkZ BxQz", "", "日本語 text", "word " * 300_000]
    prose, told = text.prose_of(flat)
    assert told.tolist() == [True, True, True, False, True]
    assert prose[told].tolist() == [True, False, False, True]
