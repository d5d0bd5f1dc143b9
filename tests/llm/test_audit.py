"""The filter audit against its definition, order by order."""

import random
import re
from itertools import permutations

import pytest

from ledgerleaf.llm import filter_audit

DOC = "doc_id long, text string, lang string, part int, mask int, n long, words string, sha string"
LABEL = "doc_id long, quality int, toxic int, n int"
COUNTED = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def by_definition(docs, labels):
    """{(part, order, step): counts}: every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        same = [j for j, other, _ in docs if (other or "") == text and j is not None]
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": bool(same) and (i is None or i > min(same)),
        }
        rows.append((lang or "", fails, i in good, i in toxic))
    found = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_in_all = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[1][f]]
                failing = [r for r in mine if r[1][f]]
                left = [r for r in left if not r[1][f]]
                removed_in_all[f] += len(gone)
                alone = sum(sum(r[1].values()) == 1 for r in failing)
                found[part, order, step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), counts in found.items():
            if p == part:
                counts.append(removed_in_all[order[step - 1]])
    return found


def frames(spark, docs, labels):
    rows = [(i, t, lang, 1, 2, 3, "w", "s") for i, t, lang in docs]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame([(*x, 1) for x in labels], LABEL)


def test_orders_by_definition(spark):
    rng = random.Random(4)
    docs = []
    for i in range(240):
        words = [rng.choice(("Ab", "CDE", "x#", "é", "word%d" % rng.randint(0, 400), "😀")) for _ in range(rng.choice((0, 3, 99, 100, 150)))]
        if rng.random() < 0.5:
            words = ["w%d" % rng.randint(0, 10**6) for _ in words]
        docs.append((i, rng.choice((" ", "\n\t", "\x0b")).join(words), rng.choice(("en", "fr", None, ""))))
    docs += [(300 + i, docs[rng.randrange(240)][1], rng.choice(("en", "fr", "xx"))) for i in range(80)]
    docs += [(500, None, "en"), (501, "", None), (501, "a", "en"), (501, "a", "en"), (None, "a", "en"), (None, "only null ids", "en"), (None, "only null ids", "fr"), (502, "Very long " * 30_000, "en"), (3, docs[0][1], "fr")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 400, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9_999, 1, 1)]
    got = filter_audit.audit(*frames(spark, docs, labels)).collect()
    want = by_definition(docs, labels)
    assert len(got) == len(want) == 120 * 5 * 4
    for r in got:
        assert [r[c] for c in (*COUNTED, "shapley")] == want[r.part, r.filter_order, r.step], r


@pytest.mark.parametrize("parts", [1, 7])
def test_empty_tables_and_dealing(spark, parts):
    docs, labels = frames(spark, [], [])
    assert filter_audit.audit(docs, labels).count() == 0
    some = [(i, "Same" if i % 2 else "b c", "en") for i in range(20)]
    docs, labels = frames(spark, some, [])
    assert len({tuple(r) for r in filter_audit.audit(docs.repartition(parts), labels).collect()}) == 600


def test_joint_counts_and_their_inverse(spark):
    """Survivors plus what each set removes is everything, and the values of all filters add up to what all remove."""
    docs, labels = frames(spark, [(i, ("A #" if i % 3 else "b") + " c" * (i % 5), "en") for i in range(50)], [])
    joint = filter_audit.joint_failures(filter_audit.flagged(docs, labels)).first().n
    assert joint[0] == 50
    rows = filter_audit.audit(docs, labels).collect()
    for r in rows:
        if r.step == 5:
            assert sum(x.removed for x in rows if x.filter_order == r.filter_order) == 50 - r.kept
    assert sum({r.filter_order[r.step - 1]: r.shapley for r in rows}.values()) == 120 * (50 - next(r.kept for r in rows if r.step == 5))
