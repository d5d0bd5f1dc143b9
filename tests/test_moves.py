"""Names of moves against making the moves one after the other."""

import os
import random

import pytest

from ledgerleaf.operators import apply

MOVE = "rel string, dst string, ord int"


def one_after_the_other(moves, files):
    """{rel: (final, why)} by sets of what is there."""
    there = set(files)
    folders = {os.path.dirname(f) for f in files}
    folders |= {os.path.dirname(f) for f in set(folders)} | {os.path.dirname(os.path.dirname(f)) for f in set(folders)}
    folders.discard("")
    found = {}
    for rel, dst, _ in sorted(moves, key=lambda m: m[2]):
        want = dst + os.path.basename(rel) if dst.endswith("/") else f"{dst}/{os.path.basename(rel)}" if dst in folders else dst
        final, why = want, None
        if want.startswith(rel + "/"):
            final, why = None, apply.IN_ITSELF
        elif want != rel and (want in there or want in folders):
            stem, ext = os.path.splitext(os.path.basename(want))
            final = os.path.join(os.path.dirname(want), f"{stem} (2){ext}")
            if final in there or final in folders:
                final, why = None, apply.TAKEN
        found[rel] = (final, why)
        if final is not None and final != rel:
            there.discard(rel)
            there.add(final)
            at = os.path.dirname(final)
            while at:
                folders.add(at)
                at = os.path.dirname(at)
    return found


def settled(spark, moves, files):
    got = apply.placed(spark.createDataFrame(moves, MOVE), spark.createDataFrame([(f,) for f in files], "rel string")).collect()
    assert len(got) == len(moves)
    return {r.rel: (r.final, r.why) for r in got}


CASES = {
    "a chain frees names in order": [("a.txt", "x/a.txt", 1), ("b.txt", "a.txt", 2), ("c.txt", "b.txt", 3), ("d.txt", "c.txt", 4)],
    "against the order it does not": [("d.txt", "c.txt", 1), ("c.txt", "b.txt", 2), ("b.txt", "a.txt", 3), ("a.txt", "x/a.txt", 4)],
    "a cycle": [("a.txt", "b.txt", 1), ("b.txt", "c.txt", 2), ("c.txt", "a.txt", 3)],
    "one name for all": [(f"{c}.txt", "n.txt", k) for k, c in enumerate("abcde")],
    "a freed name goes to the first": [("a.txt", "x/", 1), ("b.txt", "a.txt", 2), ("c.txt", "a.txt", 3), ("d.txt", "a.txt", 4)],
    "a folder without its slash": [("a.txt", "in", 1), ("b.txt", "new", 2), ("c.txt", "new/deep/", 3), ("d.txt", "new", 4), ("e.txt", "new/deep", 5)],
    "a folder that a move makes": [("a.txt", "made/here/", 1), ("b.txt", "made", 2), ("c.txt", "made/here", 3), ("d.txt", "made/here/a.txt", 4)],
    "back where it was": [("a.txt", "a.txt", 1), ("b.txt", "a.txt", 2), ("in/a.txt", "in", 3)],
    "into itself": [("a.txt", "a.txt/x", 1), ("b.txt", "b.txt/", 2)],
}
FILES = ["a.txt", "b.txt", "c.txt", "d.txt", "e.txt", "in/a.txt", "in/sub/z.txt", "n (2).txt"]


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    assert settled(spark, CASES[name], FILES) == one_after_the_other(CASES[name], FILES)


@pytest.mark.parametrize("seed", range(3))
def test_random_moves(spark, seed):
    rng = random.Random(seed)
    names = [f"{f}{n}{x}" for f in ("", "p/", "p/q/") for n in "abc" for x in (".txt", "")]
    files = rng.sample(names, 12) + ["p/q/k.txt"]
    files = [f for f in files if not any(other.startswith(f + "/") for other in files)]
    moving = rng.sample(files, min(9, len(files)))
    moves = [(rel, rng.choice([*names, "p/", "p", "p/q", "new/", "new", "a/"]), k) for k, rel in enumerate(moving)]
    moves = [(r, d, o) for r, d, o in moves if not any(f == d.rstrip("/") or d.startswith(f + "/") for f in files if d.endswith("/"))]
    assert settled(spark, moves, files) == one_after_the_other(moves, files)


def test_nothing_to_move(spark):
    assert settled(spark, [], FILES) == {}
