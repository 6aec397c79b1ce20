"""Near copies by wide fingerprints against all pairs of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pytest

from thermaline.llm import near_copies as nc


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(rng, text, share):
    return [f"x{rng.randrange(5000)}" if rng.random() < share else w for w in text]


def similarity(a, b):
    both = len(np.intersect1d(a, b))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def grouped(rows):
    """Smallest id of each id's group, by all pairs."""
    sets = {i: nc.shingle_set(t or "") for i, t in rows}
    low = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if low[a] != low[b] and similarity(sets[a], sets[b]) >= 0.8:
                    low[a] = low[b] = min(low[a], low[b])
                    changed = True
    return low


@pytest.mark.parametrize("n", [5, 9, 20, 60, 200, 900])
def test_radii_hold_pairs_at_the_threshold(n):
    rng = np.random.default_rng(n)
    whole, part = [], []
    for _ in range(1500):
        s = rng.integers(0, 2**63, n, dtype=np.uint64)
        whole.append(np.unique(s))
        part.append(np.unique(s[:-(-4 * n // 5)]))  # a part of four fifths: similarity 0.8
    x, y = nc.wide(whole), nc.wide(part)
    nx, ny = np.array([len(s) for s in whole]), np.array([len(s) for s in part])
    i, j, _ = nc.close(x, nx, y, ny)
    assert (i == j).sum() == 1500
    assert (i != j).sum() <= (20 if n >= 20 else 400)  # of 2.2 million other pairs


def test_groups_equal_brute_force(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(25):
        base = words(rng, rng.choice([6, 12, 40, 150, 400]))
        for share in (0, 0, 0.003, 0.01, 0.02, 0.04, 0.1):
            rows.append((at, " ".join(edited(rng, base, share))))
            at += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = grouped(rows)
    for group in (nc.GROUP, 500):  # also with groups over many blocks
        got = {r["did"]: r["root"]["did"] for r in nc.near_copies(df, group=group).collect()}
        assert got == expected
    assert len(set(expected.values())) < len(rows) - 25


def test_representatives_keep_clean_documents_and_one_near_copy(spark):
    rng = random.Random(5)
    base, other = words(rng, 300), words(rng, 300)
    half = base[:150] + words(rng, 150)
    rows = [(7, base), (3, edited(rng, base, 0.01)), (4, edited(rng, base, 0.01)), (1, other), (2, half), (9, ["few", "words"]), (8, ["Few", "WORDS"])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows] + [(5, None), (6, "  "), (None, "no id")], "doc_id long, text string")
    out = nc.representatives(df).collect()
    assert sorted(str(r["doc_id"]) for r in out) == ["1", "2", "3", "5", "8", "None"]
    assert nc.representatives(df.limit(0)).collect() == []
