import random

import numpy as np
import pytest

from gridspan.llm import odd_sketches as O
from gridspan.llm import store
from tests.llm.test_jaccard import shingles


def brute(rows):
    """Components of documents by comparing all pairs."""
    order = lambda k: -(1 << 63) if k is None else k
    sets = [(k, shingles(t)) for k, t in rows]
    up = {k: k for k, _ in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((root(a), root(b)), key=order)
                up[y] = x
    return sorted(((k, len(s), root(k), root(k) == k) for k, s in sets), key=str)


def check(docs, rows):
    assert sorted(map(tuple, O.near_copies(docs).collect()), key=str) == brute(rows)


def test_odd_rows(table, odd):
    check(table(odd), odd)


def test_empty_table(table):
    assert O.near_copies(table([])).collect() == []


def many(seed, groups, most):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = word()
            rows.append((len(rows), " ".join(words)))
            base = words if rng.random() < 0.5 else base
    return rows + [(len(rows) + j, rows[j][1].upper()) for j in range(0, 20, 3)]


@pytest.mark.parametrize(("fill", "few", "hot"), [(2000, 16, 1000), (7, 3, 3)])
def test_groups_and_borders(table, monkeypatch, fill, few, hot):
    """Copies and chains of near copies around the threshold; also with groups divided over tasks and keys of many sets."""
    monkeypatch.setattr(O, "FILL", fill)
    monkeypatch.setattr(O, "FEW", few)
    monkeypatch.setattr(O, "HELD", 300)
    monkeypatch.setattr(store, "HOT_ROWS", hot)
    rows = many(4, 14, 12)
    check(table(rows), rows)


def test_the_sample_documents(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_sketches_estimate_high_similarities():
    """Within MARGIN / 2 of the truth, mostly far closer; and keys of near copies agree in a band."""
    rng = np.random.default_rng(6)
    for share in (0.85, 0.9, 0.97):
        sets = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64)
            apart = round(1000 * (1 - share) / (1 + share))  # so many of each set alone make the similarity
            sets += [np.unique(np.concatenate([both[apart:], rng.integers(0, 1 << 63, apart, dtype=np.int64).astype(np.uint64)])) for _ in range(2)]
        found = O.samples(sets)
        marks, keys = O.sketches(found), O.keys(found)
        told = O.similarity(np.bitwise_count(marks[::2] ^ marks[1::2]).sum(1).astype(np.int64))
        assert abs(told.mean() - share) < 0.02 and np.abs(told - share).max() < O.MARGIN / 2 + 0.05
        assert (keys[::2] == keys[1::2]).any(1).all()


def test_confirmed_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(4, 60)).astype(np.uint64)
        sets += [np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 3).astype(np.uint64)])) for _ in range(rng.integers(1, 5))]
    for right in (None, sets[40:]):
        left = sets if right is None else sets[:40]
        up = list(range(len(sets)))
        root = lambda k: k if up[k] == k else root(up[k])  # noqa: B023, E731
        for a, b in O.confirmed(left, right):
            up[root(a)] = root(b)
        for a in range(len(left)):
            for b in range(a) if right is None else range(40, len(sets)):
                s, t = set(sets[a].tolist()), set(sets[b].tolist())
                if 100 * len(s & t) >= 85 * len(s | t):
                    assert root(a) == root(b)
