import hashlib
import random

import numpy as np
import pytest

from gridspan.llm import repeats as R


def brute(rows):
    seen, out = set(), {}
    for k, text in sorted({(k, t) for k, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        mark = np.zeros(len(b), bool)
        for s in range(len(b) - R.SPAN + 1):
            w = b[s : s + R.SPAN]
            if w in seen:
                mark[s : s + R.SPAN] = True
            seen.add(w)
        kept = np.frombuffer(b, np.uint8)[~mark].tobytes()
        runs = int(np.diff(np.concatenate([[0], mark.astype(int)])).clip(0).sum())
        out[k] = (len(b), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(docs, rows):
    found = R.remove_repeats(docs).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    for r in found:
        assert tuple(r[1:]) == want[r.doc_id], r.doc_id


def test_odd_rows(table, odd):
    check(table(odd), odd)


def test_rows_of_one_id_are_told_apart(table):
    """Texts without an id, one of them empty, and two of one id, with strings that repeat at the same and at other places."""
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    shared = text(150)
    rows = [(None, ""), (None, shared + text(90)), (None, shared + text(300)), (None, text(20) + shared), (4, text(40) + shared + text(7)), (4, text(250)), (4, "short"), (6, shared), (6, shared)]
    places = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))
    want = brute(list(enumerate(t for _, t in places)))
    want = sorted(((rows_id, *want[k]) for k, (rows_id, _) in enumerate(places) for _ in range(rows.count(places[k]))), key=str)
    assert sorted((tuple(r) for r in R.remove_repeats(table(rows)).collect()), key=str) == want


def test_empty_table(table):
    assert R.remove_repeats(table([])).collect() == []


@pytest.mark.parametrize("contexts", [512, 2])
def test_planted_repeats(table, monkeypatch, contexts):
    """Passages at many offsets, near copies, overlapping repeats within a text, periodic texts; also with hot anchors."""
    for name, value in (("CONTEXTS", contexts), ("WINDOWS", 500), ("HELD", 300)):
        monkeypatch.setattr(R, name, value)
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(3)]
    rows = []
    for k in range(60):
        t = text(rng.randint(5, 60)) + rng.choice(shared)[rng.randint(0, 40) :] + text(10)
        if k % 7 == 0:
            t = t + "|" + t
        if k % 11 == 0:
            t = "ab" * rng.randint(60, 200) + t
        rows.append((k, t))
    rows += [(100 + k, t[:50] + "#" + t[51:]) for k, t in rows[:20]]
    check(table(rows), rows)


def test_the_sample_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check(documents, rows)


def test_longest_previous_factor():
    rng = np.random.default_rng(0)
    for _ in range(20):
        windows = rng.integers(0, 2, (40, 6)).astype(np.uint8) + 65
        found = R.longest_previous(*R.suffix_order(windows))
        for i in range(40):
            best = max((next((n for n in range(6) if windows[i][n] != windows[j][n]), 6) for j in range(i)), default=0)
            assert found[i] == best


def test_contexts_of_one_anchor_whose_first_hash_begins_alike(table):
    """Two contexts of one anchor that agree in 32 bits of one hash, as happens among 100,000 of them, are told apart."""
    rng = np.random.default_rng(7)
    grams = rng.integers(97, 123, (20_000, R.GRAM)).astype(np.uint8)
    first = R.window_hashes(np.ascontiguousarray(grams).ravel())[0][:: R.GRAM]
    anchor = grams[int(np.argmin(first))]
    n, side = 200_000, R.SPAN - R.GRAM
    texts = np.concatenate([rng.integers(97, 123, (n, side)), np.tile(anchor, (n, 1)), rng.integers(97, 123, (n, side))], axis=1).astype(np.uint8)
    row, key, e, f, *_ = R.contexts(texts.ravel(), np.arange(n + 1) * texts.shape[1])
    mine = np.flatnonzero(key == R.mix(np.array([first.min()], R.U64))[0] >> R.U64(16))
    order = mine[np.argsort(e[mine])]
    alike = np.flatnonzero(e[order][1:] >> 32 == e[order][:-1] >> 32)
    assert len(alike), "no two of so many agree in 32 bits"
    for i in alike[:5]:
        a, b = order[i], order[i + 1]
        assert (e[a], f[a]) != (e[b], f[b]) and not (texts[row[a]] == texts[row[b]]).all()
    a, b = (texts[row[order[alike[0] + j]]].tobytes().decode() for j in (0, 1))
    pair = [(1, a), (2, b)]
    check(table(pair), pair)
    assert [r.n_removed for r in R.remove_repeats(table(pair)).collect()] == [0, 0]
