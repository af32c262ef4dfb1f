import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridspan.llm.queries import digests
from gridspan.llm.runs import find_runs, planted, runs_of

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=24, times=3):
    """By comparing each word with the one a period later."""
    found = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q) and not any(all(words[k] == words[k + r] for k in range(i, i + length - r)) for r in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plant(doc_id, words):
    """As the contract has it, word by word."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc_id, text):
    words = plant(doc_id, WORDS.findall(text or ""))
    runs = brute(words)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digest = sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone))
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (1, 3), (6, 2), (10, 4)])
def test_runs_of_many_texts(least, times):
    rng = random.Random(least)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(1, 10)):
            kinds = rng.choice([1, 2, 3, 6, 50])
            words = [rng.randrange(kinds) for _ in range(rng.randint(0, 160))]
            for _ in range(rng.randint(0, 3)):
                if len(words) > 3:
                    a = rng.randrange(len(words))
                    p, e = 1 + rng.randrange((len(words) - a) // 3 + 1), rng.randint(a, len(words))
                    words[a:e] = [words[a + (i - a) % p] for i in range(a, e)]
            texts.append(words)
        at = np.cumsum([0, *map(len, texts)])
        got = runs_of(np.array(sum(texts, []), np.int64), at, least, times)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, words in enumerate(texts) for r in brute(words, least, times)]


def test_the_query_against_a_plain_version(table, odd):
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:12]
    rng = random.Random(5)
    some = [(k, " \t".join(rng.choice("abcdefghij") + "é" for _ in range(rng.randint(1, 130)))) for k in ids]
    nested = " ".join((["a"] * 12 + ["b"]) * 9 + ["tail"] * 30)
    rows = [r for r in odd if r[1] is None or len(r[1]) < 10_000] + some + [(1_000_001, nested), (None, nested), (1_000_001, nested), (1_000_003, "x " * 23), (1_000_003, "x " * 24)]
    got = digests(find_runs(planted(table(rows)))).collect()
    assert sorted(map(tuple, got), key=str) == sorted((expected(*r) for r in rows), key=str)


def test_a_long_text_and_an_empty_table(table):
    long = [f"w{k % 7001}" for k in range(70_010)]
    got = find_runs(table([(3, " ".join(long))])).first()
    assert [tuple(r) for r in got.runs] == [(0, 70_010, 7_001)] and got.collapsed == " ".join(long[:7_001])
    assert find_runs(table([])).collect() == []


def test_the_sample_documents(documents):
    got = digests(find_runs(planted(documents))).collect()
    assert sorted(map(tuple, got)) == sorted(expected(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
