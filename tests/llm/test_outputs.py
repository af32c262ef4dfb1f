"""Packing, archives, sharding, the classifier and the pipeline."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspan.llm import packing as K
from gridspan.llm import quality_model as Q
from gridspan.llm import sharding as H
from gridspan.llm import store
from gridspan.llm import warc as W

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def packed_well(found, capacity=2048):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("which", ["odd", "sample", "empty"])
def test_packing(which, documents, table, odd, tokenizer):
    special = [(30, "<|endoftext|> and <|ENDOFTEXT|>"), (31, "don't ÉTÉ ẞ 한국어 12,5% !!,, \x1e x\x1ey"), (32, "é İstanbul ΣΣ")]
    docs = {"odd": table(odd + special), "sample": documents, "empty": table([])}[which]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = K.pack(docs, PATH).collect()
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]
    want = Counter()
    for (k, _), whole in zip(rows, ids, strict=True):
        for p, a in enumerate(range(0, len(whole), 2048)):
            part = whole[a : a + 2048]
            want[(k, p, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == want
    if found:
        least = -(-sum(map(len, ids)) // 2048)
        assert least <= packed_well(found) <= least + 1 + len(rows) // 20


def test_plan_fills_exactly():
    counts = np.zeros(101, np.int64)
    counts[[100, 60, 40, 30, 10, 25, 50]] = [3, 10, 4, 6, 6, 4, 3]
    lines = K.plan(counts)
    assert {int(x): int(lines[lines[:, 0] == x, 2].sum()) for x in np.flatnonzero(counts)} == {int(x): int(counts[x]) for x in np.flatnonzero(counts)}
    rng = random.Random(0)
    for _ in range(50):
        counts = np.array([0] + [rng.choice([0, 0, 1, 5]) for _ in range(64)])
        lines, fill = K.plan(counts), defaultdict(list)
        for length, first, n, sequence, offset in lines.tolist():
            assert first >= 0
            for j in range(n):
                fill[sequence + j].append((offset, length))
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64


@pytest.mark.parametrize("hot", [1000, 1])
def test_archives(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(store, "HOT_ROWS", hot)
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, ""), (4, "http://a b\r\n/4", None), (5, "u", "<p>é</p>" * 3000), (None, "u", "<p>other</p>"), (7, "u", "<p>other</p>"), (8, "u", "WARC/1.1\r\n\r\n x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.withColumns({c: F.lit("x") for c in ("k", "n", "first", "last", "digest", "revisit", "data", "_hot")})
    archives = W.write_archives(pages)
    found = {r.page_id: tuple(r)[1:] for r in W.read_archives(archives).collect()}
    first = {}
    for k, _, html in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        first.setdefault(html or "", k)
    assert len(found) == len(rows)
    for k, _, html in rows:
        data = (html or "").encode()
        response = first[html or ""] == k
        assert found[k] == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[html or ""])
    W.export(archives, tmp_path)
    records = [r for f in tmp_path.iterdir() for r in W.read_archive(f.read_bytes())]
    ids = [re.search(rb"WARC-Record-ID: (\S+)", r)[1] for r in records]
    assert len(set(ids)) == len(ids)
    assert {m[1] for r in records if (m := re.search(rb"WARC-Refers-To: (\S+)", r))} <= set(ids)
    assert len(records) == len(rows) and all(r.startswith(b"WARC/1.1\r\n") for r in records)
    large = {r.page_id: r.record_type for r in W.read_archives(W.write_archives(pages, 12)).collect()}
    assert large[2] == "response" and large[4] == "response"
    assert W.read_archives(W.write_archives(pages.limit(0))).collect() == []


def test_reading_takes_time_in_proportion_to_bytes():
    """Frames far smaller and far larger than what is read at a time; a cut archive is no archive."""
    rng = random.Random(3)
    records = [rng.randbytes(rng.choice([0, 1, 50, 3000, 70_000])) for _ in range(3000)]
    data = W.write_archive(records)
    assert list(W.read_archive(data)) == records
    with pytest.raises((ValueError, W.zstandard.ZstdError)):
        list(W.read_archive(data[:-3]))
    took = []
    for n in (1000, 4000):
        one = W.write_archive([rng.randbytes(2000) for _ in range(n)])
        began = time.perf_counter()
        assert sum(1 for _ in W.read_archive(one)) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_dictionary_helps():
    rng = random.Random(1)
    records = [f"<html><head><title>{rng.random()}</title></head><body class='page main wide'>{rng.random()}</body></html>".encode() * 2 for _ in range(400)]
    import zstandard

    plain = sum(len(zstandard.compress(r)) for r in records)
    data = W.write_archive(records)
    assert list(W.read_archive(data)) == records
    assert len(data) < plain + W.DICTIONARY_BYTES
    assert list(W.read_archive(W.write_archive([b"x"]))) == [b"x"]


def test_sharding(table, odd, documents):
    for rows in (odd, [(r.doc_id, r.text) for r in documents.collect()], []):
        found = H.shard(table(rows)).collect()
        want = Counter((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in rows)
        assert Counter(tuple(r)[:3] for r in found) == want
        for s in range(8):
            assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))
        groups = defaultdict(set)
        for r in found:
            groups[(r.size, r.text_crc32)].add(r.shard)
        assert all(len(g) == 1 for g in groups.values())
    sums = Counter()
    for r in H.shard(documents).collect():
        sums[r.shard] += r.size
    largest = max(len((r.text or "").encode()) for r in documents.collect())
    assert max(sums.values()) - min(sums.values()) < largest / 10


def test_sharding_in_many_levels(table, documents, monkeypatch):
    """Partials of few groups, so that they are differenced in tasks more than once; and many copies of one text."""
    for module, name, value in ((H, "GROUPS", 8), (H, "PARTIALS", 3), (store, "HOT_ROWS", 10)):
        monkeypatch.setattr(module, name, value)
    rows = [(r.doc_id, r.text) for r in documents.collect()] + [(1000 + k, f"text {k} " * (k % 13)) for k in range(400)] + [(5000 + k, "one text of many") for k in range(60)]
    found = H.shard(table(rows)).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows)
    assert len({r.shard for r in found if r.doc_id >= 5000}) == 1
    sums = Counter()
    for r in found:
        sums[r.shard] += r.size
    assert sum(sums.values()) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert max(sums.values()) - min(sums.values()) < max(len((t or "").encode()) for _, t in rows)


def test_differencing_is_that_of_the_books():
    """Two parts: the differences of the two largest numbers, again and again, leave the final difference."""
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randint(1, 1000) for _ in range(rng.randint(1, 40))]
        left = sorted(sizes)
        while len(left) > 1:
            a, b = left.pop(), left.pop()
            left = sorted([*left, a - b])
        sums = [0, 0]
        for v, (s, _) in zip(sizes, H.difference([[v, 0] for v in sizes]), strict=True):
            sums[s] += v
        assert abs(sums[0] - sums[1]) == left[0]


def test_differencing_is_balanced():
    rng = random.Random(4)
    sizes = [rng.randint(1, 10**6) for _ in range(500)]
    sums = [0] * 8
    for v, (s, *_) in zip(sizes, H.difference([[v, *[0] * 7] for v in sizes]), strict=True):
        sums[s] += v
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) < 2000
    assert H.difference([]) == []


def test_classifier(spark, table, odd):
    path = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    found = {r.doc_id: r for r in Q.classify(docs, labels).collect()}
    told = {r.doc_id: r.quality for r in labels.collect()}
    for k, r in found.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(told[k], r.score) for k, r in found.items() if r.held_out and k in told]
    good, bad = [s for y, s in held if y == 1], [s for y, s in held if y == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    odd_found = Q.classify(table(odd), labels).collect()
    assert len(odd_found) == len(odd)
    assert [r.score for r in Q.classify(table(odd), labels.limit(0)).collect()] == [0.5] * len(odd)
    assert Q.classify(table([]), labels).collect() == []


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    path = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in Q.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_pipeline(spark):
    """run() against the operators' brute-force versions on the small table."""
    import corpus_pipeline as C
    from gridspan.llm import pii as P
    from gridspan.llm import quality_rules as R

    from .test_filters import leaks
    from .test_jaccard import brute

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id for r in R.quality(docs).filter("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept]
    own = {k for k, _, c in brute(rows) if k == c}
    rows = [(k, t) for k, t in rows if k in own]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    gone = {k for k, *_ in leaks(rows, items)}
    rows = [(k, t) for k, t in rows if k not in gone]
    finder = P.Finder(P.train(spark.createDataFrame(rows, "doc_id long, text string")))
    rows = [(k, P.redact(t, finder.find([t])[0][1])) for k, t in rows]
    tokenizer = Tokenizer.from_file(PATH)
    want = set()
    for k, t in rows:
        whole = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want |= {(k, p, a, len(whole[a : a + 2048]), zlib.crc32(whole[a : a + 2048].tobytes())) for p, a in enumerate(range(0, len(whole), 2048))}
    found = C.run(spark, path).collect()
    assert {tuple(r)[:5] for r in found} == want and len(found) == len(want)
    packed_well(found)


def test_word_vectors_and_pooling(table, monkeypatch):
    """The table and the pooled vectors against loops over tokens, with few rows, so that words share them."""
    import itertools

    monkeypatch.setattr(Q, "ROWS", 128)
    texts = ["the cat, the dog; 42 cats!", "", None, "ein Hund und 7 Katzen\n\nund das", "x"]
    kind = lambda c: 0 if c in " \t\n\x0b\f\r" else 2 if c.isdigit() else 1 if c.isalpha() else 3
    tokens = [["".join(g) for k, g in itertools.groupby(t or "", kind) if k] for t in texts]
    h = {w: Q.Tokens().find(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0] for t in tokens for w in t}
    assert all(len(x) == 1 for x in h.values())
    whole = np.zeros((Q.ROWS, Q.WIDTH))
    for t in tokens:
        for i, j in itertools.product(range(len(t)), repeat=2):
            if 1 <= abs(i - j) <= Q.REACH:
                for place, sign in Q._index(h[t[j]]):
                    whole[Q._rows(h[t[i]])[0], place[0]] += sign[0]
    whole /= np.maximum(np.linalg.norm(whole, axis=1, keepdims=True), 1)
    whole -= whole.mean(0)
    docs = table(list(enumerate(texts)))
    vectors = Q.word_vectors(docs)
    np.testing.assert_allclose(vectors, whole, atol=1e-6)
    batch = Q.pa.RecordBatch.from_arrays([Q.pa.array(range(len(texts))), Q.pa.array(texts)], ["doc_id", "text"])
    pooled = [np.frombuffer(x, np.float32) for x in next(Q._pool(vectors)([batch])).column(1).to_pylist()]
    for t, found in zip(tokens, pooled, strict=True):
        each = np.array([whole[Q._rows(h[w])[0]] for w in t]).reshape(-1, Q.WIDTH)
        want = np.concatenate([each.mean(0), each.std(0), [np.log1p(len(t)) / 10, len(set(t)) / len(t)]]) if t else np.zeros(2 * Q.WIDTH + 2)
        np.testing.assert_allclose(found, want, atol=1e-5)


def test_the_training_rows_are_those_of_the_smallest_hashes(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.encode(F.col("id").cast("string"), "utf-8").alias("pooled")).repartition(16)
    want = sorted(r.doc_id for r in rows.orderBy(F.xxhash64("doc_id")).limit(300).collect())
    assert [r.doc_id for r in Q._smallest(rows, 300)] == want
    assert len(Q._smallest(rows, 9000)) == 5000 and Q._smallest(rows.limit(0), 5) == []


def pipeline_folder(spark, folder, rows, benchmark):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("x") for c in ("k", "n", "key", "_c0", "group", "_row")}).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    """Null and shared ids of unlike texts, nulls elsewhere, repeated rows, an item without an id: nothing is lost that should stay."""
    import corpus_pipeline as C

    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(n))
    good = [(None, words(80)), (None, words(90)), (500, words(70)), (500, words(75)), (501, words(3000)), (502, words(100) + " write to a.b@c.de")]
    item = words(30)
    rows = [(k, t, None if k else "en", None, None if t is None else len(t)) for k, t in [*odd, *good, (503, good[0][1]), good[4], (504, words(60) + " " + item)]]
    path = pipeline_folder(spark, tmp_path, rows, [(None, item), (1, None), (2, "")])
    found = C.run(spark, path).collect()
    assert Counter(r.doc_id for r in found if r.piece == 0 and r.doc_id not in {k for k, _ in odd if k}) == Counter([None, None, 500, 500, 501, 502])
    assert max(r.piece for r in found if r.doc_id == 501) > 0
    packed_well(found)


def test_pipeline_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    assert C.run(spark, pipeline_folder(spark, tmp_path, [], [])).collect() == []


def test_words_with_marks_share_their_stem_and_a_table_holds_what_was_asked():
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = K.WordTokens(path)
    assert K.WordTokens(path).tokenizer is tokens.tokenizer
    words = {w.encode() for w in ("Stemword", "stemword***", "stemword,%%%", "stemword...", "don't", "rock's'", "a<|b|>", "cafés!!", "éé", "x2&&", "***", "中文.", "é.")} | {b"bad\xff\xfe,,"}
    asked = []
    encode, tokens._encode = tokens._encode, lambda missing: asked.extend(missing) or encode(missing)
    table = tokens.fill(words)
    assert set(table) == words
    assert b"stemword***" not in asked and b"stemword,%%%" not in asked
    assert table == {w: tokens._plain(w) for w in words}
