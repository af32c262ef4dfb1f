import random
import re
from itertools import combinations

import pytest

from gridspan.llm import components as graph
from gridspan.llm import jaccard as J
from gridspan.llm import store
from gridspan.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)]) if words else frozenset()


def brute(rows):
    sets = [(k, shingles(t)) for k, t in rows]
    order = lambda k: -(1 << 63) if k is None else k
    up = {k: k for k, _ in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for (a, s), (b, t) in combinations(sets, 2):
        if a != b and s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = sorted((root(a), root(b)), key=order)
            up[y] = x
    return {(k, len(s), root(k)) for k, s in sets}


def check(docs, rows):
    found = J.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {tuple(r) for r in found} == brute(rows)


def test_odd_rows(table, odd):
    check(table(odd), odd)


def test_empty_table(table):
    assert J.near_duplicates(table([])).collect() == []


@pytest.mark.parametrize(("fill", "shingles", "hot"), [(2000, 4_000_000, 1000), (6, 4_000_000, 2), (2000, 300, 1000)])
def test_groups_and_borders(table, monkeypatch, fill, shingles, hot):
    """Copies, chains of near copies around the threshold, a passage in all texts; also with groups divided over tasks, and nodes of many edges."""
    monkeypatch.setattr(J, "FILL", fill)
    monkeypatch.setattr(J, "FILL_SHINGLES", shingles)
    monkeypatch.setattr(store, "HOT_ROWS", hot)
    monkeypatch.setattr(J, "HELD", 2000)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 9)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = word()
            if rng.random() < 0.3:
                words += passage
            rows.append((k, " ".join(words)))
            k += 1
            base = words if rng.random() < 0.5 else base
    rows += [(k + j, rows[j][1].upper()) for j in range(0, 20, 3)]
    check(table(rows), rows)


def test_the_sample_documents(documents):
    check(documents, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_keep_one(table):
    text = "the quick brown fox jumps over the lazy dog"
    docs = table([(3, text), (1, text), (2, "something else of five words or more"), (1, text)])
    assert sorted(r.doc_id for r in J.keep_one(docs).collect()) == [1, 2]
    assert J.keep_one(docs).columns == docs.columns


def test_keep_one_tells_rows_of_one_id_apart(table):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(12))
    rows = [(None, text(1)), (None, text(2)), (None, text(2)), (5, text(1)), (7, text(3)), (7, text(4)), (3, text(4)), (9, None)]
    found = sorted(((r.doc_id, r.text) for r in J.keep_one(table(rows)).collect()), key=str)
    assert found == sorted([(None, text(1)), (None, text(2)), (7, text(3)), (3, text(4)), (9, None)], key=str)


def test_shingles_of_one_set_are_not_shuffled(table, spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    text = lambda k: " ".join(f"w{k}x{j}" for j in range(200))
    near = text(1).replace("w1x0 ", "other ")
    rows = [(k, text(k)) for k in range(1, 40)] + [(90, near), (91, text(7)), (92, text(8))]
    docs = table(rows).select(store.doc_key().alias("k"), "text")
    sets = spark.createDataFrame([(k,) for k in [*range(1, 40), 90]], "rep long")

    class Held:
        def __init__(self, value):
            self.value = value

    places = spark.sparkContext.broadcast(J.standing(sets))
    texts = docs.select(J._slot(F.col("k")).alias("slot"), "text")
    ranks = J.frequent_shingles(texts, 5, places)
    batch = pa.RecordBatch.from_pylist([{"slot": r.slot, "text": r.text} for r in texts.collect()])
    made = pa.Table.from_batches(list(J._prefixes(Held(ranks), Held(places.value), 75, 5)([batch]))).to_pydict()
    # 196 shingles a set, 54 of them in the prefix; only 1 and 90 share any. The copies 91 and 92 make none of theirs shared.
    assert len(set(made["a"])) == 2
    assert 2 * J.SHARED <= len(made["a"]) <= 2 * 54


@pytest.mark.parametrize("copies", [1, 9])
def test_texts_are_not_shuffled_to_keep_one(table, spark, monkeypatch, copies):
    rows = [(100 * c + k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(30) for c in range(copies)] + [(9999, "w0x0 w0x1 w0x2 w0x3 w0x4")] * (copies > 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = J.keep_one(table(rows))
        plan = left._jdf.queryExecution().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r.doc_id for r in left.collect()) == [*range(30)] + [9999] * (copies > 1)
        monkeypatch.setattr(J, "BROADCAST_ROWS", 0)
        assert sorted(r.doc_id for r in J.keep_one(table(rows)).collect()) == [*range(30)] + [9999] * (copies > 1)
        monkeypatch.setattr(J, "BROADCAST_IDS", 0)
        assert sorted(r.doc_id for r in J.keep_one(table(rows)).collect()) == [*range(30)] + [9999] * (copies > 1)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tree_links_connect_what_all_pairs_connect():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 1 << 62, rng.integers(4, 60)).astype(np.uint64)
        for _ in range(rng.integers(1, 5)):
            sets.append(np.unique(np.concatenate([base, rng.integers(0, 1 << 62, 4).astype(np.uint64)])))
    order = J.order_by_likeness(sets)
    sets = [sets[k] for k in order]
    up = list(range(len(sets)))
    root = lambda k: k if up[k] == k else root(up[k])
    for a, b in J.tree_links(sets, None):
        up[root(a)] = root(b)
    for a, b in combinations(range(len(sets)), 2):
        s, t = set(sets[a].tolist()), set(sets[b].tolist())
        if 100 * len(s & t) >= 75 * len(s | t):
            assert root(a) == root(b)


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (5, 5)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in found} == {(k, 0) for k in range(1, 201)} | {(1001, 1000), (1002, 1000)}


def test_few_edges_take_one_task_and_many_go_by_rounds(spark, monkeypatch):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002)], "a long, b long").repartition(20)
    written = []
    monkeypatch.setattr(graph, "stash", lambda df, what: written.append(what) or store.stash(df, what))
    told = lambda: {(r.node, r.root) for r in components(edges).collect()}
    assert told() == {(k, 0) for k in range(1, 201)} | {(1001, 1000), (1002, 1000)}
    assert len(written) == 2
    monkeypatch.setattr(graph, "EDGES", 0)
    assert told() == {(k, 0) for k in range(1, 201)} | {(1001, 1000), (1002, 1000)}
    assert len(written) > 4


def test_a_hub_and_chains_with_edges_met_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(store, "HOT_ROWS", 3)
    monkeypatch.setattr(store, "HOT_KEYS", 100)
    edges = [(500, k) for k in range(501, 700)] + [(3, 690), (690, 700), (700, 701), (2000, 2001)]
    found = components(spark.createDataFrame(edges, "a long, b long").repartition(40)).collect()
    assert {(r.node, r.root) for r in found} == {(k, 3) for k in range(500, 702)} | {(2001, 2000)}


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    class Context:
        master = "yarn"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        store.shared_folder(Session)
