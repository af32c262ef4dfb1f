"""Removal of repeated 100-byte strings, the first occurrence kept: longest-previous-factor arrays over suffix-order buckets.

A byte goes if a string of SPAN bytes that covers it also starts earlier. A
suffix array of a whole corpus fits no task, so suffixes that can share SPAN
bytes are brought together first:

1. Of the GRAM-byte strings within each SPAN-byte window, the one of the
   smallest hash is the window's anchor: equal windows have equal anchors, at
   equal places. Neighbouring windows mostly share an anchor, so a text leaves
   one row for some 25 bytes: its anchor's hash, and two independent hashes of the
   whole context (all windows with this anchor), of 96 bits together.
2. Rows meet by anchor. Of equal contexts the first stays and all others are
   repeats, found without their bytes; tasks settle their own before the
   shuffle, so a passage in a third of all documents is a few rows a task.
3. Where one anchor has different contexts, their bytes are fetched and meet by
   anchor (by window where an anchor has very many contexts). There the windows
   are put in suffix order with the lengths of common prefixes; the previous
   and the next smaller text position in that order give each window's longest
   previous factor. One of SPAN bytes is a repeat.
4. Repeats meet their texts by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import doc_key, row_keys, small_batches, text_key, tidy
from .text import U64, Shingler, column_bytes, mix, pieces

SPAN, GRAM = 100, 48
#: Rows that a task settles at a time, contexts of an anchor that meet in one task at most, windows in suffix order at a time.
HELD, CONTEXTS, WINDOWS = 1_000_000, 512, 200_000
_PIECE = 1 << 19
_NULL = -(1 << 63)
_ROW = "key long, e long, f int, k long, pos long, kind byte"
_ANCHOR, _MARK, _HOT = 0, 1, 2


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0x9E3779B97F4A7C15) + b
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


_BYTES = Shingler(1, fold_case=False)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U64(0xD1B54A32D192ED03))


def window_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the GRAM-byte and of the SPAN-byte string from each place on; the latter as far as they fit."""
    h = {1: _BYTE[data]}
    for n in (1, 2, 4, 8, 16, 32):
        h[2 * n] = _join(h[n][:-n], h[n][n:])
        if n < 16:
            del h[n]
    gram = _join(h[32][: len(data) - GRAM + 1], h[16][32 : len(data) - 15])
    return gram, _join(h[64][: len(data) - SPAN + 1], h[64][SPAN - 64 :])


def anchors(gram: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n places, that of the smallest of the SPAN - GRAM + 1 hashes from there on, the leftmost of equals."""
    value, place = gram, np.arange(len(gram), dtype=np.int64)

    def narrow(step: int) -> None:
        nonlocal value, place
        right = value[step:] < value[:-step]
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, value[step:], value[:-step])

    width, want = 1, SPAN - GRAM + 1
    while 2 * width <= want:
        narrow(width)
        width *= 2
    if want > width:
        narrow(want - width)
    return place[:n]


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor hash, two context hashes, first window, windows, anchor's place in the first) of each anchor of the texts."""
    none = tuple(np.empty(0, t) for t in (np.int64, U64, np.int64, np.int32, np.int64, np.int64, np.int64))
    if len(data) < SPAN:
        return none
    gram, window = window_hashes(data)
    n = len(window)
    place = anchors(gram, n)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    whole = np.arange(n) + SPAN <= offsets[row + 1]
    s = np.flatnonzero(whole)
    if not len(s):
        return none
    fresh = np.concatenate([[True], (place[s][1:] != place[s][:-1]) | (row[s][1:] != row[s][:-1])])
    first = s[fresh]
    last = np.append(s[np.flatnonzero(fresh)[1:] - 1], s[-1])
    at = place[first]
    e = _join(_join(window[first], window[last]), ((last - first) * 256 + at - first).astype(U64))
    f = _BYTES.hashes(data, first, last + SPAN) >> U64(32)
    # The upper bytes of an anchor's hash are left out, as they would only fill the shuffle: other anchors with this hash do no harm.
    return row[first], mix(gram[at]) >> U64(16), e.view(np.int64), f.astype(np.uint32).view(np.int32), first - offsets[row[first]], last - first + 1, at - first


def _pack(first, windows, inner):
    return (first << 16) | (windows << 8) | inner


def _spread(pos):
    return pos >> 16, (pos >> 8) & 255, pos & 255


def _rows(key, e, f, k, pos, kind) -> pa.RecordBatch:
    n = len(k)
    e, f, kind = (np.full(n, x) if np.isscalar(x) else x for x in (e, f, kind))
    arrays = [pa.array(key.astype(np.int64)), pa.array(e, pa.int64()), pa.array(f, pa.int32()), pa.array(k), pa.array(pos), pa.array(kind, pa.int8())]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _ROW.split(", ")])


def runs(k: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of ranges, as maximal runs by document."""
    if not len(k):
        return k, start, end
    order = np.lexsort((start, k))
    k, start, end = k[order], start[order], end[order]
    fresh = np.concatenate([[True], k[1:] != k[:-1]])
    # The furthest end so far within a document: ends lie above those of earlier documents once lifted by their number.
    lift = (np.cumsum(fresh) - 1) << 32
    far = np.maximum.accumulate(end + lift) - lift
    fresh[1:] |= start[1:] > far[:-1]
    at = np.flatnonzero(fresh)
    return k[at], start[at], np.maximum.reduceat(end, at)


def _marks(k, start, end) -> pa.RecordBatch:
    k, start, end = runs(k, start, end)
    return _rows(mix(k.astype(U64)), 0, 0, k, (start << 31) | (end - start), _MARK)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 1 and a task's own part of step 2: rows of anchors, and of repeats within the task."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        k, key, e, f, first, windows, inner = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((first, k, f, e, key))
        k, key, e, f, first, windows, inner = (c[order] for c in (k, key, e, f, first, windows, inner))
        again = np.concatenate([[False], (key[1:] == key[:-1]) & (e[1:] == e[:-1]) & (f[1:] == f[:-1])])
        head = np.flatnonzero(~again)[np.cumsum(~again) - 1]
        # A row that occurs again, of a repeated document, is no repeat of itself.
        again_elsewhere = again & ((k != k[head]) | (first != first[head]))
        if again_elsewhere.any():
            yield _marks(k[again_elsewhere], first[again_elsewhere], (first + windows + SPAN - 1)[again_elsewhere])
        one = ~again
        yield _rows(key[one], e[one], f[one], k[one], _pack(first, windows, inner)[one], _ANCHOR)

    for batch in batches:
        ids = np.asarray(batch.column(0))
        data, offsets = column_bytes(batch.column(1))
        for a, b in pieces(offsets, _PIECE):
            row, *found = contexts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(row):
                held.append((ids[a + row], *found))
                size += len(row)
            if size >= HELD:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, of rows in order of key, e, f, k, pos: repeats, and the first of each context whose anchor has others."""
    names = ("key", "e", "f", "k", "pos")
    wait = {c: np.empty(0, np.int32 if c == "f" else np.int64) for c in names}  # first rows of the key that may go on
    hot_key = last = None

    def send(x: dict, kind: np.ndarray) -> pa.RecordBatch:
        return _rows(*(x[c] for c in names), kind)

    for batch in batches:
        x = dict(zip((*names, "kind"), (np.asarray(c) for c in batch.columns), strict=True))
        made = x.pop("kind") == _MARK
        if made.any():
            yield _rows(x["key"][made], 0, 0, x["k"][made], x["pos"][made], _MARK)
        x = {c: v[~made] for c, v in x.items()}
        if not len(x["key"]):
            continue
        same = np.ones(len(x["key"]), bool)
        same[0] = last is not None and last[:3] == (x["key"][0], x["e"][0], x["f"][0])
        for c in ("key", "e", "f"):
            same[1:] &= x[c][1:] == x[c][:-1]
        head = np.where(~same, np.arange(len(same)), -1)
        head = np.maximum.accumulate(head)
        head_k = np.where(head < 0, last[3] if last else 0, x["k"][head])
        head_pos = np.where(head < 0, last[4] if last else 0, x["pos"][head])
        again = same & ((x["k"] != head_k) | (x["pos"] != head_pos))
        if again.any():
            first, windows, _ = _spread(x["pos"][again])
            yield _marks(x["k"][again], first, first + windows + SPAN - 1)
        last = x["key"][-1], x["e"][-1], x["f"][-1], head_k[-1], head_pos[-1]
        new = {c: v[~same] for c, v in x.items()}
        if hot_key is not None:
            hot = new["key"] == hot_key
            if hot.any():
                yield send({c: v[hot] for c, v in new.items()}, np.full(hot.sum(), _HOT))
                new = {c: v[~hot] for c, v in new.items()}
            if len(new["key"]):
                hot_key = None
        wait = {c: np.concatenate([wait[c], new[c]]) for c in names}
        if not len(wait["key"]):
            continue
        first = np.flatnonzero(np.concatenate([[True], wait["key"][1:] != wait["key"][:-1]]))
        n = np.diff(np.append(first, len(wait["key"])))
        many = np.repeat(n, n)
        whole = np.arange(len(many)) < first[-1]
        out = whole & (many > 1)
        if n[-1] > CONTEXTS:
            out[first[-1] :] = True
            hot_key = wait["key"][-1]
        if out.any():
            yield send({c: v[out] for c, v in wait.items()}, np.where(many[out] > CONTEXTS, _HOT, _ANCHOR))
        keep = ~whole if hot_key is None else np.zeros(len(many), bool)
        wait = {c: v[keep] for c, v in wait.items()}
    if len(wait["key"]) > 1:
        yield send(wait, np.full(len(wait["key"]), _ANCHOR))


_CONTEXT = "key long, k long, pos long, kind byte, data binary"


def _fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3's bytes: (k, text, told) to contexts by anchor, windows of hot anchors by their hash, and repeats so far."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int8(), pa.binary()]
    for batch in batches:
        out: list[tuple] = []
        size = 0
        for k, text, told in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            text = text.as_buffer() if text.is_valid else b""
            view = memoryview(text)
            marks = []
            flat = told.values
            for kind, pos, key in zip(*(flat.field(c).to_pylist() for c in ("kind", "pos", "key")), strict=True):
                if kind == _MARK:
                    marks.append((pos >> 31, (pos >> 31) + (pos & ((1 << 31) - 1))))
                    continue
                first, windows, _ = pos >> 16, (pos >> 8) & 255, pos & 255
                if kind == _ANCHOR:
                    out.append((key, k, first, _ANCHOR, bytes(view[first : first + windows + SPAN - 1])))
                else:
                    for s in range(first, first + windows):
                        window = bytes(view[s : s + SPAN])
                        name = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                        out.append((name, k, s, _ANCHOR, window))
                size += 200
            for _, start, end in zip(*(c.tolist() for c in runs(np.full(len(marks), k), *np.array(marks, np.int64).reshape(-1, 2).T)), strict=True):
                out.append((k * -7046029254386353131 % (1 << 63), k, (start << 31) | (end - start), _MARK, None))
            if len(out) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1."""
    found = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(found >= 0)
    todo = todo[values[found[todo]] >= values[todo]]
    while len(todo):
        found[todo] = found[found[todo]]
        todo = todo[found[todo] >= 0]
        todo = todo[values[found[todo]] >= values[todo]]
    return found


def suffix_order(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of equally long byte strings (rows), the earlier of equals first, and each one's common prefix with the one before."""
    n, width = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{width}").ravel(), kind="stable")
    common = np.zeros(n, np.int64)
    if n > 1:
        ordered = windows[order]
        differ = ordered[1:] != ordered[:-1]
        common[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return order, common


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each suffix, by text position, the longest prefix that it shares with a suffix of an earlier position.

    That is the longer of those shared with the nearest suffixes of smaller
    position before and after it in suffix order.
    """
    n = len(order)
    # least[j][i]: the least of 2^j common prefixes from i on.
    least = [common]
    while 2 << (len(least) - 1) <= n:
        step = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-step], least[-1][step:]))

    def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefix of the suffixes at places a < b of the order."""
        out = np.zeros(len(a), np.int64)
        level = np.floor(np.log2(b - a)).astype(np.int64)
        for j in np.unique(level):
            m = level == j
            out[m] = np.minimum(least[j][a[m] + 1], least[j][b[m] - (1 << j) + 1])
        return out

    before = previous_smaller(order)
    after = n - 1 - previous_smaller(order[::-1])[::-1]
    found = np.zeros(n, np.int64)
    m = before >= 0
    found[m] = shared(before[m], np.flatnonzero(m))
    m = after < n
    found[m] = np.maximum(found[m], shared(np.flatnonzero(m), after[m]))
    out = np.empty(n, np.int64)
    out[order] = found
    return out


def _repeats(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, of rows in order of key, k, pos: repeats."""
    rows: list[tuple[int, int, int, bytes]] = []
    size = 0

    def settle(rows: list[tuple[int, int, int, bytes]], more: bool) -> tuple[pa.RecordBatch | None, list]:
        """The repeats among the rows, and those that rows of the last key yet to come are to meet."""
        n = np.array([len(d) - SPAN + 1 for *_, d in rows])
        owner = np.repeat(np.arange(len(rows)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        k = np.array([r[1] for r in rows], np.int64)[owner]
        s = np.array([r[2] for r in rows], np.int64)[owner] + inner
        order = np.lexsort((s, k))
        order = order[np.concatenate([[True], (k[order][1:] != k[order][:-1]) | (s[order][1:] != s[order][:-1])])]
        flat = np.frombuffer(b"".join(d for *_, d in rows), np.uint8)
        start = np.repeat(np.cumsum(n + SPAN - 1) - (n + SPAN - 1), n) + inner
        windows = np.lib.stride_tricks.sliding_window_view(flat, SPAN)[start[order]]
        found = longest_previous(*suffix_order(windows)) >= SPAN
        marked = order[found]
        made = _marks(k[marked], s[marked], s[marked] + SPAN) if len(marked) else None
        if not more:
            return made, []
        new = np.zeros(len(rows), bool)
        new[owner[order[~found]]] = True
        return made, [r for r, fresh in zip(rows, new, strict=True) if fresh and r[0] == rows[-1][0]]

    for batch in batches:
        key, k, pos, kind = (c.to_pylist() for c in batch.columns[:4])
        marks = [i for i, x in enumerate(kind) if x == _MARK]
        if marks:
            yield _rows(np.array([key[i] for i in marks], np.int64), 0, 0, np.array([k[i] for i in marks], np.int64), np.array([pos[i] for i in marks], np.int64), _MARK)
        data = batch.column(4).to_pylist()
        for i, x in enumerate(kind):
            if x == _MARK:
                continue
            if size >= WINDOWS and (key[i] != rows[-1][0] or size >= 4 * WINDOWS):
                made, rows = settle(rows, key[i] == rows[-1][0])
                size = sum(len(r[3]) - SPAN + 1 for r in rows)
                if made is not None:
                    yield made
            rows.append((key[i], k[i], pos[i], data[i]))
            size += len(data[i]) - SPAN + 1
    if rows:
        made, _ = settle(rows, False)
        if made is not None:
            yield made


def _judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: (k, text, told) to what is kept."""
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    for batch in batches:
        out = []
        for k, text, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            text, removed, spans, digest, at = text or b"", 0, 0, hashlib.sha256(), 0
            if told.is_valid and len(told.values):
                pos = np.asarray(told.values.field("pos"))
                start = pos >> 31
                _, first, end = runs(np.zeros(len(pos), np.int64), start, start + (pos & ((1 << 31) - 1)))
                for a, b in zip(first.tolist(), end.tolist(), strict=True):
                    digest.update(text[at:a])
                    removed, at = removed + b - a, b
                spans = len(first)
            digest.update(text[at:])
            out.append((k, len(text), removed, spans, digest.hexdigest()))
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()], strict=True)], names)


def _told(rows: DataFrame) -> DataFrame:
    """(k, told): the repeated ranges of each document that has some, as packed (start, length) in told.pos. rows: (k, text), one text a k."""
    gather = lambda df, *c: df.groupBy("k").agg(F.collect_list(F.struct(*c)).alias("told"))
    found = rows.mapInArrow(tidy(_find), _ROW).repartition("key").sortWithinPartitions("key", "e", "f", "k", "pos").mapInArrow(tidy(_meet), _ROW)
    fetched = rows.join(gather(found, "kind", "pos", "key").hint("shuffle_hash"), "k").select("k", "text", "told").mapInArrow(tidy(_fetch), _CONTEXT)
    repeats = fetched.repartition("key").sortWithinPartitions("key", "k", "pos").mapInArrow(tidy(_repeats), _ROW)
    return gather(repeats, "pos")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of `docs`.

    A null text is empty; a text of fewer than SPAN bytes stays whole. A null
    doc_id counts as the smallest. Rows that repeat a doc_id and its text are
    one document and get equal results; rows that share a doc_id, or have none,
    with different texts are documents of their own, in order of their texts'
    SHA-256. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    keys = row_keys(docs)
    rows = docs.select(doc_key().alias("k"), F.col("text").cast("binary").alias("text"))
    if keys is not None:
        rows = docs.select(doc_key().alias("d"), text_key().alias("h"), F.col("text").cast("binary").alias("text")).join(keys, ["d", "h"]).select("k", "text")
    judged = rows.join(_told(rows).hint("shuffle_hash"), "k", "left").select("k", "text", "told")
    schema = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    found = judged.mapInArrow(tidy(_judge), schema)
    if keys is not None:
        found = found.join(keys, "k").withColumn("k", F.col("d"))
    return found.select(F.when(F.col("k") != F.lit(_NULL), F.col("k")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
