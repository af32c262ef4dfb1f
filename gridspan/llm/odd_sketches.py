"""Near-duplicates of high similarity: MinHash bands bring documents together, odd sketches tell how similar they are.

1. Each distinct set of shingles gets BANDS * ROWS MinHash samples. The samples
   of a band make one key; the samples of all bands, folded into a bitmap by
   parity, make an odd sketch of BITS bits.
2. Sets that share a band's key and whose sizes allow it are compared by their
   sketches: the bits in which two sketches differ estimate the similarity, most
   precisely where it is high. MARGIN below the threshold they are no candidates.
   Keys of more than FEW sets link all of theirs, pair by pair in a chain.
3. The components of candidates are the groups in which links can be. Their
   texts meet in tasks and are compared on their full sets; parity bitmaps of
   the full sets, whose differing bits never exceed the true difference, spare
   most exact counts. Of a group of more than a task's fill, every part meets
   first itself and a leader, and only what the leader's component does not hold
   then meets the other parts.
4. Links give components; copies have that of their set.

Steps 1 and 2 miss a pair of sets at the threshold itself with a chance of about
one in a million, less above: at 0.85, no band agrees with (1 - 0.85^4)^20 = 4e-7,
and the sketches are off by MARGIN with about 1e-6. Step 3 is exact, but for equal
64-bit hashes of different shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .jaccard import BROADCAST_ROWS, FILL, FILL_SHINGLES, _prints, _sets, told
from .store import doc_key, meet, small_batches, stash, tidy
from .text import U64, Shingler, column_bytes, mix

PERCENT, WORDS = 85, 5
#: Bands, samples in each, bits of a sketch, and how far below the threshold an estimate may be.
BANDS, ROWS, BITS, MARGIN = 20, 4, 256, 0.25
#: Sets of one key that are compared pair by pair, and rows (key, set) or sets that a task holds at a time.
FEW, HELD = 16, 400_000

_XOR, _TIMES = (mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U64(seed)) | U64(1) for seed in (0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """The BANDS * ROWS MinHash samples of each set, none of which is empty."""
    tokens = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((BANDS * ROWS, len(sets)), U64)
    for k in range(BANDS * ROWS):
        out[k] = np.minimum.reduceat((tokens ^ _XOR[k]) * _TIMES[k], at)
    return out.T


def keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of each row of samples."""
    bands = found.reshape(len(found), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(found), 1))
    for k in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return out


def parity(rows: np.ndarray, values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmaps of n rows, in words of 64 bits: a bit is set where an odd number of the row's values fall."""
    flat = rows * bits + (values & U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(flat, minlength=n * bits) & 1).astype(bool)
    return np.packbits(odd.reshape(n, bits), axis=1, bitorder="little").view("<u8").astype(U64)


def sketches(found: np.ndarray) -> np.ndarray:
    """The odd sketch of each row of samples: each sample, with its number, flips one bit."""
    n, k = found.shape
    flips = mix(found + np.arange(1, k + 1, dtype=np.uint64) * U64(0xA0761D6478BD642F))
    return parity(np.repeat(np.arange(n), k), flips.ravel(), n, BITS)


def similarity(differing: np.ndarray) -> np.ndarray:
    """The similarity that so many differing bits of two odd sketches stand for; half of the bits or more: -infinity."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(2 * differing < BITS, 1 + BITS / (4 * BANDS * ROWS) * np.log1p(-2 * np.minimum(differing, BITS / 2) / BITS), -np.inf)


# 1. Samples


def _measure(k: int):
    """Rows (k, n, print, print, keys, sketch); keys and sketch are null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            every = batch.column(0)
            held: list[np.ndarray] = []
            size = first = 0

            def out(at: int) -> pa.RecordBatch:
                full = [s for s in held if len(s)]
                made = samples(full) if full else np.empty((0, BANDS * ROWS), U64)
                mask = np.array([len(s) == 0 for s in held])
                where = np.concatenate([[0], np.cumsum(~mask)])

                def lists(table: np.ndarray) -> pa.Array:
                    width = table.shape[1] if table.ndim == 2 else 1
                    offsets = pa.array((where * width).astype(np.int32), mask=np.append(mask, False))
                    return pa.ListArray.from_arrays(offsets, pa.array(table.ravel().view(np.int64), pa.int64()))

                prints = [_prints(s) for s in held]
                columns = [pa.array([len(s) for s in held], pa.int64()), pa.array([p for p, _ in prints], pa.int64()), pa.array([p for _, p in prints], pa.int64())]
                return pa.RecordBatch.from_arrays([every.slice(at, len(held)), *columns, lists(keys(made)), lists(sketches(made))], ["k", "n", "p1", "p2", "keys", "sketch"])

            for found in _sets(shingler, *column_bytes(batch.column(1))):
                held.append(found)
                size += len(found)
                if size >= 100_000:  # samples of so many shingles are made in the processor's cache
                    yield out(first)
                    first, held, size = first + len(held), [], 0
            if held:
                yield out(first)

    return run


# 2. Candidates


def _deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, n, sketch) of sets to their keys; or (b, a, -1, null), a link between b and a. In: (set, n, keys, sketch)."""

    def out(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        name, n = (np.concatenate([np.asarray(p.column(i)) for p in parts]) for i in (0, 1))
        key, sketch = (np.concatenate([np.asarray(p.column(i).flatten()) for p in parts]) for i in (2, 3))
        order = np.argsort(key, kind="stable")
        key, owner = key[order], order // BANDS
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.append(first, len(key)))
        # Of a key that many sets have here, the first goes on for all.
        many = np.repeat(count > FEW, count)
        head = np.zeros(len(key), bool)
        head[first] = True
        forest = Forest()
        links = np.unique(np.stack([name[owner[np.repeat(first, count)[many & ~head]]], name[owner[many & ~head]]], axis=1), axis=0)
        for a, b in links.tolist():
            forest.join(a, b)
        linked = [(forest.root(x), x) for x in forest.up]
        goes = ~many | head
        key, owner = key[goes], owner[goes]
        data = np.ascontiguousarray(sketch.reshape(-1, BITS // 64)[owner]).astype("<i8").tobytes()
        width = BITS // 8
        packed = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer((np.arange(len(key) + 1) * width).astype(np.int32)), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key, np.array([b for _, b in linked], np.int64)])),
                pa.array(np.concatenate([name[owner], np.array([a for a, _ in linked], np.int64)])),
                pa.array(np.concatenate([n[owner], np.full(len(linked), -1)])),
                pa.concat_arrays([packed, pa.nulls(len(linked), pa.binary())]),
            ],
            ["key", "a", "n", "sketch"],
        )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows * BANDS
        if size >= HELD:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _candidates(percent: int):
    def settle(key, name, n, sketch) -> list[np.ndarray]:
        """Pairs of candidates, of rows in order of key; all rows of each key are here."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.repeat(np.diff(np.append(first, len(key))), np.diff(np.append(first, len(key))))
        made = []
        for step in range(1, min(FEW, len(key))):
            at = np.flatnonzero((key[step:] == key[:-step]) & (name[step:] != name[:-step]) & ((total[step:] <= FEW) | (step == 1)))
            if not len(at) and not (key[step:] == key[:-step]).any():
                break
            small, large = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
            near = similarity(np.bitwise_count(sketch[at] ^ sketch[at + step]).sum(1).astype(np.int64)) >= percent / 100 - MARGIN
            at = at[(total[at] > FEW) | ((100 * small >= percent * large) & near)]
            made.append(np.stack([name[at], name[at + step]], axis=1))
        return made

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.empty(0, np.int64),) * 3 + (np.empty((0, BITS // 64), U64),)
        pairs = lambda found: pa.RecordBatch.from_arrays([pa.array(c) for c in np.unique(np.concatenate([np.empty((0, 2), np.int64), *found]), axis=0).T.copy()], ["a", "b"])
        for batch in batches:
            key, name, n = (np.asarray(batch.column(i)) for i in range(3))
            link = n < 0
            found = [np.stack([name[link], key[link]], axis=1)]
            own = column_bytes(batch.column(3))[0].view("<u8").reshape(-1, BITS // 64).astype(U64)
            key, name, n, sketch = (np.concatenate([x, y]) for x, y in zip(rest, (key[~link], name[~link], n[~link], own), strict=True))
            if len(key):
                start = int(np.searchsorted(key, key[-1]))
                if start:
                    found += settle(key[:start], name[:start], n[:start], sketch[:start])
                rest = key[start:], name[start:], n[start:], sketch[start:]
                if len(rest[0]) > FEW:  # what comes yet of this key meets its last set, as one of many
                    found.append(np.stack([rest[1][:-1], rest[1][1:]], axis=1))
                    rest = tuple(np.repeat(x[-1:], FEW + 1, axis=0) for x in rest)
            yield pairs(found)
        if len(rest[0]):
            yield pairs(settle(*rest))

    return run


# 3. Links


def confirmed(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what all links connect: pairs of places in left + right. right None: within left."""
    every = left + (right or [])
    sizes = np.array([len(s) for s in every])
    bits = min(max(BITS, 1 << int(4 * sizes.max() - 1).bit_length()), 1 << 14)
    marks = parity(np.repeat(np.arange(len(every)), sizes), mix(np.concatenate(every) ^ U64(0xE7037ED1A0B428DB)), len(every), bits)
    part = np.arange(len(every))
    links = []
    for m in range(len(left)):
        start = m + 1 if right is None else len(left)
        may = start + np.flatnonzero(part[start:] != part[m])
        may = may[(100 * np.minimum(sizes[may], sizes[m]) >= percent * np.maximum(sizes[may], sizes[m]))]
        # Linked sets differ in at most so many shingles, and bitmaps in no more bits than sets in shingles.
        apart = np.bitwise_count(marks[may] ^ marks[m]).sum(1, dtype=np.int64)
        for o in may[(100 + percent) * apart <= (100 - percent) * (sizes[may] + sizes[m])].tolist():
            if part[o] == part[m]:
                continue
            s, t = every[m], every[o]
            common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum())
            if 100 * common >= percent * (len(s) + len(t) - common):
                part[part == part[o]] = part[m]
                links.append((m, o))
    return links


def _verify(percent: int, k: int):
    """Links of the sets of each part: rows in order of (group, part), then side, rep, p1, p2 and text. Sides other than 0 meet side 0 only."""

    def solve(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        left, right = ([x for x in rows if (x[0] == 0) is own] for own in (True, False))
        if not left or len(rows) < 2:
            return []
        names = [rep for _, rep, _ in left + right]
        return [(names[i], names[j]) for i, j in confirmed([s for *_, s in left], [s for *_, s in right] or None, percent)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, now, held, links = Shingler(k), None, [], []
        for batch in batches:
            group, part, side, rep, p1, p2 = (batch.column(i).to_pylist() for i in range(6))
            for i, found in enumerate(_sets(shingler, *column_bytes(batch.column(6)))):
                if (group[i], part[i]) != now:
                    links += solve(held)
                    now, held = (group[i], part[i]), []
                if _prints(found) == (p1[i], p2[i]):
                    held.append((side[i], rep[i], found))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])
                links = []
        if links := solve(held):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _numbers(n) -> object:
    return F.filter(F.sequence(F.lit(0), n.cast("int")), lambda j: j < n)


def _parts(groups: DataFrame) -> DataFrame:
    """(rep, p1, p2, group, part, side, parts): each set to its part of its group, the group's leader to all of them. groups: (rep, size, p1, p2, group)."""
    per = groups.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), F.min("p1").alias("leader"))
    parts = F.ceil(F.greatest(F.col("n") / FILL, F.col("shingles") / FILL_SHINGLES)).cast("int")
    placed = meet(groups, per.select("group", "n", "leader", parts.alias("parts")), ["group"]).withColumn("own", F.pmod(F.xxhash64("p2", "rep"), F.col("parts")).cast("int"))
    to = F.when(F.col("p1") == F.col("leader"), _numbers(F.col("parts"))).otherwise(F.array("own"))
    return placed.select("rep", "p1", "p2", "group", F.explode(to.cast("array<string>")).alias("part"), F.lit(0).alias("side"), "parts")


def _rest(groups: DataFrame, roots: DataFrame) -> DataFrame | None:
    """The parts in which sets of large groups that are not in its largest component meet each other and all else; None if there are none.

    groups: (rep, p1, p2, group) of groups of more than one part; roots: (rep, root) so far.
    """
    now = stash(groups.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "large-groups")
    counts = now.groupBy("group", "root").agg(F.count("*").alias("m"))
    top = counts.groupBy("group").agg(F.max_by("root", F.struct("m", "root")).alias("top"), F.max("m").alias("held"), F.sum("m").alias("n"))
    top = top.filter("n > held").withColumns({"a": F.ceil(2 * F.col("held") / FILL).cast("int"), "r": F.ceil(2 * (F.col("n") - F.col("held")) / FILL).cast("int")})
    if not top.limit(1).count():
        return None
    placed = meet(now, top, ["group"]).withColumn("in", F.col("root") == F.col("top"))
    h = F.pmod(F.xxhash64("p2", "rep"), F.when(F.col("in"), F.col("a")).otherwise(F.col("r"))).cast("int")
    place = lambda kind, i, j, side: F.struct(F.concat_ws("-", F.lit(kind), i.cast("string"), j.cast("string")).alias("part"), side.cast("int").alias("side"))
    from_top = F.transform(_numbers(F.col("r")), lambda j: place("top", j, h, F.lit(1)))
    to_top = F.transform(_numbers(F.col("a")), lambda j: place("top", h, j, F.lit(0)))
    rest = F.transform(_numbers(F.col("r")), lambda j: place("rest", F.least(h, j), F.greatest(h, j), h > j))
    to = F.explode(F.when(F.col("in"), from_top).otherwise(F.concat(to_top, rest))).alias("to")
    return placed.select("rep", "p1", "p2", "group", to).select("rep", "p1", "p2", "group", "to.part", "to.side")


def near_copies(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`; kept: it is the smallest of its component.

    A text with fewer than k words (but one) is a single shingle; one without
    words, or null, has none and is linked with nothing. A null doc_id counts
    as the smallest. Repeated rows count each; rows of one doc_id are one
    document, so what any of them is linked with is in its component. An empty
    table gives no rows. Other columns are not looked at. A text takes some 100
    bytes of a task's memory for each of its words, however long it is.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(doc_key().alias("k"), "text")
    measured = stash(rows.mapInArrow(tidy(_measure(k)), "k long, n long, p1 long, p2 long, keys array<long>, sketch array<long>"), "samples")
    per = measured.filter("n > 0").groupBy("p1", "p2")
    sets = stash(per.agg(F.min("k").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "distinct-sets")

    dealt = sets.select("p1", "n", "keys", "sketch").mapInArrow(tidy(_deal), "key long, a long, n long, sketch binary")
    candidates = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(_candidates(percent)), "a long, b long")
    near = components(candidates)
    tops = near.select(F.col("root").alias("node"), "root").distinct()
    named = near.unionAll(tops).select(F.col("node").alias("p1"), F.col("root").alias("group"))
    groups = stash(sets.select("p1", "p2", "rep", F.col("n").alias("size")).join(named, "p1"), "groups")

    def links(to: DataFrame) -> DataFrame:
        if to.count() <= BROADCAST_ROWS:
            to = F.broadcast(to)
        parts = rows.join(to, rows["k"] == to["rep"]).select("group", "part", "side", "rep", "p1", "p2", "text")
        return parts.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(tidy(_verify(percent, k)), "a long, b long")

    parts = stash(_parts(groups), "parts")
    found = stash(links(parts), "links")
    large = parts.filter("parts > 1").select("rep", "p1", "p2", "group").distinct()
    if large.limit(1).count():
        roots = components(found).select(F.col("node").alias("rep"), "root")
        if (to := _rest(large, roots)) is not None:
            found = found.unionAll(links(stash(to, "parts")))
    every = told(measured.select("k", "n", "p1", "p2"), sets.select("p1", "p2", "rep", "copies"), found)
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
