"""Near-duplicate groups: documents whose sets of 5-word shingles have a Jaccard similarity of 0.75 or more.

The join is exact. Four steps:

1. Shingles are counted over the whole corpus, of equal texts mostly one. The
   most frequent of them, a bounded number, get a rank; all others are rare. A
   bitmap of SCREEN slots tells those that surely occur in one set only.
2. Every set is ordered by (rank, hash) and its prefix, the first n - ceil(0.75 n)
   + SHARED shingles, is emitted but for those of one set only, which link
   nothing. Two similar sets share SHARED prefix shingles, whatever the order
   (sets too small for that share one); rare shingles first keep passages that
   many documents share out of it. Equal sets meet before the shuffle. Pairs of
   sets that share a shingle of few sets are counted; SHARED of them are a
   candidate link. A shingle of more than FEW sets links all its sets of
   compatible sizes at once, as near copies mostly do. The components of
   candidate links are the groups that can hold a link.
3. The texts of a group meet in a task, where signature trees find its links: a
   node holds the OR of its sets' bitmaps and their range of sizes; pairs of
   nodes are traversed together and left when their sizes or the largest
   possible overlap rule out every pair, or when all their sets are linked
   already. Surviving pairs are verified on the sets. A group of more than a
   task's fill is divided by size and hash, and every two parts with compatible
   sizes meet.
4. Links give components; copies have that of their set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .store import doc_key, meet, row_keys, small_batches, stash, text_key, tidy
from .text import U64, Shingler, column_bytes, mix, pieces

PERCENT, WORDS = 75, 5
#: Documents that make a shingle frequent, and frequent shingles that get a rank at most.
FREQUENT, RANKED = 8, 1 << 20
#: Prefix shingles that similar sets share at least, sets from which on they do for certain, and sets of a shingle whose pairs are counted.
SHARED, LARGE, FEW = 5, 20, 16
#: Bits of a shingle's hash that it is counted by, and counted at a time in a task.
KEY_BITS, HELD = 40, 2_000_000
#: Slots (powers of 2) of the bitmap of shingles of two sets or more, and of that of documents that stand for their set. Full ones spare nothing, but lose nothing.
SCREEN, STANDING = 1 << 28, 1 << 26
#: Sets of a group in a task at most, their shingles, rows of a table that is broadcast, and ids.
FILL, FILL_SHINGLES, BROADCAST_ROWS, BROADCAST_IDS = 2_000, 4_000_000, 500_000, 2_000_000
_NULL = -(1 << 63)


def _sets(shingler: Shingler, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct shingles, in order of hash."""
    for a, b in pieces(offsets):
        hashes, at = shingler.shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(b - a):
            row = np.sort(hashes[at[k] : at[k + 1]])
            yield row[np.concatenate([[True], row[1:] != row[:-1]])] if len(row) > 1 else row


def _prints(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell one set of shingles from another."""
    a = int(mix(found + U64(1)).sum(dtype=U64))
    b = int(mix(found ^ U64(0xD6E8FEB86659FD93)).sum(dtype=U64))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def size_class(n):
    """Sets whose sizes differ by no more than 4 to 3 are in one class or in adjacent ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(4 / 3) + 1e-9).astype(np.int64)


# 1. Frequent shingles


def standing(sets: DataFrame) -> np.ndarray:
    """A bitmap by `_slot` of the documents that stand for their set; some others share a slot with them."""
    slot = _slot(F.col("rep"))
    maps = sets.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    found = np.zeros(max(STANDING >> 3, 4096), np.uint8)
    for at, bits in maps.collect():  # STANDING bits in all at most
        found[(at - 1) * 4096 : at * 4096] = np.frombuffer(bytes(bits), np.uint8)
    return found


def _slot(key):
    return F.pmod(F.xxhash64(key), F.lit(STANDING)) + 1


def _stands(places, column: pa.Array) -> pa.Array:
    """Which slots are in the bitmap."""
    at = np.asarray(column) - 1
    return pa.array((places.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)


def _keys(buckets: int, k: int, places):
    shift = KEY_BITS - (buckets.bit_length() - 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(k), [], 0

        def out() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held) >> U64(64 - KEY_BITS)) if held else np.empty(0, U64)
            cuts = np.searchsorted(keys, np.arange(buckets + 1, dtype=np.uint64) << U64(shift))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            blobs = []
            for j in full:
                low = (keys[cuts[j] : cuts[j + 1]] & U64((1 << shift) - 1)).astype("<u8")
                steps = np.diff(low, prepend=U64(0)).view(np.uint8).reshape(-1, 8)
                # Equal bytes of all steps together: the upper ones are zeros.
                blobs.append(zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])

        for batch in batches:
            for found in _sets(shingler, *column_bytes(batch.column(1).filter(_stands(places, batch.column(0))))):
                held.append(found)
                size += len(found)
                if size >= HELD:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return run


def _count(buckets: int, screen: int):
    shift = KEY_BITS - (buckets.bit_length() - 1)
    slots, wide = screen // buckets, KEY_BITS - (screen.bit_length() - 1)

    def tell(bucket: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.sort(np.concatenate(parts))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        n = np.diff(np.append(first, len(keys)))
        many = n >= FREQUENT
        level = np.floor(np.log2(n[many])).astype(np.int64)
        packed = (((keys[first][many] + (U64(bucket) << U64(shift))) << U64(8)) + level.astype(U64)).astype("<u8")
        shared = np.zeros(slots, bool)
        shared[(keys[first][n > 1] >> U64(wide)).astype(np.int64)] = True
        bits = zlib.compress(np.packbits(shared, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([np.bincount(level, minlength=64).tolist()], pa.list_(pa.int64())), pa.array([packed.tobytes()], pa.binary()), pa.array([bucket], pa.int32()), pa.array([bits], pa.binary())],
            ["levels", "data", "bucket", "shared"],
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and parts:
                    yield tell(now, parts)
                    parts = []
                now = bucket
                steps = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
                parts.append(np.cumsum(np.ascontiguousarray(steps.T).view("<u8").ravel(), dtype=U64))
        if parts:
            yield tell(now, parts)

    return run


def _from_level(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                packed = np.frombuffer(data, "<u8")
                packed = packed[(packed & U64(255)) >= U64(least)]
                if len(packed):
                    yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], ["data"])

    return run


def frequent_shingles(texts: DataFrame, k: int, places) -> tuple[np.ndarray, bytes]:
    """Of the texts (slot, text) whose slot is in places, a broadcast bitmap:

    - key * 256 + floor(log2(texts)) of the most frequent shingles, in order: as many whole levels as RANKED holds. They only order shingles; the result of the join doesn't depend on them.
    - a bitmap by the first bits of a key, of all shingles that are in two texts or more.
    """
    parts = max(texts.rdd.getNumPartitions(), 1)
    buckets = 1 << min(max(8, (4 * parts - 1).bit_length()), SCREEN.bit_length() - 4)
    keys = texts.mapInArrow(tidy(_keys(buckets, k, places)), "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
    counted = stash(keys.mapInArrow(tidy(_count(buckets, SCREEN)), "levels array<long>, data binary, bucket int, shared binary"), "frequent")
    levels = np.zeros(64, np.int64)
    for level, n in counted.select(F.posexplode("levels")).groupBy("pos").agg(F.sum("col")).collect():
        levels[level] = n
    least = next(x for x in range(65) if levels[x:].sum() <= RANKED)
    rows = counted.mapInArrow(tidy(_from_level(least)), "data binary").collect()  # RANKED entries at most
    screen = np.zeros(SCREEN >> 3, np.uint8)
    size = len(screen) // buckets
    for r in counted.select("bucket", "shared").collect():  # SCREEN bits in all
        screen[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(zlib.decompress(bytes(r.shared)), np.uint8)
    return np.sort(np.frombuffer(b"".join(bytes(r.data) for r in rows), "<u8").astype(U64)), screen.tobytes()


class Ranks:
    """The rank of each shingle: 0 if rare, else a number that grows with its documents."""

    def __init__(self, packed: np.ndarray):
        self.keys, self.levels = packed >> U64(8), (packed & U64(255)).astype(np.int64)
        self.screen = np.zeros(1 << 23, bool)
        self.screen[(self.keys & U64((1 << 23) - 1)).astype(np.int64)] = True

    def of(self, found: np.ndarray) -> np.ndarray:
        out = np.zeros(len(found), np.int64)
        keys = found >> U64(64 - KEY_BITS)
        maybe = np.flatnonzero(self.screen[(keys & U64((1 << 23) - 1)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.keys, keys[maybe]), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == keys[maybe], self.levels[at], 0)
        return out


# 2. Candidate links


def _measure(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            rows = [(len(s), *_prints(s)) for s in _sets(shingler, *column_bytes(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 3))], ["k", "n", "p1", "p2"])

    return run


def _shared(screen: bytes, found: np.ndarray) -> np.ndarray:
    """Which shingles may be in more than one set."""
    at = found >> U64(65 - (8 * len(screen)).bit_length())
    return (np.frombuffer(screen, np.uint8)[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _prefixes(ranks, places, percent: int, k: int):
    """Rows (key, kind, a, b): set a of size class `kind`, standing for b sets, has prefix shingle `key`; of kind -1: a and b are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, screen = ranks.value
        shingler, rank, done = Shingler(k), Ranks(frequent), set()  # done: some of the sets seen; more would only spare rows
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def out() -> pa.RecordBatch:
            count = np.array([len(t) for t, _, _ in held])
            token = np.concatenate([t for t, _, _ in held]).astype(np.int64)
            kind = np.repeat(size_class(np.array([n for _, n, _ in held])), count)
            owner = np.repeat(np.array([p for _, _, p in held], np.int64), count)
            order = np.lexsort((owner, kind, token))
            token, kind, owner = token[order], kind[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (kind[1:] != kind[:-1])]))
            n = np.diff(np.append(first, len(token)))
            # Of a shingle that many sets of a class have here, the first goes on for all.
            many = np.repeat(n, n) > FEW
            head = np.zeros(len(token), bool)
            head[first] = True
            gone = many & ~head
            links = np.unique(np.stack([np.repeat(owner[first], n)[gone], owner[gone]], axis=1), axis=0)
            token, kind, a, b = token[~gone], kind[~gone], owner[~gone], np.where(many, np.repeat(n, n), 1)[~gone]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([token, mix(links[:, 1].astype(U64)).astype(np.int64)])),
                    pa.array(np.concatenate([kind, np.full(len(links), -1)]), pa.int32()),
                    pa.array(np.concatenate([a, links[:, 0]])),
                    pa.array(np.concatenate([b, links[:, 1]])),
                ],
                ["key", "kind", "a", "b"],
            )

        for batch in batches:
            for found in _sets(shingler, *column_bytes(batch.column(1).filter(_stands(places, batch.column(0))))):
                n = len(found)
                if not n or (name := _prints(found)[0]) in done:
                    continue
                if len(done) < 100_000:
                    done.add(name)
                level = rank.of(found)
                order = np.argsort(level, kind="stable") if level.any() else slice(None)
                prefix = found[order][: n + percent * n // -100 + SHARED]
                prefix = prefix[_shared(screen, prefix)]
                if not len(prefix):
                    continue
                held.append((prefix, n, name))
                size += len(prefix)
                if size >= HELD // 8:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return run


def _links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): pairs that share n prefix shingles, of rows in order of key, kind and a. A link at once counts SHARED."""
    small = int(size_class(LARGE)) + 1
    rest = tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64))

    def settle(key, kind, a, b) -> list[np.ndarray]:
        """Of whole keys."""
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.append(first, len(key)))
        total = np.repeat(np.add.reduceat(b, first), n)
        made = []
        for step in range(1, min(FEW, len(key))):
            same = (key[step:] == key[:-step]) & (kind[step:] - kind[:-step] <= 1) & (a[step:] != a[:-step])
            at = np.flatnonzero(same & ((total[step:] <= FEW) | (step == 1)))
            if not len(at) and not (key[step:] == key[:-step]).any():
                break
            weight = np.where((total[at] > FEW) | (kind[at] <= small), SHARED, 1)
            made.append(np.stack([np.minimum(a[at], a[at + step]), np.maximum(a[at], a[at + step]), weight], axis=1))
        return made

    for batch in batches:
        key, kind, a, b = (np.asarray(c) for c in batch.columns)
        link = kind < 0
        found = [np.stack([np.minimum(a, b)[link], np.maximum(a, b)[link], np.full(link.sum(), SHARED)], axis=1)]
        key, kind, a, b = (np.concatenate([x, y[~link]]) for x, y in zip(rest, (key, kind, a, b), strict=True))
        if len(key):
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (a[1:] != a[:-1])])
            b = np.maximum.reduceat(b, np.flatnonzero(once))
            key, kind, a = key[once], kind[once], a[once]
            start = np.searchsorted(key == key[-1], True) if key[0] != key[-1] else 0
            if start:
                found += settle(key[:start], kind[:start], a[:start], b[:start])
            rest = key[start:], kind[start:], a[start:], b[start:]
            if len(rest[0]) > FEW:
                found += settle(*rest)
                # What comes yet of this key meets its last set, as one of many.
                rest = tuple(x[-1:] for x in rest[:3]) + (np.array([FEW + 1]),)
        yield _pairs(found)
    if len(rest[0]):
        yield _pairs(settle(*rest))


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate([np.empty((0, 3), np.int64), *found])
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(1)])) if len(rows) else np.empty(0, int)
    n = np.add.reduceat(rows[:, 2], first) if len(rows) else rows[:, 2]
    return pa.RecordBatch.from_arrays([pa.array(rows[first, 0]), pa.array(rows[first, 1]), pa.array(n, pa.int64())], ["a", "b", "n"])


# 3. Links, by signature trees


class Tree:
    """Sets in order of likeness, and levels of nodes over them: OR of bitmaps, sizes, and the most bits that sets share with themselves."""

    LEAF, FAN = 16, 4

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sizes = np.array([len(s) for s in sets])
        marks = np.zeros((len(sets), bits // 64), U64)
        for k, s in enumerate(sets):
            bit = mix(s ^ U64(0xA0761D6478BD642F)) & U64(bits - 1)
            np.bitwise_or.at(marks[k], (bit >> U64(6)).astype(np.int64), U64(1) << (bit & U64(63)))
        self.marks = marks
        #: Shingles that share their bit with another of the set: so many more than common bits an overlap can have.
        self.excess = self.sizes - np.bitwise_count(marks).sum(1).astype(np.int64)
        at = np.arange(0, len(sets), self.LEAF)
        self.levels = [self._level(at, marks, self.sizes, self.sizes, self.excess, len(sets), np.minimum(at + self.LEAF, len(sets)))]
        while len(self.levels[-1]["low"]) > 1:
            x = self.levels[-1]
            at = np.arange(0, len(x["low"]), self.FAN)
            self.levels.append(self._level(at, x["marks"], x["low"], x["high"], x["excess"], len(x["low"]), np.minimum(at + self.FAN, len(x["low"]))))

    @staticmethod
    def _level(at, marks, low, high, excess, n, ends):
        return {
            "first": at, "end": ends, "marks": np.bitwise_or.reduceat(marks, at, axis=0), "low": np.minimum.reduceat(low, at),
            "high": np.maximum.reduceat(high, at), "excess": np.maximum.reduceat(excess, at),
        }


def order_by_likeness(sets: list[np.ndarray]) -> list[int]:
    """Near copies mostly agree in their smallest hash."""
    return sorted(range(len(sets)), key=lambda k: (int(sets[k][0]), len(sets[k])))


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that connect what all links connect: pairs of places in left + right. right None: within left."""
    every = left + (right or [])
    widest = max(len(s) for s in every)
    bits = min(max(256, 1 << (4 * widest - 1).bit_length()), 1 << 14)
    a = Tree(left, bits)
    b, shift = (a, 0) if right is None else (Tree(right, bits), len(left))
    forest, links = Forest(), []

    def possible(x, i, y, j) -> np.ndarray:
        """Which nodes j of y may hold a set similar to one of node i of x."""
        low, high = x["low"][i] + y["low"][j], (100 * y["high"][j] >= percent * x["low"][i]) & (100 * x["high"][i] >= percent * y["low"][j])
        common = np.bitwise_count(x["marks"][i] & y["marks"][j]).sum(1).astype(np.int64) + np.minimum(x["excess"][i], y["excess"][j])
        return high & ((100 + percent) * common >= percent * low)

    def one(t: Tree, level: int, node: int, at: int) -> int:
        """The component that all sets of a node are in, or -1."""
        first, end = node, node + 1
        for x in reversed(t.levels[: level + 1]):
            first, end = x["first"][first], x["end"][end - 1]
        root = forest.root(int(first) + at)
        return root if all(forest.root(k + at) == root for k in range(int(first) + 1, int(end))) else -1

    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        p, i, q, j = todo.pop()
        x, y = a.levels[p], b.levels[q]
        if p or q:
            itself = right is None and (p, i) == (q, j)
            if not itself and (root := one(a, p, i, 0)) >= 0 and root == one(b, q, j, shift):
                continue
            if itself:  # each kid with itself and with those after it, so that no pair is met from both sides
                for k in range(int(x["first"][i]), int(x["end"][i])):
                    later = np.arange(k + 1, int(x["end"][i]))
                    below = a.levels[p - 1]
                    todo += [(p - 1, k, p - 1, int(o)) for o in later[possible(below, k, below, later)]] + [(p - 1, k, p - 1, k)]
            elif p >= q:
                kids = np.arange(x["first"][i], x["end"][i])
                todo += [(p - 1, int(k), q, j) for k in kids[possible(y, j, a.levels[p - 1], kids)]]
            else:
                kids = np.arange(y["first"][j], y["end"][j])
                todo += [(p, i, q - 1, int(k)) for k in kids[possible(x, i, b.levels[q - 1], kids)]]
            continue
        for m in range(int(x["first"][i]), int(x["end"][i])):
            start = int(y["first"][j]) if right is not None else max(int(y["first"][j]), m + 1)
            others = np.arange(start, int(y["end"][j]))
            if not len(others):
                continue
            sizes = {"low": b.sizes, "high": b.sizes, "marks": b.marks, "excess": b.excess}
            own = {"low": a.sizes, "high": a.sizes, "marks": a.marks, "excess": a.excess}
            for o in others[possible(own, m, sizes, others)]:
                s, t = left[m], every[int(o) + shift]
                if forest.root(m) == forest.root(int(o) + shift):
                    continue
                place = np.minimum(np.searchsorted(t, s), len(t) - 1)
                common = int((t[place] == s).sum())
                if 100 * common >= percent * (len(s) + len(t) - common):
                    forest.join(m, int(o) + shift)
                    links.append((m, int(o) + shift))
    return links


def _verify(percent: int, k: int):
    """Rows in order of group and part: (group, part columns.., side, rep, p1, p2, text)."""

    def solve(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        sides = []
        for side in (0, 1):
            mine = [(rep, s) for on, rep, s in rows if on == side]
            order = order_by_likeness([s for _, s in mine])
            sides.append([mine[i] for i in order])
        if not sides[0] or (not sides[1] and len(sides[0]) < 2):
            return []
        names = [rep for rep, _ in sides[0] + sides[1]]
        return [(names[i], names[j]) for i, j in tree_links([s for _, s in sides[0]], [s for _, s in sides[1]] or None, percent)]

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


def _parts(groups: DataFrame) -> DataFrame:
    """(rep, p1, p2, group, part, side): where each set goes. groups: (rep, n, p1, p2, group)."""
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9).cast("int")
    sets = groups.withColumn("kind", kind)
    # Sizes of sets are within a third of each other in a kind, so blocks of equally many sets hold about equally many shingles.
    fill = F.greatest(F.col("m") / FILL, F.col("shingles") / FILL_SHINGLES)
    counts = sets.groupBy("group", "kind").agg(F.count("*").alias("m"), F.sum("n").alias("shingles")).withColumn("fill", fill)
    plans = counts.groupBy("group").agg(
        F.greatest(F.sum("m") / FILL, F.sum("shingles") / FILL_SHINGLES).alias("fill"),
        F.map_from_entries(F.collect_list(F.struct("kind", F.ceil(2 * F.col("fill")).cast("int").alias("n")))).alias("blocks"),
    )
    planned = sets.join(plans, "group").withColumn("h", F.pmod(F.xxhash64("p2", "rep"), F.col("blocks")[F.col("kind")]).cast("int"))
    h, own = F.col("h"), F.col("kind")
    blocks = lambda s: F.coalesce(F.col("blocks")[s], F.lit(0))
    name = lambda *x: F.concat_ws("-", *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in x))
    numbers = lambda n: F.filter(F.sequence(F.lit(0), n), lambda j: j < n)
    place = lambda part, side: F.struct(part.alias("part"), side.cast("int").alias("side"))
    same = F.transform(numbers(blocks(own)), lambda j: place(name(own, own, F.least(h, j), F.greatest(h, j)), h > j))
    above = F.transform(numbers(blocks(own + 1)), lambda j: place(name(own, own + 1, h, j), F.lit(0)))
    below = F.transform(numbers(blocks(own - 1)), lambda j: place(name(own - 1, own, j, h), F.lit(1)))
    alone = F.array(place(F.lit("all"), F.lit(0)))
    to = F.explode(F.when(F.col("fill") <= 1, alone).otherwise(F.concat(same, above, below))).alias("to")
    return planned.select("rep", "p1", "p2", "group", to).select("rep", "p1", "p2", "group", "to.part", "to.side")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs`.

    A text with fewer than k words (but one) is a single shingle; one without
    words, or null, has none and is linked with nothing. A null doc_id counts
    as the smallest. Repeated rows count each; rows of one doc_id are one
    document, so what any of them is linked with is in its component. An empty
    table gives no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(doc_key().alias("k"), "text")
    measured = stash(rows.mapInArrow(tidy(_measure(k)), "k long, n long, p1 long, p2 long"), "sets")
    sets = stash(measured.filter("n > 0").groupBy("p1", "p2").agg(F.min("k").alias("rep"), F.max("n").alias("n"), F.count("*").alias("copies")), "distinct-sets")

    places = spark.sparkContext.broadcast(standing(sets))
    texts = rows.select(_slot(F.col("k")).alias("slot"), "text")
    ranks = spark.sparkContext.broadcast(frequent_shingles(texts, k, places))
    prefixes = texts.mapInArrow(tidy(_prefixes(ranks, places, percent, k)), "key long, kind int, a long, b long")
    candidates = prefixes.repartition("key").sortWithinPartitions("key", "kind", "a").mapInArrow(tidy(_links), "a long, b long, n long")
    near = components(candidates.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= SHARED))
    ranks.unpersist()
    places.unpersist()
    tops = near.select(F.col("root").alias("node"), "root").distinct()
    named = near.unionAll(tops).select(F.col("node").alias("p1"), F.col("root").alias("group"))
    groups = stash(sets.drop("copies").join(named, "p1"), "groups")

    to = stash(_parts(groups), "parts")
    if to.count() <= BROADCAST_ROWS:
        parts = rows.join(F.broadcast(to), F.col("k") == F.col("rep"))
    else:
        parts = _of_ids(rows, "k", groups.select(F.col("rep").alias("k"))).join(to, F.col("k") == F.col("rep"))
    parts = parts.select("group", "part", "side", "rep", "p1", "p2", "text")
    links = parts.repartition("group", "part").sortWithinPartitions("group", "part").mapInArrow(tidy(_verify(percent, k)), "a long, b long")
    return told(measured, sets, links)


def _of_ids(rows: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """`rows` with one of the ids, or without; texts are not shuffled for it while BROADCAST_IDS holds them."""
    ids = ids.distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def told(measured: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of measured (k, n, p1, p2). sets: (p1, p2, rep, copies); links: (a, b) of reps."""
    linked = components(links).select(F.col("node").alias("rep"), "root")
    final = stash(sets.join(linked, "rep", "left").select("p1", "p2", F.coalesce("root", "rep").alias("c"), F.col("copies").alias("n")), "components")
    # Rows of one id with different texts: each text's component, joined through the id.
    null = lambda c: F.when(c != F.lit(_NULL), c)
    held = measured.withColumnRenamed("n", "size")
    found = meet(held.filter("size > 0"), final, ["p1", "p2"]).select("k", "size", "c")
    every = found.unionAll(held.filter("size = 0").select("k", "size", F.col("k").alias("c")))
    return every.select(null(F.col("k")).alias("doc_id"), F.col("size").alias("n_shingles"), null(F.col("c")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """`docs`, all columns, with one document of each near-duplicate group: that of the smallest doc_id, once.

    Rows that share a doc_id, or have none, with different texts are documents of their own.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]  # no name of docs can clash with those used here
    own_id, own_text = (plain[names.index(c)] for c in ("doc_id", "text"))
    rows, keys = docs.toDF(*plain), row_keys(docs)
    if keys is None:
        keyed = rows.withColumn("row", doc_key(own_id))
    else:
        told = keys.select(F.col("k").alias("row"), "d", "h")
        keyed = rows.withColumns({"d": doc_key(own_id), "h": text_key(own_text)}).join(told, ["d", "h"])
    groups = stash(near_duplicates(keyed.select(F.col("row").alias("doc_id"), F.col(own_text).alias("text")), percent, k), "near-duplicates")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    ids = lambda which: groups.filter(which).select(F.coalesce("doc_id", F.lit(_NULL)).alias("row"))
    # The fewer of both go to every task, so that texts are not shuffled.
    fewer = groups.agg(F.count_if(kept) < F.count_if(~kept)).first()[0]
    left = _of_ids(keyed, "row", ids(kept)) if fewer else _of_ids(keyed, "row", ids(~kept), "left_anti")
    return (left if keys is None else left.dropDuplicates(["row"])).select(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))
