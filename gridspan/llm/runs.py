"""Periodic runs: stretches of words that repeat a shorter stretch several times over, found and collapsed.

Crochemore's partition refinement, over all texts of a batch at once. At level l
the places of a text are in classes: two places are in one class if the same l
words start there. A level comes from the one before: a class is divided by the
classes that the next places are in, and only the smaller parts of classes that
were divided need to be looked at, as the largest part divides nothing that they
don't. So every place moves a logarithmic number of times. Classes keep their
members linked in order: members next to each other at a distance of l at level l
are a square of period l whose root is no power; TIMES of them on end are seeds
of a run, and seeds at neighbouring places are merged to runs. Classes with
fewer than TIMES members can hold no seed and are not divided any more.

Every text is handled by one task and nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches, tidy
from .text import Shingler, column_bytes

#: Words of a run at least, and how often a run has its period at least.
LEAST, TIMES = 24, 3
#: Levels at which all places are looked at for seeds; later, only those whose distance is due.
SCANNED = 16
_WORDS = Shingler(1, fold_case=False)


class Classes:
    """The classes of places, each a slice of `members`; and each place's neighbours in its class."""

    def __init__(self, key: np.ndarray):
        """key: places with equal keys are in one class."""
        n = len(key)
        self.members = np.argsort(key, kind="stable")
        self.at = np.empty(n, np.int64)
        self.at[self.members] = np.arange(n)
        ordered = key[self.members]
        first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if n else np.empty(0, np.int64)
        self.count = len(first)
        self.start, self.size = np.zeros(2 * n + 2, np.int64), np.zeros(2 * n + 2, np.int64)
        self.start[: self.count], self.size[: self.count] = first, np.diff(np.append(first, n))
        self.of = np.empty(n, np.int64)
        self.of[self.members] = np.repeat(np.arange(self.count), self.size[: self.count])
        self.next, self.last, self.slot = np.full(n, -1), np.full(n, -1), np.zeros(n, np.int64)
        heads = np.zeros(n, bool)
        heads[first] = True
        self._link(self.members, heads)

    def _link(self, places: np.ndarray, heads: np.ndarray) -> None:
        """Places in order within each class; heads: where a class begins."""
        if len(places):
            self.last[places[0]], self.next[places[-1]] = -1, -1
            same = ~heads[1:]
            self.next[places[:-1]] = np.where(same, places[1:], -1)
            self.last[places[1:]] = np.where(same, places[:-1], -1)

    def divide(self, due: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Divides the classes of the places before those in `due` by the classes of these.

        due: all members of some classes. Returns all members of the smaller
        parts of divided classes, and the places whose next neighbour changed.
        """
        none = np.empty(0, np.int64)
        places = np.sort(due) - 1
        places = places[places >= 0]
        places = places[self.size[self.of[places]] >= least]
        if not len(places):
            return none, none
        owner, by = self.of[places], self.of[places + 1]
        order = np.argsort(owner * (self.count + 1) + by, kind="stable")  # by class, then by the next place's class, then by place
        places, owner, by = places[order], owner[order], by[order]
        group = np.concatenate([[True], (owner[1:] != owner[:-1]) | (by[1:] != by[:-1])])
        first = np.flatnonzero(group)
        number = np.diff(np.append(first, len(places)))
        whose = owner[first]
        top = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))  # of the groups of each class
        left = self.size[whose[top]] - np.add.reduceat(number, top)
        # Where all members would go, the largest group stays.
        of_class = np.repeat(np.arange(len(top)), np.diff(np.append(top, len(first))))
        rank = np.lexsort((-number, of_class))[top]
        stays = np.zeros(len(first), bool)
        stays[rank[left == 0]] = True
        left = np.where(left == 0, number[rank], left)
        if stays.any():
            goes = ~stays[np.repeat(np.arange(len(first)), number)]
            places, owner = places[goes], owner[goes]
            first, number, whose, of_class = (x[~stays] for x in (first, number, whose, of_class))
            if not len(places):
                return none, none
            first = np.concatenate([[0], np.cumsum(number)[:-1]])
        classes = np.unique(of_class)
        left, moved = left[classes], np.bincount(of_class, number)[classes].astype(np.int64)
        olds = whose[np.searchsorted(of_class, classes)]
        # Out of the old chains: what stays before and after each stretch of leaving neighbours is linked.
        chain = np.argsort(owner * len(self.of) + places, kind="stable")
        in_order, ranked = places[chain], owner[chain]
        broken = np.concatenate([[True], self.next[in_order[:-1]] != in_order[1:]])
        ends = np.flatnonzero(np.append(broken[1:], True))
        before, after = self.last[in_order[broken]], self.next[in_order[ends]]
        real = before >= 0
        self.next[before[real]] = after[real]
        real2 = after >= 0
        self.last[after[real2]] = before[real2]
        # The slice's end takes those that leave; who was there and stays takes their old places.
        slots = np.repeat(self.start[olds] + left - np.concatenate([[0], np.cumsum(moved)[:-1]]), moved) + np.arange(len(places))
        border = np.repeat(self.start[olds] + left, moved)
        there = self.members[slots]
        leaving = np.zeros(len(slots), bool)
        spot = self.at[in_order]
        inside = spot >= border
        self.slot[slots] = np.arange(len(slots))
        leaving[self.slot[spot[inside]]] = True
        settled, holes = there[~leaving], spot[~inside]
        self.members[holes] = settled
        self.at[settled] = holes
        self.members[slots] = places
        self.at[places] = slots
        new = self.count + np.arange(len(first))
        if new[-1] >= len(self.start):
            more = np.zeros(len(self.start), np.int64)
            self.start, self.size = np.concatenate([self.start, more]), np.concatenate([self.size, more])
        self.start[new], self.size[new] = slots[first], number
        self.size[olds] = left
        self.of[places] = np.repeat(new, number)
        self.count += len(first)
        heads = np.zeros(len(places), bool)
        heads[first] = True
        self._link(places, heads)
        # All parts of a class but its largest are smaller ones.
        back = np.searchsorted(classes, of_class)
        largest = np.lexsort((-number, back))[np.searchsorted(back, np.arange(len(classes)))]
        outweighs = number[largest] > left
        small = np.ones(len(first), bool)
        small[largest[outweighs]] = False
        remain, size = self.start[olds[outweighs]], left[outweighs]
        rest = np.repeat(remain - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else none
        return np.concatenate([places[np.repeat(small, number)], self.members[rest]]), np.concatenate([before[real], places])


def runs_of(words: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in order of text, start and period.

    words: numbers that tell the words apart; at: where each text begins, and the end of the last.
    """
    found = [np.empty((0, 4), np.int64)]
    size = np.diff(at)
    long = np.flatnonzero(size >= max(least, times))
    if not len(long):
        return found[0]
    # Places of the texts that are long enough, and one after each text where nothing starts.
    begin = np.concatenate([[0], np.cumsum(size[long] + 1)])
    text = np.repeat(np.arange(len(long)), size[long] + 1)
    after = begin[1:] - 1
    real = np.ones(begin[-1], bool)
    real[after] = False
    inner = np.arange(begin[-1]) - begin[text]
    key = np.empty(begin[-1], np.int64)
    own = words[(at[long][text] + inner)[real]]
    most = int(own.max()) + 1
    key[real] = text[real] * most + own
    key[after] = len(long) * most + np.arange(len(long))
    classes = Classes(key)
    limit = (size[long] // times)[text]

    def seeds(i: np.ndarray, level: int) -> None:
        """Of places whose next neighbour is `level` away: those followed by more such, merged."""
        i = step = i[limit[i] >= level]
        for _ in range(times - 2):
            step = step + level
            ok = classes.next[step] == step + level
            i, step = i[ok], step[ok]
        if not len(i):
            return
        cut = np.concatenate([[True], np.diff(i) != 1])
        starts, ends = i[cut], i[np.append(cut[1:], True)]
        length = ends - starts + times * level
        keep = length >= least
        row = text[starts[keep]]
        found.append(np.stack([long[row], starts[keep] - begin[row], length[keep], np.full(keep.sum(), level)], axis=1))

    level, due, waiting = 1, np.arange(len(key)), defaultdict(list)
    everywhere = np.arange(len(key))
    while True:
        if level <= SCANNED:
            seeds(np.flatnonzero(classes.next - everywhere == level), level)
        elif level in waiting:
            i = np.unique(np.array(waiting.pop(level), np.int64))
            seeds(i[classes.next[i] - i == level], level)
        due = due[limit[due] > level]
        if not len(due):
            break
        due, changed = classes.divide(due, times)
        level += 1
        if level == SCANNED:
            changed = np.flatnonzero((classes.next >= 0) & (classes.size[classes.of] >= times))
        if level >= SCANNED:
            gap = classes.next[changed] - changed
            soon = (gap > level) & (gap <= limit[changed])
            for d, i in zip(gap[soon].tolist(), changed[soon].tolist(), strict=True):
                waiting[d].append(i)
        elif not len(due):
            break
    for d in sorted(waiting):
        i = np.unique(np.array(waiting[d], np.int64))
        if d > level:
            seeds(i[classes.next[i] - i == d], d)
    every = np.concatenate(found)
    return every[np.lexsort((every[:, 3], every[:, 1], every[:, 0]))]


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, at: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    before = np.concatenate([[0], np.cumsum(kept)])[at]  # kept words before each text
    starts, ends = starts[kept], ends[kept]
    size = ends - starts + 1
    place = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(place[-1]) + np.repeat(starts - place[:-1], size)
    out = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
    out[place[1:] - 1] = 32
    # The last word of a text is not followed by a space.
    count = np.diff(before)
    last = place[before[1:]][count > 0] - 1
    out = np.delete(out, last)
    bounds = place[before] - np.concatenate([[0], np.cumsum(count > 0)])
    return pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out))])


def _find(least: int, times: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            starts, ends = _WORDS.spans(data, offsets)
            at = np.searchsorted(starts, offsets)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts] = 1
            np.subtract.at(inside, ends, 1)
            flat = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)])
            where = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
            names = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(flat)])
            words = np.asarray(names.dictionary_encode().indices).astype(np.int64)  # words themselves are compared, not hashes
            found = runs_of(words, at, least, times)
            text, start, length, period = found.T
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, at[text] + start + period, 1)
            np.add.at(cover, at[text] + start + length, -1)
            kept = np.cumsum(cover[:-1]) == 0
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(x) for x in (start.copy(), length.copy(), period.copy())], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(bounds), rows), _collapsed(data, starts, ends, kept, at)], ["doc_id", "runs", "collapsed"])

    return run


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, runs, collapsed) for each row of `docs`.

    runs: (start, length, period) of each stretch of at least `least` words and
    `times` (2 or more) periods that no neighbouring word extends, period being
    its smallest, in order of start and period; words are counted from 0.
    collapsed: the words that no run contains after its first period, joined by a
    space. A null or empty text, or one of few words, has no runs and collapses
    to its words. Repeated rows and rows without a doc_id count each; an empty
    table gives no rows; other columns are not looked at. A text is handled
    whole, however long: it takes some 150 bytes of a task's memory for each word.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_find(least, times)), "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the checksum of its id, gets a periodic end made of its own words; a null id is never one."""
    check = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(check % 10 == 0, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    told = docs.select("doc_id", "text", words.alias("words"), F.floor(check / 10).cast("long").alias("g")).withColumn("n", F.size("words").cast("long"))
    told = told.withColumn("a", F.col("g") % F.col("n")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = (F.col("n") - F.col("a")).cast("int")
    again = F.flatten(F.array_repeat(F.slice("words", (F.col("a") + 1).cast("int"), F.col("p")), F.ceil(tail / F.col("p")).cast("int")))
    made = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(again, F.lit(1), tail))
    return told.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
