"""Best-fit packing of token sequences with exact complements first.

Texts become token pieces once, written with their rank among the pieces of
equal length of one task. All that the plan needs is how many pieces each
length has: at most `capacity` numbers, whatever the corpus. The plan takes a
length, looks for one, two or three other lengths that fill its gap exactly
while pieces of them are left, and takes as many such combinations at once as
there are pieces; what remains is placed best-fit. A plan line places a run of
ranks of one length into a run of sequences at one offset, so every piece finds
its place by its length and rank, without meeting other pieces.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, stash, tidy

CAPACITY, END_ID = 2048, 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


#: What a tokenizer must state of itself for its words to be split here (fixed values of the vocabulary file).
_STATED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Characters that count as letters, digits or marks by any edition of the Unicode tables.
_LETTERS = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_SIMPLE = re.compile(rf"(?!.*<\|)[\x21-\x7e{_LETTERS}]+")
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _spelling() -> dict[int, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}


_SPELLING = _spelling()


class WordTokens:
    """Token ids of texts, word by word: no token of this vocabulary spans white space.

    Words are looked up in two generations of a cache, each bounded; what is in
    neither is encoded together with all other new words of a batch.
    """

    ENTRIES = 250_000
    MARK = "\x1e"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        # Kept by the process, so that the next task of this worker starts with it.
        kept = tokenizers.__dict__.setdefault("_word_tokens", {})
        if path not in kept:
            kept[path] = *self._stated(tokenizers.Tokenizer.from_file(path)), {}, {}
        self.tokenizer, self.simple, self.mark, self.spelt, self.new, self.old = kept[path]
        self.marks = _MARKS if self.simple else b".,"

    def _stated(self, tokenizer) -> tuple:
        """The tokenizer, whether it states what words may be split by here, the id of MARK if it has one of its own, and the bytes of each id."""
        stated = json.loads(tokenizer.to_str())
        mark = tokenizer.encode(self.MARK, add_special_tokens=False).ids
        spelt = [k.to_bytes(4, "little") for k in range(max(tokenizer.get_vocab().values()) + 1)]
        return tokenizer, (stated["normalizer"], stated["pre_tokenizer"]) == _STATED, mark[0] if len(mark) == 1 else None, spelt

    def _simple(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of those words that are Latin letters, digits and ASCII marks alone, straight from the model.

        Lower case, the split and the spelling of bytes are those that the
        tokenizer's own description states; without it, or for other
        characters, the tokenizer does all the work.
        """
        model, spelt, found = self.tokenizer.model.tokenize, self.spelt, {}
        # White space ends any sequence of bytes, so decoding all words at once is decoding each.
        for word, text in zip(words, b" ".join(words).decode("utf-8", "replace").split(" ") if words else (), strict=True):
            if text.isascii() and text.isalpha():
                found[word] = b"".join([spelt[t.id] for t in model(text.lower())])
            elif _SIMPLE.fullmatch(text):
                found[word] = b"".join([spelt[t.id] for part in _SPLIT.findall(text.lower()) for t in model(part if part.isascii() else part.encode().decode("latin-1").translate(_SPELLING))])
        return found

    def _plain(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        if self.simple:
            known = self._simple(words)
            return known | self._encode_joined([w for w in words if w not in known])
        return self._encode_joined(words)

    def _encode_joined(self, words: list[bytes]) -> dict[bytes, bytes]:
        joined = [w for w in words if self.mark is not None and b"\x1e" not in w]
        found = {}
        if joined:
            text = b" \x1e ".join(joined).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) == len(joined) - 1:
                bounds = zip([0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)], strict=True)
                found = {w: ids[a:b].tobytes() for w, (a, b) in zip(joined, bounds, strict=True)}
        return found | {w: self._plain(w) for w in words if w not in found}

    def fill(self, words: set[bytes]) -> dict[bytes, bytes]:
        """A table of `words` alone, so small that it stays in the processor's cache while texts are looked up."""
        missing = words.difference(self.new)
        if len(self.new) + len(missing) > self.ENTRIES:
            self.old.clear()
            self.old.update(self.new)
            self.new.clear()
            missing = words
        if self.old:
            self.new.update({w: self.old[w] for w in missing.intersection(self.old)})
        # Marks that end a word after an ASCII letter are a part of their own; of any split, a comma or full stop.
        plain, tails = set(), {}
        for w in missing.difference(self.new):
            stem = w.rstrip(self.marks)
            if len(stem) < len(w) and stem[-1:].isalpha() and b"<|" not in w and (self.simple or len(stem) == len(w) - 1):
                tails[w] = len(stem)
                plain.add(stem)
                plain.add(w[len(stem) :])
            else:
                plain.add(w)
        self.new.update(self._encode(list(plain.difference(self.new))))
        new = self.new
        for w, n in tails.items():
            new[w] = new[w[:n]] + new[w[n:]]
        return {w: new[w] for w in words}


def _tokenise(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(path)
        task, nth = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            row, out = 0, []
            while row < len(texts):
                # Some megabytes at a time: the table must hold all words of what is joined next.
                first, size, words = row, 0, []
                while row < len(texts) and (size < 1 << 20 or row == first):
                    size += len(texts[row] or b"")
                    # Splits at six ASCII characters that the tokenizer drops as white space. Lower case
                    # is the tokenizer's own; done here it makes equal words of more, but "<|" may begin
                    # a special token, whose case counts.
                    text = texts[row] or b""
                    words.append((text if b"<|" in text else text.lower()).split())
                    row += 1
                table = tokens.fill(set().union(*words))
                for k, mine in enumerate(words, first):
                    blob = b"".join([table[w] for w in mine]) + end
                    for piece, a in enumerate(range(0, len(blob), 4 * capacity)):
                        part = blob[a : a + 4 * capacity]
                        n = len(part) // 4
                        out.append((ids[k], piece, a // 4, n, zlib.crc32(part), task, int(nth[n])))
                        nth[n] += 1
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def plan(counts: np.ndarray) -> np.ndarray:
    """Rows (length, first rank, n, first sequence, offset): n pieces of one length, by rank, go to n sequences.

    counts[L]: the pieces of length L, for L from 0 (none) to the capacity.
    """
    capacity = len(counts) - 1
    left, used = counts.astype(np.int64).copy(), np.zeros(capacity + 1, np.int64)
    lines: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        lines.append((length, int(used[length]), n, sequence, offset))
        used[length] += n
        left[length] -= n

    def fill(combination: list[int]) -> None:
        nonlocal sequences
        n = min(int(left[x]) // combination.count(x) for x in combination)
        offset = 0
        for x in combination:
            put(x, n, sequences, offset)
            offset += x
        sequences += n

    def pair(total: int, taken: list[int]) -> list[int] | None:
        """Two lengths of this sum, the larger as large as can be, besides those taken."""
        if total < 2:
            return None
        free = left.copy()
        for x in taken:
            free[x] -= 1
        big = np.arange(min(total - 1, capacity), (total - 1) // 2, -1)
        fits = big[(free[big] > 0) & (free[total - big] > np.where(2 * big == total, 1, 0))]
        return [int(fits[0]), total - int(fits[0])] if len(fits) else None

    def complement(length: int) -> list[int] | None:
        gap = capacity - length
        if left[gap] > (gap == length):
            return [gap]
        if found := pair(gap, [length]):
            return found
        for first in np.flatnonzero(left[1 : max(gap - 1, 1)] > 0)[::-1] + 1:
            if left[first] > (first == length) and gap - first >= 2 and (found := pair(gap - int(first), [length, int(first)])):
                return [int(first), *found]
        return None

    if left[capacity]:
        fill([capacity])
    for length in range(capacity - 1, 0, -1):
        while left[length] and (found := complement(length)):
            fill([length, *found])

    open_: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap and n:
            if gap not in open_:
                bisect.insort(gaps, gap)
            open_.setdefault(gap, []).append((sequence, n))

    for length in range(capacity - 1, 0, -1):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                sequence, n = open_[gap].pop()
                if not open_[gap]:
                    del open_[gap], gaps[at]
                m = min(n, int(left[length]))
                put(length, m, sequence, capacity - gap)
                leave(gap, sequence + m, n - m)
                leave(gap - length, sequence, m)
            else:
                each = capacity // length
                n = max(int(left[length]) // each, 1)
                for k in range(min(each, int(left[length]))):
                    put(length, n, sequences, k * length)
                leave(capacity - (lines[-1][4] + length), sequences, n)
                sequences += n
    return np.array(lines, np.int64).reshape(-1, 5)


def _place(lines: np.ndarray):
    order = np.lexsort((lines[:, 1], lines[:, 0]))
    lines = lines[order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = np.int64(1) << 40
        keys = lines[:, 0] * base + lines[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(i)) for i in (3, 5))
            line = lines[np.searchsorted(keys, length * base + rank, "right") - 1]
            found = [pa.array(line[:, 3] + rank - line[:, 1], pa.int64()), pa.array(line[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of `docs`.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they occur; only texts of more than `capacity` ids are cut. An empty
    table gives no pieces. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as binary) text")
    found = stash(rows.mapInArrow(tidy(_tokenise(tokenizer_path, capacity)), PIECES), "pieces")
    each = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in each.groupBy("length").agg(F.sum("n")).collect():  # at most one row a length
        counts[length] = n
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = found.join(base, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInArrow(tidy(_place(plan(counts))), schema)
