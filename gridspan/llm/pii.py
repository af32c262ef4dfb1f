"""Personal data by candidate generation and gradient-boosted trees.

The base kinds are found by fixed rules and always count. Generators of high
recall propose further, possibly overlapping spans; boosted trees judge each by
its format and by the words around it; what passes its kind's calibrated
threshold is taken, the most probable first among overlapping ones. There are
no labelled spans to learn from, so the trees learn from candidates whose kind
is known: base spans of the corpus written in a form that no base rule finds
(a phone number without its country, an address with (at) for @), candidates of
the corpus that are certainly something else (within an address of a machine or
a card number, or of a card's form with a wrong check digit), and, for kinds
that the corpus may lack, 3,000 that a seeded rule writes. The sample of the
corpus is bounded: of each kind and truth those of the smallest hashes.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .store import small_batches, tidy

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "id_number", "iban", "email_words", "ipv6")
KINDS = BASE + ADDED
#: Candidates of the corpus of each kind and truth that the trees learn from at most, and the parts in which they are chosen.
SAMPLE, SAMPLE_PARTS = 1_024, 32

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin within a run of digits: the run's first digit would have begun it.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so that long words without one cost nothing."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = low + len(text[low:at].rstrip(_LOCAL))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            low = m.end()
        at = text.find("@", low)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
        found.sort()
    return found


#: Kind, what a text must hold for the generator to run, and the generator.
_GENERATORS = (
    (4, "0123456789", re.compile(r"(?<![0-9.+-])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")),
    (5, "0123456789", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    (6, "0123456789", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    (7, None, re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,12}(?![A-Za-z])")),
    (8, ":", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
)
_ASKED = re.compile(r"(?i)\b(?:t[eé]l|phone|call|fax|mobil|tel[eé]fono?|ssn|social|iban|konto|account|cuenta|compte|mail|contact|kontakt|write|host|server|ip|address)")
_OTHER = re.compile(r"(?i)\b(?:order|isbn|version|date|page|no|item|part|invoice|id|score|since|from|chapter|time|at)\b")


def proposals(text: str, digits: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the generators propose; spans may overlap."""
    found = []
    for kind, needs, pattern in _GENERATORS:
        if (needs == ":" and text.count(":") < 3) or (needs and needs != ":" and not digits):
            continue
        if kind == 7 and not ("dot)" in text or "dot]" in text or " dot " in text):
            continue
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    return found


def _mod97(text: str) -> bool:
    moved = text.replace(" ", "")
    moved = moved[4:] + moved[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def describe(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context features of a candidate."""
    span, before = text[start:end], text[max(0, start - 32) : start]
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    kinds = lambda c: 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3 if c in "$€£#%" else 4
    first = int(groups[0]) if groups and len(groups[0]) <= 4 else -1
    date = len(groups) == 3 and (1900 <= first <= 2100 or 1900 <= int(groups[-1][:4]) <= 2100)
    return [
        kind, end - start, len(digits), sum(c.isalpha() for c in span), sum(not c.isalnum() for c in span), len(groups), max(sizes), min(sizes),
        len(set(digits)), "(" in span or "[" in span, kinds(before[-1:]), kinds(text[end : end + 1]), bool(_ASKED.search(before)), bool(_OTHER.search(before)),
        _mod97(span) if kind == 6 else digits[:3] not in ("000", "666") and digits[:1] != "9" if kind == 5 else 0, date, span[:1] in "(0", "/" in span, "." in span,
    ]


class Trees:
    """Boosted regression trees of depth 3 for log-odds, then a calibrated probability."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 10):
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        half = np.arange(len(y)) % 5 < 3  # the rest calibrates
        self.start, self.trees = float(np.log(y[half].mean() / (1 - y[half].mean()))), []
        score = np.full(half.sum(), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x[half], y[half] - p, p * (1 - p), self.depth)
            self.trees.append(tree)
            score += self.rate * self._walk(tree, x[half])
        self.slope, self.shift = self._calibrate(self.score(x[~half]), y[~half])
        self.threshold = self._thresholds(x[~half], y[~half])
        return self

    def _grow(self, x, gradient, weight, depth):
        leaf = float(gradient.sum() / (weight.sum() + 1.0))
        if not depth or len(x) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        whole = gradient.sum() ** 2 / (weight.sum() + 1.0)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, g, w = x[order, f], np.cumsum(gradient[order]), np.cumsum(weight[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= self.least) & (len(v) - cut - 1 >= self.least)]
            if len(cut):
                gain = g[cut] ** 2 / (w[cut] + 1.0) + (g[-1] - g[cut]) ** 2 / (w[-1] - w[cut] + 1.0) - whole
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], f, (v[cut[k]] + v[cut[k] + 1]) / 2)
        if best[1] is None:
            return leaf
        low = x[:, best[1]] <= best[2]
        return best[1], float(best[2]), self._grow(x[low], gradient[low], weight[low], depth - 1), self._grow(x[~low], gradient[~low], weight[~low], depth - 1)

    def _walk(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        low = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[low], out[~low] = self._walk(tree[2], x[low]), self._walk(tree[3], x[~low])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum(self._walk(t, x) for t in self.trees)

    @staticmethod
    def _calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        """Slope and shift of a logistic curve, by Newton's method with a little shrinkage."""
        a = np.array([1.0, 0.0])
        design = np.stack([score, np.ones(len(score))], axis=1)
        for _ in range(25):
            p = 1 / (1 + np.exp(-design @ a))
            hessian = design.T @ (design * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2)
            a = a + np.linalg.solve(hessian, design.T @ (y - p) - 1e-2 * (a - [1.0, 0.0]))
        return float(a[0]), float(a[1])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.score(x) + self.shift)))

    def _thresholds(self, x: np.ndarray, y: np.ndarray, precision: float = 0.98) -> dict[int, float]:
        """For each kind the least probability from which on the wanted precision holds; half at least."""
        out = {}
        for kind in range(len(BASE), len(KINDS)):
            mine = x[:, 0] == kind
            p = self.probability(x[mine]) if mine.any() else np.empty(0)
            right = y[mine]
            fit = [t for t in np.unique(p) if t >= 0.5 and right[p >= t].mean() >= precision]
            out[kind] = float(fit[0]) if fit else 1.1
        return out


def examples(n: int = 3000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of known kind in a line of text: personal data after fitting words, look-alikes after others.

    After a word that asks for it, what has the form is personal data: a look-alike there has another form.
    """
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8)))

    def iban(right: bool) -> str:
        body, land = d(4 * rng.randint(3, 5)), rng.choice(["DE", "FR", "ES", "GB"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        whole = f"{land}{(check if right else (check + rng.randint(1, 90)) % 97):02d}{body}"
        return " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)) if rng.random() < 0.5 else whole

    asked = {4: ["tel", "phone", "call", "fax", "tél", "teléfono", "mobil"], 5: ["ssn", "social"], 6: ["iban", "konto", "account"], 7: ["mail", "contact", "write"], 8: ["host", "server", "ip"]}
    other = ["order", "isbn", "version", "date", "page", "item", "invoice", "score", "chapter", "time", "the", "of"]
    rows, truth = [], []
    while len(rows) < n:
        kind, real = rng.randint(4, 8), rng.random() < 0.5
        likely = rng.random() < (0.7 if real else 0.1)
        if kind == 4:
            span = rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"0{d(2)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(3)} {d(3)}"]) if real else rng.choice(
                [f"{rng.randint(1950, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", f"{d(2)}.{d(2)}.{rng.randint(1950, 2030)}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(4)} {d(4)} {d(4)}", f"{d(2)}.{d(3)}.{d(2)}", *([] if likely else [f"{d(3)}-{d(3)}-{d(4)}"])]
            )
        elif kind == 5:
            span = f"{rng.randint(100, 899)}-{d(2)}-{d(4)}" if real else rng.choice([f"{rng.choice(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}", *([] if likely else [f"{d(3)}-{d(2)}-{d(4)}"])])
        elif kind == 6:
            span = iban(real)
        elif kind == 7:
            at, dot = rng.choice([("(at)", "(dot)"), ("[at]", "[dot]")]) if real else (" at ", " dot ")
            span = f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}" if real else f"{word()}{at}{word()}{dot}{word()}"
        else:
            span = ":".join(f"{rng.randint(4096, 65535):x}" for _ in range(8)) if real else ":".join(d(2) for _ in range(rng.randint(4, 6)))
        cue = rng.choice(asked[kind]) if likely else word() if real or rng.random() < 0.3 else rng.choice(other)
        text = f"{word()} {word()} {cue}{rng.choice([': ', ' '])}{span}{rng.choice(['', '.', ' ' + word()])}"
        start = text.rindex(span)
        rows.append(describe(text, start, kind, start + len(span)))
        truth.append(real and (kind != 4 or likely or "(" in span or span[0] == "0"))
    return np.array(rows, float), np.array(truth, float)


def _overlap(spans: list[tuple[int, int, int]]):
    """A test of (start, end): does any of the spans, in order of start, overlap it?"""
    starts, reach = [s[0] for s in spans], list(accumulate((s[2] for s in spans), max))
    return lambda start, end: (n := bisect_left(starts, end)) > 0 and reach[n - 1] > start


def known_candidates(text: str) -> Iterator[tuple[int, int, str, int, int]]:
    """(kind, truth, line, start, end): what the base spans of a text and the candidates beside them teach."""
    if not _DIGIT.search(text) and "@" not in text:
        return
    base = base_spans(text)
    around = lambda a, span, b: (text[max(0, a - 32) : a], span, text[b : b + 16])
    lines = []
    for a, kind, b in base:
        span = text[a:b]
        if kind == 3:
            lines.append((4, 1, around(a, re.sub(r"^\+[0-9]{1,3}[ .-]+", "", span), b)))
        elif kind == 0:
            name, host = span.split("@", 1)
            at, dot = ("(at)", "(dot)") if len(span) % 2 else (" [at] ", " [dot] ")
            lines.append((7, 1, around(a, name.lstrip("%+-._") + at + dot.join(host.split(".")[-2:]), b)))
        elif kind == 2:
            digits = "".join(_DIGIT.findall(span))
            wrong = digits[:-1] + str((int(digits[-1]) + 1) % 10)
            lines.append((4, 0, around(a, " ".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)), b)))
    other = _overlap([s for s in base if s[1] in (1, 2)])
    for a, kind, b in proposals(text, True):
        if other(a, b):
            lines.append((kind, 0, around(a, text[a:b], b)))
    for kind, truth, (before, span, after) in lines:
        line, start = before + span + after, len(before)
        if (start, kind, start + len(span)) in proposals(line, True):
            yield kind, truth, line, start, start + len(span)


_KNOWN = "part int, place long, kind int, truth int, line string, start int, end int"


def _sample(find: bool, most: int, parts: int):
    """Of each kind, truth and part of the hashes, the `most` candidates of the smallest hash; from texts, or from rows of candidates."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}
        seen: set[int] = set()
        for batch in batches:
            if find:
                rows = (x for text in batch.column(0).to_pylist() if text for x in known_candidates(text))
            else:
                rows = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)
            for kind, truth, *rest in rows:
                place = int.from_bytes(hashlib.blake2b(repr((kind, truth, rest)).encode(), digest_size=8).digest(), "little") >> 1
                heap = held.setdefault((kind, truth, place % parts), [])
                if place in seen or (len(heap) == most and -place < heap[0][0]):
                    continue
                seen.add(place)
                gone = heapq.heappushpop(heap, (-place, rest)) if len(heap) == most else heapq.heappush(heap, (-place, rest))
                if gone:
                    seen.discard(-gone[0])
        rows = [(part, -p, kind, truth, *rest) for (kind, truth, part), heap in held.items() for p, rest in heap]
        if rows:
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _KNOWN.split(", ")])

    return run


def corpus_examples(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and truths of known candidates of the corpus, SAMPLE of each kind and truth at most, in order of their hashes."""
    small_batches(docs.sparkSession)
    mine = docs.select("text").mapInArrow(tidy(_sample(True, SAMPLE // SAMPLE_PARTS, SAMPLE_PARTS)), _KNOWN)
    chosen = mine.repartition(SAMPLE_PARTS, "part").mapInArrow(tidy(_sample(False, SAMPLE // SAMPLE_PARTS, SAMPLE_PARTS)), _KNOWN)
    rows = sorted((r.place, r.kind, r.truth, r.line, r.start, r.end) for r in chosen.collect())
    x = [describe(line, start, kind, end) for _, kind, _, line, start, end in rows]
    return np.array(x, float).reshape(len(rows), len(describe("1", 0, 4, 1))), np.array([r[2] for r in rows], float)


def known_examples(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All that is known to learn from: written candidates and those of the corpus, mixed."""
    parts = [examples(), corpus_examples(docs)]
    x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.random.default_rng(5).permutation(len(y))
    return x[order], y[order]


def train(docs: DataFrame) -> Trees:
    return Trees().fit(*known_examples(docs))


def held_out_figures(docs: DataFrame) -> dict[str, tuple[int, float, float]]:
    """For each added kind: candidates that are kept from learning, every fifth, and precision and recall on them."""
    x, y = known_examples(docs)
    out = np.arange(len(y)) % 5 == 0
    trees = Trees().fit(x[~out], y[~out])
    x, y, found = x[out], y[out], {}
    taken = trees.probability(x) >= np.array([trees.threshold[int(k)] for k in x[:, 0]])
    for kind in range(len(BASE), len(KINDS)):
        mine = x[:, 0] == kind
        right = float((taken & mine & (y == 1)).sum())
        found[KINDS[kind]] = int(mine.sum()), right / max((taken & mine).sum(), 1), right / max((mine & (y == 1)).sum(), 1)
    return found


class Finder:
    """Base spans and what the trees add to them."""

    def __init__(self, trees: Trees):
        self.trees = trees

    def find(self, texts: list[str | None]) -> list[tuple[list, list]]:
        """For each text its base spans and all its spans, (start, kind, end) in order."""
        found, rows, where = [], [], []
        for k, text in enumerate(texts):
            base = base_spans(text) if text else []
            found.append((base, base))
            if not text:
                continue
            taken = _overlap(base)
            for s in proposals(text, bool(_DIGIT.search(text))):
                if not taken(s[0], s[2]):
                    rows.append(describe(text, *s))
                    where.append((k, s))
        if rows:
            p = self.trees.probability(np.array(rows, float))
            added: dict[int, list] = {}
            for i in sorted(range(len(rows)), key=lambda i: (where[i][0], -p[i], where[i][1])):
                k, s = where[i]
                if p[i] < self.trees.threshold[s[1]]:
                    continue
                mine = added.setdefault(k, [])
                n = bisect_left(mine, s)
                # They don't overlap each other, so only the nearest on each side can overlap one more.
                if (n == len(mine) or mine[n][0] >= s[2]) and (n == 0 or mine[n - 1][2] <= s[0]):
                    insort(mine, s)
            for k, mine in added.items():
                found[k] = found[k][0], sorted(found[k][0] + mine)
        return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each run of overlapping spans becomes the name of its first kind in brackets."""
    if not spans:
        return text
    out, at, n = [], 0, 0
    while n < len(spans):
        start, kind, end = spans[n]
        while n + 1 < len(spans) and spans[n + 1][0] < end:
            n += 1
            end = max(end, spans[n][2])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at, n = end, n + 1
    return "".join([*out, text[at:]])


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(trees: Trees):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(trees)
        for batch in batches:
            found = finder.find(batch.column(1).to_pylist())
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(BASE))]
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([joined(s) for _, s in found], pa.string())], [x.split()[0] for x in FOUND.split(", ")])

    return run


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, counts of the base kinds, base_sha256, spans) for each row of `docs`, in one pass after one for the trees.

    A null text counts as empty; repeated rows get equal results. Added spans
    overlap neither base spans nor each other. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(_scan(train(docs))), FOUND)


def _redactor(trees: Trees, text_at: int, size_at: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(trees)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            new = [redact(t, every) for t, (_, every) in zip(texts, finder.find(texts), strict=True)]
            columns = list(batch.columns)
            columns[text_at] = pa.array(new, batch.schema.field(text_at).type)
            if size_at is not None:
                old = columns[size_at].to_pylist()
                columns[size_at] = pa.array([n if a == b else len(a) for n, a, b in zip(old, new, texts, strict=True)], batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return run


def redact_pii(docs: DataFrame) -> DataFrame:
    """`docs` with the found spans replaced in `text`, and `n_chars`, if there is such a column, set anew where a text changed."""
    small_batches(docs.sparkSession)
    at = docs.columns.index
    return docs.mapInArrow(tidy(_redactor(train(docs), at("text"), at("n_chars") if "n_chars" in docs.columns else None)), docs.schema)
