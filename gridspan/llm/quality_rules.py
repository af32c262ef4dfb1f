"""Quality rules as weak supervision.

Each rule votes good (1), weakly bad (-1) or badly (-2) on a document, or
abstains (0). A label model says how likely each vote is in each of several
hidden classes: good documents, and one kind of junk for each rule, the one it
knows. Expectation-maximisation estimates the classes' shares and votes from
how often each pattern of votes occurs in the whole corpus. The posterior
probability of the good class replaces a filter that all rules must pass:
a bad vote that good documents often have, beside good votes, is a blemish.
Patterns are counted by a distributed aggregation; there are at most 4^8 of
them, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import small_batches, stash, tidy
from .text import U64, Shingler, column_bytes, mix, pieces, sums

#: (rule, what it looks at, good if at or beyond, bad if beyond, very bad if beyond). Shares are of words, lines or
#: letters. Every rule abstains between its bounds and where it has nothing to look at.
RULES = {
    "length": ("n_words", (">=", 80), ("<", 50), 25),
    "word_length": ("mean_word", ("<=", 10.0), (">", 16.0), 24.0),
    "symbols": ("symbol_share", ("<=", 0.02), (">", 0.1), 0.25),
    "repeats": ("repeat_share", ("<=", 0.1), (">", 0.3), 0.5),
    "lines": ("dup_share", ("<=", 0.1), (">", 0.5), 0.8),
    "capitals": ("upper_share", ("<=", 0.2), (">", 0.5), 0.8),
    "shouting": ("shout_share", ("<=", 0.05), (">", 0.3), 0.6),
    "tables": ("bar_share", ("<=", 0.02), (">", 0.15), 0.3),
}

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_shouts long, n_bars long"
_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def _table(characters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(characters)] = True
    return found


class Meter:
    """Counts of whole texts, many at a time."""

    def __init__(self):
        self.triples = Shingler(3, fold_case=False)
        self.lines = Shingler(1, fold_case=False, gaps=(10,))
        self.symbols = _table(b"#*$%&|<>")
        self.upper = _table(bytes(range(65, 91)))
        self.letters = self.upper | _table(bytes(range(97, 123)))
        self.points = np.ones(256, bool)
        self.points[0x80:0xC0] = False

    def measure(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of FEATURES for each text."""
        words, where = self.triples.words(data, at)
        n_words = np.diff(where)
        inside = self.triples.inside[data]
        shout = data == ord("!")
        bar = data == ord("|")
        return np.stack(
            [
                n_words,
                sums(inside & self.points[data], at),
                sums(self.symbols[data], at),
                *self._lines(data, at),
                self._repeats(words, where),
                sums(self.upper[data], at),
                sums(self.letters[data], at),
                sums(shout, at),
                sums(bar, at),
            ]
        )[[0, 1, 2, 3, 5, 4, 6, 7, 8, 9]]

    def _lines(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word that equal an earlier one, and all lines with a word, by text."""
        starts, ends = self.lines.spans(data, at)
        hashes, where = self.lines.words(data, at)
        total = np.concatenate([[0], np.cumsum(self.triples.inside[data])])
        real = total[ends] > total[starts]
        rows = np.repeat(np.arange(len(at) - 1), np.diff(where))
        _, first = np.unique(mix(hashes + rows.astype(U64) * U64(0x9E3779B97F4A7C15))[real], return_index=True)
        n = np.bincount(rows[real], minlength=len(at) - 1)
        return n - np.bincount(rows[real][first], minlength=len(at) - 1), n

    def _repeats(self, words: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Words within 3-word windows that the text has twice or more."""
        if len(words) < 3:
            return np.zeros(len(where) - 1, np.int64)
        rows = np.repeat(np.arange(len(where) - 1), np.diff(where))
        whole = rows[:-2] == rows[2:]
        key = words[:-2] * U64(3) + words[1:-1]
        key = mix(mix(key) + words[2:] + rows[:-2].astype(U64) * U64(0x9E3779B97F4A7C15))[whole]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        start = np.flatnonzero(whole)[twice]
        covered = np.zeros(len(words), bool)
        for j in range(3):
            covered[start + j] = True
        return sums(covered, where)


def _measurer(text_at: int, carry: list[int], names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter()
        for batch in batches:
            data, offsets = column_bytes(batch.column(text_at))
            parts = [meter.measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in pieces(offsets)]
            values = np.concatenate(parts, axis=1) if parts else np.zeros((len(_NAMES), 0), np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in carry), *(pa.array(v, pa.int64()) for v in values)], [*names, *_NAMES])

    return run


def features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every whole text; null counts as no text."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(tidy(_measurer(1, [0], ["doc_id"])), f"doc_id long, {FEATURES}")


def votes() -> dict[str, Column]:
    """Each rule's vote as an expression over FEATURES."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    symbols = share("n_symbols", "n_words")
    looks = {
        "n_words": F.col("n_words"),
        "mean_word": share("word_chars", "n_words"),
        # A few bars are for the rule of their own; counted twice, one blemish would look like two.
        "symbol_share": F.when(symbols > RULES["symbols"][3], symbols).otherwise(symbols - share("n_bars", "n_words")),
        "repeat_share": share("n_repeat_words", "n_words"),
        "dup_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "n_letters"),
        "shout_share": share("n_shouts", "n_words"),
        "bar_share": share("n_bars", "n_words"),
    }
    beyond = {">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, "<": lambda x, y: x < y}
    found = {}
    for rule, (on, good, bad, very) in RULES.items():
        vote = F.when(beyond[bad[0]](looks[on], very), -2).when(beyond[bad[0]](looks[on], bad[1]), -1)
        found[rule] = vote.when(beyond[good[0]](looks[on], good[1]), 1).otherwise(0).cast("byte")
    return found


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: The votes that a rule can cast, and how often it casts each where it doesn't abstain, before any document is seen:
#: on documents of other classes than its own kind of junk, and on that kind.
LEVELS = (1, -1, -2)
ELSEWHERE, OWN_KIND = (0.98, 0.0195, 0.0005), (0.05, 0.25, 0.7)
#: The share of junk, and how many documents it counts for. The chances above count for WEIGHT documents and as many as
#: their class has: lone bad votes of a rule fit its kind of junk and blemishes equally well, so counts alone don't tell.
JUNK, WEIGHT = 0.1, 20.0


class LabelModel:
    """A good class and one of junk for each rule. In each class, every rule that votes has probabilities of its own for
    each level, which expectation-maximisation estimates together with the classes' shares; an abstention says nothing.
    """

    def __init__(self, rounds: int = 500):
        self.rounds = rounds

    def fit(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """patterns: a row of votes each, in any order; counts: the documents with it."""
        order = np.lexsort(patterns.T[::-1]) if len(patterns) else np.empty(0, int)
        cast, counts = self._cast(patterns[order]), counts[order].astype(float)
        n = patterns.shape[1]
        prior = np.tile(ELSEWHERE, (n + 1, n, 1))
        prior[np.arange(1, n + 1), np.arange(n)] = OWN_KIND
        share = np.array([1 - JUNK] + [JUNK / n] * n)
        self.chance, self.share = prior, share
        for _ in range(self.rounds):
            weights = counts[:, None] * self._classes(cast)
            before = self.chance, self.share
            votes = np.einsum("pc,prl->crl", weights, cast) + (WEIGHT + weights.sum(0))[:, None, None] * prior
            self.chance = votes / votes.sum(2, keepdims=True)
            self.share = (weights.sum(0) + WEIGHT * share) / (counts.sum() + WEIGHT)
            if max(np.abs(self.chance - before[0]).max(), np.abs(self.share - before[1]).max()) < 1e-7:
                break
        return self

    @staticmethod
    def _cast(patterns: np.ndarray) -> np.ndarray:
        """1 where a pattern (first) has a rule (second) vote at a level (third)."""
        return np.stack([patterns == level for level in LEVELS], axis=2).astype(float)

    def _classes(self, cast: np.ndarray) -> np.ndarray:
        """The probability of each class (second) given a pattern (first)."""
        score = np.log(self.share) + np.einsum("prl,crl->pc", cast, np.log(self.chance))
        found = np.exp(score - score.max(1, keepdims=True))
        return found / found.sum(1, keepdims=True)

    def good(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of the good class for rows of votes."""
        return self._classes(self._cast(patterns))[:, 0]

    def posterior(self) -> Column:
        """The probability of the good class as an expression over the votes."""
        start, gain = np.log(self.share[1:] / self.share[0]), np.log(self.chance[1:] / self.chance[0])
        classes, rules = gain.shape[:2]
        # A table of constants, looked up class by class and rule by rule: written out, it would be too much code for one method.
        by_vote = np.zeros((classes, rules, 4))
        by_vote[:, :, [v + 2 for v in LEVELS]] = gain
        table, first = (F.array(*map(F.lit, x.ravel().tolist())) for x in (by_vote, start))
        vote = F.array(*(F.col(rule).cast("int") + 2 for rule in RULES))
        score = lambda c: F.aggregate(F.transform(vote, lambda v, r: table[(c * rules + r) * 4 + v]), first[c], lambda acc, x: acc + x)
        return F.lit(1.0) / F.aggregate(F.sequence(F.lit(0), F.lit(classes - 1)), F.lit(1.0), lambda odds, c: odds + F.exp(score(c)))


def fit_label_model(measured: DataFrame) -> LabelModel:
    """The label model of a whole corpus. Only the counted patterns come to the driver."""
    rows = measured.select(*(v.alias(k) for k, v in votes().items())).groupBy(*RULES).count().collect()
    patterns = np.array([[r[k] for k in RULES] for r in rows], np.int8).reshape(len(rows), len(RULES))
    return LabelModel().fit(patterns, np.array([r["count"] for r in rows], np.int64))


def judge(measured: DataFrame, model: LabelModel, least: float = 0.5) -> DataFrame:
    """`measured` with each rule's vote, base_failed, posterior and kept."""
    voted = measured.withColumns(votes())
    return voted.withColumns({"base_failed": base_failed(), "posterior": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, FEATURES, votes, base_failed, posterior and kept for each row of `docs`.

    An empty or null text has no words, so it fails the base rule. Repeated
    rows count each and get equal verdicts. Other columns are not looked at.
    """
    measured = stash(features(docs), "quality-features")
    return judge(measured, fit_label_model(measured))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, that `quality` keeps. The texts are measured again rather than shuffled to meet their verdicts."""
    small_batches(docs.sparkSession)
    model = fit_label_model(features(docs))
    names = docs.columns
    plain = [f"_c{i}" for i in range(len(names))]
    schema = ", ".join([*(f"{p} {docs.schema[n].dataType.simpleString()}" for p, n in zip(plain, names, strict=True)), FEATURES])
    measured = docs.toDF(*plain).mapInArrow(tidy(_measurer(names.index("text"), list(range(len(names))), plain)), schema)
    return judge(measured, model).filter("kept").select(*(F.col(p).alias(n) for p, n in zip(plain, names, strict=True)))
