import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspan.llm.text import Shingler, column_bytes, pieces

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def plain(text, k):
    words = WORDS.findall((text or b"").lower())
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)] if words else []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aB \n\té", max_size=30)), max_size=8))
def test_shingles_follow_the_words(texts):
    data, at = column_bytes(pa.array(texts, pa.string()))
    hashes, where = Shingler(3).shingles(data, at)
    names = {}
    for row, text in enumerate(texts):
        want = plain(text.encode() if text else None, 3)
        got = hashes[where[row] : where[row + 1]].tolist()
        assert len(got) == len(want)
        for h, w in zip(got, want, strict=True):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_sliced_arrays_and_pieces():
    whole = pa.array([b"ab", None, b"cde", b""], pa.binary())
    data, at = column_bytes(whole.slice(1))
    assert bytes(data) == b"cde" and at.tolist() == [0, 0, 3, 3]
    runs = list(pieces(np.array([0, 5, 6, 30, 31]), 6))
    assert runs[0] == (0, 2) and runs[-1][1] == 4 and all(a < b for a, b in runs)


def test_words_that_follow_thue_and_morse_differ():
    """Any polynomial modulo 2^64 takes such a word and its complement for equal; so did the shingles once."""
    for size in (512, 1024, 2048, 4096):
        word = "".join("ab"[k.bit_count() & 1] for k in range(size))
        for texts in ([word, word.translate({97: "b", 98: "a"})], ["x " + word, "x " + word.translate({97: "b", 98: "a"})]):
            data, at = column_bytes(pa.array(texts))
            hashes, _ = Shingler(5).shingles(data, at)
            assert len(set(hashes.tolist())) == len(hashes) == 2
