from __future__ import annotations

import brute
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm.words import Words, ngram_of


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abÄß 1.-\n—“é中\U0001f600　\xa0", max_size=40), max_size=5))
def test_words_are_the_pattern_s(texts):
    w = Words(pa.array(texts, pa.large_string()))
    got = [[w.buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [brute.words(t) for t in texts]


def test_long_text_is_cut_nowhere():
    text = "word " * 100_000 + "x" * 300_000 + " end"
    w = Words(pa.array([text, "b c"], pa.large_string()))
    assert w.first.tolist()[1] >= 100_002 and w.text(int(w.first[1]), int(w.first[2])) == "b c"


def test_ngrams_stay_within_texts():
    w = Words(pa.array(["a b c", "", "c d e"], pa.large_string()))
    at, h = w.ngrams(3)
    assert at.tolist() == [0, 3] and int(h[1]) == ngram_of(["c", "d", "e"])
