"""A small language detector: shares of frequent words and letters in a sample, and scripts. Batches are counted by Arrow's string
functions, not row by row. Corpora that need a trained model pass their own function to ``guidelines.build``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"
#: A sample in which less than this share of the words speaks for the best language is of none that is known here.
LEAST = 0.04
FREQUENT = {
    "da": "og det er en til på som de med han af for ikke der var jeg sig men et har om vi havde nu da",
    "de": "der die und das den von mit ist nicht ein eine zu im dem auf sich des auch für als sie in",
    "en": "and the of to is that with for was this are from by which have not be it as in a on at an or",
    "es": "de la el que los las y en del se por una un con para es al lo como su no",
    "fr": "de la le les et des un une du est que dans pour qui sur pas par avec au ne il en ce",
    "it": "di che il è un una non per sono con del della si da lo le gli nel alla più anche come questo ha ma",
    "nl": "het een en van is dat op te zijn met voor niet aan er om ook als bij maar dan zou wat nog wordt naar",
    "pl": "w i na z do się nie że jest to o jak po co tak za od przez ale są był dla tym być może",
    "pt": "de o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das",
    "sv": "och att det i en som på är av för med till den har de inte om ett han men var jag sig från vi",
}
MARKS = {"da": "æø", "de": "äöüß", "es": "ñóíúá¿¡", "fr": "éèêàçœù", "it": "òìù", "pl": "łąęśżźćń", "pt": "ãõçâê", "sv": "åäö"}
SCRIPTS = {"ar": "Arabic", "el": "Greek", "he": "Hebrew", "hi": "Devanagari", "ja": "Hiragana", "ko": "Hangul", "ru": "Cyrillic", "zh": "Han"}
LANGUAGES = sorted([*FREQUENT, *SCRIPTS])


def shares(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score of each of LANGUAGES, a row a text; words of each)."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    cut = pc.split_pattern_regex(low, r"[^\p{L}]+")
    flat, row = pc.list_flatten(cut), pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)
    real = pc.greater(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False)
    words = np.bincount(row[real], minlength=len(low))
    letters = np.maximum(pc.count_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False), 1)
    out = np.zeros((len(low), len(LANGUAGES)))
    for k, name in enumerate(LANGUAGES):
        if name in FREQUENT:
            hit = pc.is_in(flat, pa.array(FREQUENT[name].split(), pa.large_string())).to_numpy(zero_copy_only=False)
            out[:, k] = np.bincount(row[hit], minlength=len(low)) / np.maximum(words, 1)
            if name in MARKS:
                out[:, k] += 4 * pc.count_substring_regex(low, f"[{MARKS[name]}]").to_numpy(zero_copy_only=False) / letters
        else:
            out[:, k] = pc.count_substring_regex(low, rf"\p{{{SCRIPTS[name]}}}").to_numpy(zero_copy_only=False) / letters
    return out, words


def names(texts: pa.Array) -> list[str]:
    """The language that most words and letters speak for, of equals the first by name, or unknown."""
    score, words = shares(texts)
    best = score.argmax(axis=1)
    known = (words > 0) & (score[np.arange(len(best)), best] >= LEAST)
    return [LANGUAGES[b] if k else UNKNOWN for b, k in zip(best, known)]


@F.arrow_udf(T.StringType())
def _detect(texts: pa.Array) -> pa.Array:
    return pa.array(names(texts), pa.string())


def detect(sample: Column) -> Column:
    """Of a sample; take the prefix before, so that only it goes to Python."""
    return _detect(sample)
