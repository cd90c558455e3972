"""Quality rules by distribution divergence.

Each document's histograms of character classes and of common words are held against the histograms of all documents
of its language, by Jensen-Shannon distance (the square root of the divergence to base 2, so 0 to 1). Histograms are counted in numpy
by an Arrow function of text and language, to which no other column goes; they are counted once and staged beside the
columns that are asked for. The references are one aggregation of them to a row a language, broadcast after a look at their number;
scores are native expressions. Nothing else is shuffled.

Defined results
* null or empty text: no histogram, both distances null, kept ("short");
* a test is made only from ``min_chars`` characters or ``min_words`` words on, and only if the language's reference
  holds ``min_reference`` of them; a null language is a language of its own; without a word list only characters count;
* repeated rows score alike and are all kept or all rejected; columns of any other name pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let
from .common import small, stage, table
from .words import WORD_RE2, Words, ngram_of, pieces, raw, strings

CLASSES = ("upper", "lower", "digit", "space", "punct", "other")
COMMON = {
    "en": "the of and to in a is that for it as was with be by on not he his this are or had at from they an which have you".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son aux".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
}
N_COMMON = 30
#: References of at most so many languages are broadcast; more meet the documents in a shuffle, to the same effect.
BROADCAST_ROWS = 10_000


@dataclass(frozen=True)
class Rules:
    """``char_limit`` and ``word_limit`` are the largest distances kept. Of n words from the language itself, the divergence is about
    chi-squared / (8 n ln 2) just by chance, with ``N_COMMON`` degrees of freedom: what ``false_rejection`` of such texts exceed is
    allowed on top (of the squared word limit)."""

    char_limit: float = 0.3162
    word_limit: float = 0.1732
    false_rejection: float = 0.01
    min_chars: int = 150
    min_words: int = 20
    min_reference: int = 2000

    @property
    def by_chance(self) -> float:
        """The divergence of one word's worth, by the Wilson-Hilferty quantile."""
        z, k = NormalDist().inv_cdf(1 - self.false_rejection), N_COMMON
        return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3 / (8 * 0.6931471805599453)


_BYTE_CLASS = np.full(256, 4, dtype=np.int64)
_BYTE_CLASS[65:91], _BYTE_CLASS[97:123], _BYTE_CLASS[48:58] = 0, 1, 2
_BYTE_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_BYTE_CLASS[0x80:0xC0], _BYTE_CLASS[0xC0:] = 6, 5  # continuation bytes aren't characters


def histograms(texts: pa.Array, langs: list[str | None]) -> np.ndarray:
    """A row a text: counts of CLASSES, then of the language's common words in order, then of other words."""
    texts = strings(texts)
    out = np.zeros((len(texts), 6 + N_COMMON + 1), dtype=np.int64)
    books = {}
    for lang, words in COMMON.items():
        h = np.array([ngram_of([w]) for w in words], dtype=np.uint64)
        order = np.argsort(h)
        books[lang] = (h[order], order)
    for at, part in pieces(texts):
        buf, offs = raw(part)
        n = len(part)
        kinds = _BYTE_CLASS[buf]
        for k in range(6):  # sums by row of each class
            sums = np.zeros(len(buf) + 1, dtype=np.int32)
            np.cumsum(kinds == k, out=sums[1:], dtype=np.int32)
            out[at : at + n, k] = sums[offs[1:]] - sums[offs[:-1]]
        w = Words(part)
        _, grams = w.ngrams(1)
        out[at : at + n, -1] = np.diff(w.first)
        mine = np.array([langs[at + i] if langs[at + i] in books else "" for i in range(n)], dtype=object)
        for lang, (keys, order) in books.items():
            rows = np.flatnonzero(mine == lang)
            if not len(rows):
                continue
            picked = np.isin(w.row, rows)
            g, r = grams[picked], w.row[picked]
            j = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
            hit = keys[j] == g
            hist = np.bincount(r[hit] * N_COMMON + order[j[hit]], minlength=n * N_COMMON).reshape(n, N_COMMON)
            out[at : at + n, 6 : 6 + N_COMMON] += hist
            out[at : at + n, -1] -= hist.sum(axis=1)
    return out


@F.arrow_udf(T.ArrayType(T.LongType()))
def _histogram(texts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for text, lang in texts:
        h = histograms(text, lang.to_pylist())
        yield pa.ListArray.from_arrays(pa.array(np.arange(0, h.size + 1, h.shape[1], dtype=np.int32)), pa.array(h.ravel()))


def _with_histogram(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, with ``__mr_h`` and the language again, staged."""
    return stage(docs.select(*columns, F.col("lang").alias("__mr_of"), _histogram("text", "lang").alias("__mr_h")), "histograms")


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v)


def _shares(counts: Column) -> Column:
    """Of their sum; null without any."""
    return let(_total(counts), lambda n: F.when(n > 0, F.transform(counts, lambda v: v / n)))


def _jsd(p: Column, q: Column) -> Column:
    """Of two count arrays: sum over both of x log2(2x / (p + q)), halved."""
    term = lambda x, y: F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))
    both = F.zip_with(_shares(p), _shares(q), lambda a, b: term(a, b) + term(b, a))
    return F.aggregate(both, F.lit(0.0), lambda a, v: a + v) / 2


def references(counted: DataFrame) -> DataFrame:
    """(__mr_lang, __mr_ref): summed histograms over all documents of each language."""
    width = 6 + N_COMMON + 1
    sums = counted.groupBy("__mr_of").agg(*[F.sum(F.col("__mr_h")[i]).alias(f"s{i}") for i in range(width)])
    return sums.select(F.col("__mr_of").alias("__mr_lang"), F.array(*[f"s{i}" for i in range(width)]).alias("__mr_ref"))


def scored(docs: DataFrame, rules: Rules = Rules(), columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all) with ``__mr_chars``, ``__mr_words`` (counts), ``__mr_char_distance``, ``__mr_word_distance``,
    ``__mr_reason``."""
    columns = columns or docs.columns
    counted = _with_histogram(docs, columns)
    refs = stage(references(counted), "references")
    h = counted.join(F.broadcast(refs) if small(refs, BROADCAST_ROWS) else refs, F.col("__mr_of").eqNullSafe(F.col("__mr_lang")), "left")
    parts = lambda c: (F.slice(c, 1, 6), F.slice(c, 7, N_COMMON + 1))
    (pc_, pw), (qc, qw) = parts(F.col("__mr_h")), parts(F.col("__mr_ref"))
    known = F.coalesce(F.col("__mr_of").isin(*COMMON), F.lit(False))
    distance = lambda p, q: F.sqrt(F.greatest(_jsd(p, q), F.lit(0.0)))

    def score(n: Column) -> Column:
        chars = F.when((n["chars"] >= rules.min_chars) & (_total(qc) >= rules.min_reference), distance(pc_, qc))
        words = F.when(known & (n["words"] >= rules.min_words) & (_total(qw) >= rules.min_reference), distance(pw, qw))
        return F.struct(n["chars"].alias("chars"), n["words"].alias("words"), chars.alias("char_distance"), words.alias("word_distance"))

    def judged(x: Column) -> Column:
        limit = F.sqrt(rules.word_limit**2 + rules.by_chance / x["words"])
        reason = (
            F.when(x["char_distance"].isNull() & x["word_distance"].isNull(), "short")
            .when(x["char_distance"] > rules.char_limit, "characters")
            .when(x["word_distance"] > limit, "words")
            .otherwise("kept")
        )
        return F.struct(x["chars"].alias("chars"), x["words"].alias("words"), x["char_distance"].alias("char_distance"), x["word_distance"].alias("word_distance"), reason.alias("reason"))

    # bound step by step: a filter on the reason would have the distances computed once for each mention
    h = h.withColumn("__mr_s", let(let(F.struct(_total(pc_).alias("chars"), _total(pw).alias("words")), score), judged))
    return h.select(*columns, *[F.col(f"__mr_s.{c}").alias(f"__mr_{c}") for c in ("chars", "words", "char_distance", "word_distance", "reason")])


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    return scored(docs, rules).filter(~F.col("__mr_reason").isin("characters", "words")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return s.select(
        "doc_id", F.col("__mr_chars").alias("chars"), F.col("__mr_words").alias("words"), F.round("__mr_char_distance", 4).alias("char_distance"), F.round("__mr_word_distance", 4).alias("word_distance"),
        F.col("__mr_reason").alias("reason"), (~F.col("__mr_reason").isin("characters", "words")).alias("keep"),
    )


_R = Rules()
_LISTED = ", ".join(f"('{lang}', '{w}', {i})" for lang, words in COMMON.items() for i, w in enumerate(words))
_REMOVED = {"upper": "[^A-Z]", "lower": "[^a-z]", "digit": "[^0-9]", "space": r"[^\t\n\x0b\f\r ]", "punct": r"[A-Za-z0-9\t\n\x0b\f\r ]|[^\x00-\x7f]", "other": r"[\x00-\x7f]"}
_LN = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0 END"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, lang, coalesce(text, '') AS text FROM documents),
common(lang, word, b) AS (VALUES {_LISTED}),
words AS (SELECT id, lang, unnest(regexp_extract_all(lower(text), '{WORD_RE2}')) AS word FROM d),
hits AS (SELECT w.id, w.lang, coalesce(c.b, {N_COMMON}) AS b, count(*) AS n FROM words w LEFT JOIN common c ON w.lang = c.lang AND w.word = c.word GROUP BY ALL),
kinds AS (SELECT id, lang, text, b, CAST(n AS BIGINT) AS n FROM (
  SELECT id, lang, text, unnest([{", ".join(f"length(regexp_replace(text, '{r}', '', 'g'))" for r in _REMOVED.values())}]) AS n, unnest([0, 1, 2, 3, 4, 5]) AS b FROM d)),
both_ AS (SELECT 'c' AS t, id, lang, b, n FROM kinds UNION ALL SELECT 'w', id, lang, b, n FROM hits),
ref AS (SELECT t, lang, b, sum(n) AS r FROM both_ GROUP BY ALL),
tot AS (SELECT t, lang, sum(r) AS rt FROM ref GROUP BY ALL),
own AS (SELECT t, id, sum(n) AS nt FROM both_ GROUP BY ALL),
pq AS (SELECT ref.t, d.id, own.nt, tot.rt, coalesce(both_.n, 0) / own.nt AS p, ref.r / tot.rt AS q
  FROM d JOIN ref ON ref.lang IS NOT DISTINCT FROM d.lang JOIN tot ON tot.t = ref.t AND tot.lang IS NOT DISTINCT FROM d.lang
  JOIN own ON own.t = ref.t AND own.id = d.id LEFT JOIN both_ ON both_.t = ref.t AND both_.id = d.id AND both_.b = ref.b WHERE own.nt > 0),
j AS (SELECT t, id, any_value(nt) AS nt, any_value(rt) AS rt, sum({_LN.format("p", "q")} + {_LN.format("q", "p")}) / 2 AS jsd FROM pq GROUP BY t, id),
s AS (SELECT d.doc_id, coalesce(c.nt, 0) AS chars, coalesce(w.nt, 0) AS words,
  CASE WHEN c.nt >= {_R.min_chars} AND c.rt >= {_R.min_reference} THEN sqrt(greatest(c.jsd, 0)) END AS char_distance,
  CASE WHEN d.lang IN ({", ".join(f"'{x}'" for x in COMMON)}) AND w.nt >= {_R.min_words} AND w.rt >= {_R.min_reference} THEN sqrt(greatest(w.jsd, 0)) END AS word_distance
  FROM d LEFT JOIN j c ON c.id = d.id AND c.t = 'c' LEFT JOIN j w ON w.id = d.id AND w.t = 'w'),
v AS (SELECT *, CASE WHEN char_distance IS NULL AND word_distance IS NULL THEN 'short' WHEN char_distance > {_R.char_limit} THEN 'characters'
  WHEN word_distance > sqrt({_R.word_limit**2} + {_R.by_chance} / words) THEN 'words' ELSE 'kept' END AS reason FROM s)
SELECT doc_id, CAST(chars AS BIGINT) AS chars, CAST(words AS BIGINT) AS words, round(char_distance, 4) AS char_distance, round(word_distance, 4) AS word_distance, reason, reason NOT IN ('characters', 'words') AS keep FROM v
"""
