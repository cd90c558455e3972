"""Language identification with interpolated Kneser-Ney character models.

Each language has a character 4-gram model. All languages share, per order, one sorted array of n-gram codes (hashes
that are exact: 16 bits a letter) with a row of log probabilities, and one of contexts with back-off weights;
a text is scored by binary searches over whole Arrow batches, and only the few unseen n-grams back off. The language
of lowest cross-entropy per character is chosen, unless it is above what held-out texts of that language and length
show: then the text is ``und``. Models are fitted on the driver from a bounded sample of labelled rows
(``SAMPLE_DOCS`` a language, the least hashes, so the same at any partitioning) and broadcast; scoring is one narrow
pass over all documents and whole texts.

Defined results
* null or empty texts, and those of fewer than ``MIN_CHARS`` letters, are ``und``; cross-entropy is null without letters;
* rows with a null language or text are no training rows; without any training row everything is ``und``;
* every language is calibrated: short held-out texts are joined to windows, a language with few is cross-validated on all
  its sampled rows, and takes the spread pooled over languages if that still gives few; one whose rows give no
  held-out symbol at all accepts nothing;
* ties go to the language that sorts first; repeated rows and null doc_ids are scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, small, stage, table, text_key
from .words import offsets, pieces, raw, strings

ORDER = 4
#: Symbols are 16 bits, so that an n-gram of ORDER of them is one exact 64-bit code.
CLASSES = 1 << 16
SAMPLE_DOCS = 400
MIN_CHARS = 12
#: Samples of at most so many rows find their texts by broadcast; larger ones in a shuffle, to the same effect.
BROADCAST_ROWS = 200_000
#: How far above the held-out mean a text may lie: spread between texts, and of single characters.
SPREAD, NOISE = 4.0, 4.0
#: Symbols of a calibration window, and windows that a language needs for a spread of its own; the spread where no language has one.
WINDOW, WINDOWS, UNKNOWN_SPREAD = 200, 5, 0.25
UND = "und"


def _classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, else a number of its own for each letter in lower case (there
    are some 47,000 below 0x10000); those above share the numbers that are left."""
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    code = np.flatnonzero(letter)
    low = np.array([ord(chr(c).lower()[0]) for c in code])
    own = np.unique(low[low < 0x10000])
    left = CLASSES - 1 - len(own)
    out = np.zeros(0x110000, dtype=np.uint16)
    out[code] = np.where(low < 0x10000, 1 + np.minimum(np.searchsorted(own, low), len(own) - 1), 1 + len(own) + low % left)
    return out


_CLASS = _classes()


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(classes, start of each text and the end): letters by class, other runs as one 0; each text in zeros."""
    buf, offs = raw(column)
    code = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]  # in characters
    s = _CLASS[code]
    # ORDER - 1 zeros before each text and one after
    lead = ORDER - 1
    n = np.diff(at)
    begin = at[:-1] + np.arange(len(n)) * (lead + 1)
    full = np.zeros(len(s) + len(n) * (lead + 1), dtype=np.uint16)
    full[np.arange(len(s)) + np.repeat(np.arange(len(n)) * (lead + 1) + lead, n)] = s
    keep = np.ones(len(full), dtype=bool)
    keep[1:] = (full[1:] != 0) | (full[:-1] != 0)
    for k in range(lead):  # the added zeros stay, those of the text beside them go
        keep[begin + k] = True
    firsts = np.minimum(begin + lead, len(full) - 1)
    inner = (n > 0) & (full[firsts] == 0)
    keep[firsts[inner]] = False
    # one zero is left of a run that ends a text and the one after it; without any letter, the latter
    letters = np.concatenate([[0], np.cumsum(s != 0)])
    none = letters[at[1:]] == letters[at[:-1]]
    keep[begin[none] + lead + n[none]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return full[keep], np.append(total[begin], total[-1])


def _codes(s: np.ndarray, n: int) -> np.ndarray:
    """The code of the n symbols that end at each place from n - 1 on."""
    out = s[: len(s) - n + 1].astype(np.uint64)
    for k in range(1, n):
        out = (out << np.uint64(16)) | s[k : len(s) - n + 1 + k]
    return out


class Model:
    """Interpolated Kneser-Ney models of several languages over shared sorted arrays."""

    def __init__(self, langs: list[str], texts: list[list[str]]):
        self.langs = langs
        self.limits = np.full((len(langs), 3), np.inf)
        if not langs:
            return
        counts: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for mine in texts:
            s, first = symbols(strings(pa.array(mine, pa.large_string())))
            inside = np.ones(len(s), dtype=bool)
            for k in range(ORDER - 1):
                inside[first[:-1] + k] = False
            by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            code = _codes(s, ORDER)[inside[ORDER - 1 :]]
            by[ORDER] = np.unique(code, return_counts=True)
            for n in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols stand before
                by[n] = np.unique(by[n + 1][0] & np.uint64((1 << (16 * n)) - 1), return_counts=True)
            counts.append(by)
        self.keys = {n: np.unique(np.concatenate([c[n][0] for c in counts])) for n in range(1, ORDER + 1)}
        self.contexts = {n: np.unique(self.keys[n] >> np.uint64(16)) for n in range(1, ORDER + 1)}
        self.logp, self.weight = {}, {}
        L = len(langs)
        lower = np.full((0, L), 0.0)
        for n in range(1, ORDER + 1):
            p = np.zeros((len(self.keys[n]), L))
            w = np.ones((len(self.contexts[n]), L))
            ctx = np.searchsorted(self.contexts[n], self.keys[n] >> np.uint64(16))
            for k, c in enumerate(counts):
                keys, m = c[n]
                d = _discount(m)
                own = np.searchsorted(self.keys[n], keys)
                total = np.bincount(ctx[own], m, len(w))
                types = np.bincount(ctx[own], minlength=len(w))
                seen = total > 0
                w[seen, k] = d * types[seen] / total[seen]
                p[own, k] = (m - d) / total[ctx[own]]
            below = np.full((1, L), 1 / CLASSES) if n == 1 else lower[np.searchsorted(self.keys[n - 1], self.keys[n] & np.uint64((1 << (16 * (n - 1))) - 1))]
            lower = p + w[ctx] * below
            self.logp[n], self.weight[n] = np.log2(lower).astype(np.float32), np.log2(w).astype(np.float32)

    def log2(self, codes: np.ndarray, n: int = ORDER) -> np.ndarray:
        """A row of log2 probabilities a code."""
        if n == 0:
            return np.full((len(codes), len(self.langs)), -np.log2(CLASSES), dtype=np.float32)
        keys = self.keys[n]
        j = np.searchsorted(keys, codes)
        j[j == len(keys)] = 0
        out = self.logp[n][j]
        miss = np.flatnonzero(keys[j] != codes)
        if len(miss):
            c = codes[miss]
            ctx = self.contexts[n]
            i = np.minimum(np.searchsorted(ctx, c >> np.uint64(16)), len(ctx) - 1)
            w = np.where((ctx[i] == c >> np.uint64(16))[:, None], self.weight[n][i], np.float32(0))
            out[miss] = w + self.log2(c & np.uint64((1 << (16 * (n - 1))) - 1), n - 1)
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in bits a symbol, by text and language; symbols scored, by text)."""
        s, first = symbols(column)
        n = np.maximum(np.diff(first) - (ORDER - 1), 0)
        sums = np.zeros((len(n), len(self.langs)))
        if len(s) >= ORDER:
            code = _codes(s, ORDER)
            row = np.repeat(np.arange(len(n)), np.diff(first))[ORDER - 1 :]
            ok = np.arange(ORDER - 1, len(s)) >= (first[:-1] + ORDER - 1)[row]
            for a in range(0, len(code), 1 << 20):
                part = slice(a, a + (1 << 20))
                p, r = self.log2(code[part][ok[part]]), row[part][ok[part]]
                for k in range(len(self.langs)):
                    sums[:, k] += np.bincount(r, p[:, k], len(n))
        return -sums / np.maximum(n, 1)[:, None], n

    def calibrate(self, texts: list[list[str]], sampled: list[list[str]] | None = None) -> None:
        """Limits from texts that no model has seen: mean, spread between texts, spread of a character. Of ``sampled``, all
        rows by language, those of a language with too few such texts are cross-validated."""
        found = []
        for k, mine in enumerate(texts):
            h, n = self.entropies(strings(pa.array(mine, pa.large_string()))) if mine else (np.zeros((0, len(self.langs))), np.zeros(0, int))
            w = _windows(h[:, k], n)
            if sampled and len(w) < WINDOWS:
                w = _windows(*_crossed(self.langs[k], sampled[k]))
            found.append(w)
        spread = lambda w: 1.4826 * float(np.median(np.abs(w - np.median(w))))
        own = [spread(w) for w in found if len(w) >= WINDOWS]
        pooled = float(np.median(own)) if own else UNKNOWN_SPREAD
        for k, w in enumerate(found):
            self.limits[k] = (float(np.median(w)), spread(w) if len(w) >= WINDOWS else pooled, 2.5) if len(w) else (-np.inf, 0.0, 0.0)

    def choose(self, column: pa.Array) -> tuple[list[str], list[float | None], list[int]]:
        if not self.langs:
            _, first = symbols(column)
            return [UND] * len(column), [None] * len(column), [0] * len(column)
        h, n = self.entropies(column)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        mid, spread, char = self.limits[best].T
        with np.errstate(invalid="ignore"):
            top = np.where(np.isinf(mid), mid, mid + SPREAD * np.maximum(spread, 0.05) + NOISE * char / np.sqrt(np.maximum(n, 1)))
        ok = (n >= MIN_CHARS) & (low <= top)
        return [self.langs[b] if o else UND for b, o in zip(best, ok)], [float(x) if m > 1 else None for x, m in zip(low, n)], n.tolist()


def _windows(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Cross-entropies of the texts of ``WINDOW`` symbols or more; if these are few, of all texts joined to such windows."""
    if (n >= WINDOW).sum() >= WINDOWS:
        return h[n >= WINDOW]
    out, bits, symbols_ = [], 0.0, 0
    for x, m in zip(h.tolist(), n.tolist()):
        bits, symbols_ = bits + x * m, symbols_ + m
        if symbols_ >= WINDOW:
            out.append(bits / symbols_)
            bits, symbols_ = 0.0, 0
    if not out and symbols_:
        out = [bits / symbols_]
    return np.array(out)


def _crossed(lang: str, texts: list[str], folds: int = 5, chars: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(cross-entropy, symbols) of each piece of the texts, by a model of the other folds."""
    cut = [t[i : i + chars] for t in texts for i in range(0, len(t), chars)]
    if len(cut) == 1:
        half = len(cut[0]) // 2
        cut = [cut[0][:half], cut[0][half:]]
    folds = min(folds, len(cut))
    hs, ns = [np.zeros(0)], [np.zeros(0, int)]
    for f in range(folds):
        h, n = Model([lang], [[t for i, t in enumerate(cut) if i % folds != f]]).entropies(strings(pa.array(cut[f::folds], pa.large_string())))
        hs.append(h[:, 0])
        ns.append(n)
    return np.concatenate(hs), np.concatenate(ns)


def _discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def sample(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, text, rank): the rows of least hash of each language; only hashes are ranked."""
    d = docs.filter("lang is not null and text is not null and length(text) > 0")
    h = F.xxhash64(F.col("doc_id"), text_key())
    ids = d.select("lang", h.alias("h")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("rank") <= per_language)
    ids = stage(ids.select(F.col("lang").alias("__mr_lang"), F.col("h").alias("__mr_h"), "rank"), "sample")
    return d.select("lang", "text", h.alias("h")).join(F.broadcast(ids) if small(ids, BROADCAST_ROWS) else ids, (F.col("lang") == F.col("__mr_lang")) & (F.col("h") == F.col("__mr_h"))).select("lang", "text", "rank")


def fit(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> Model:
    """Four of five sampled rows train, the fifth calibrates."""
    rows = sorted({(r["lang"], r["rank"], r["text"]) for r in sample(docs, per_language).collect()})
    langs = sorted({r[0] for r in rows})
    part = lambda held: [[t for lang, k, t in rows if lang == x and (k % 5 == 0) == held] for x in langs]
    model = Model(langs, [a or b for a, b in zip(part(False), part(True))]) if langs else Model([], [])
    if langs:
        model.calibrate(part(True), [[t for lang, _, t in rows if lang == x] for x in langs])
    return model


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, language, cross_entropy, letters)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, low, n = [], [], []
            for _, part in pieces(strings(b.column("text"))):
                for into, x in zip((lang, low, n), sent.value.choose(part)):
                    into.extend(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(low, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "language", "cross_entropy", "letters"])

    out = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, language string, cross_entropy double, letters bigint")
    return out.withColumn("cross_entropy", F.round("cross_entropy", 4))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))
