"""Personal data by a linear-chain conditional random field over word shapes.

The field is trained here from a small labelled table (``labelled_table``: sentences of invented words with personal
data of each kind and with look-alikes that are none), by gradient ascent on the exact log-likelihood. Tokens are
runs of non-space characters, a text is one sequence. A token is seen by its *form* alone: its shape (one character a run of capitals,
small letters or digits, other characters as they are, without the marks that follow), and how many characters, digits, letters,
capitals and runs it has; features are parts of the form, and the neighbours' coarse shapes. No pattern of a whole value is among them. Every
token has a form, plain words too; forms are made for whole Arrow batches in numpy, and scored once each. Documents are
decoded by Viterbi in numpy. A token is *certain* if no other label could make up for what it loses against ``O`` by the two
transitions beside it; there any best path is ``O``, so sequences are cut at such tokens and only what is between them is
decoded. That is exact and leaves a few tokens in a hundred. One narrow pass, nothing is shuffled.

Defined results
* null and empty texts have no spans; null doc_ids are carried through; repeated rows give repeated spans;
* ``start`` and ``end`` count characters of the text; punctuation around a value is not part of it;
* a shape counts its first ``RUNS`` runs, a count no more than its cap: tokens that agree in these are alike to the field;
* kinds are those of ``KINDS``; names and postal addresses have no form of their own and are not looked for; columns of
  other names play no part; empty tables give empty tables.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, table
from .words import char_starts, finish, pieces, raw, strings

KINDS = ("EMAIL", "PHONE", "IP", "ACCOUNT", "SECRET")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
SENTENCES, SEED = 1000, 11
RUNS, CAPS = 12, (48, 20, 48, 24, 24)
_TAIL = ".,;:!?*%$&#|>"
#: Class of each byte: a, A, 9, u for all letters beyond ASCII, else itself.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58] = ord("a"), ord("u"), ord("A"), ord("9")

#: (shape, characters, digits, letters, capitals, runs)
Form = tuple[str, int, int, int, int, int]


def form(token: str) -> Form:
    """The plain reading of what ``forms`` does for batches."""
    core = (token.rstrip(_TAIL) or token).encode()
    classes = _CLASS[np.frombuffer(core, np.uint8)].tobytes()
    runs = [c for i, c in enumerate(classes) if not i or c != classes[i - 1]]
    chars = sum(b & 0xC0 != 0x80 for b in core)
    digits, capitals = classes.count(b"9"), classes.count(b"A")
    letters = sum(c in b"aAu" and b & 0xC0 != 0x80 for b, c in zip(core, classes))
    return (bytes(runs[:RUNS]).decode("latin-1"), *(min(n, cap) for n, cap in zip((chars, digits, letters, capitals, len(runs)), CAPS)))


def coarse(f: Form) -> str:
    """A shape for neighbours to see: the kinds of characters."""
    return "".join(sorted(set(f[0])))[:6]


def features(f: Form) -> list[str]:
    shape, chars, digits, letters, capitals, runs = f
    size = min(chars // 3, 9)
    kinds = coarse(f)
    out = [
        f"s={shape}", f"s6={shape[:6]}/{size}", f"s3={shape[:3]}", f"end={shape[-2:]}", f"k={kinds}/{size}", f"d={min(digits, 17)}", f"dl={min(digits // 2, 6)}/{min(letters // 3, 8)}",
        f"only={digits == chars}/{min(digits, 17)}", f"runs={min(runs, 16)}/{min(chars // 4, 8)}", f"caps={min(capitals, 18)}/{capitals == letters}/{min(letters, 20)}", f"k={kinds}/{min(digits, 13)}",
    ]
    return out + [f"has={c}" for c in "@=:.-_+()/'\"" if c in shape]


# --- labelled table


def labelled_sentences(n: int = SENTENCES, seed: int = SEED) -> list[list[tuple[str, str]]]:
    """Invented sentences of (token, label)."""
    r = random.Random(seed)
    syllables = "ba ke lo mi nu ra se ti vo za er on an en is al or est".split()

    def word() -> str:
        return "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))

    def plain() -> str:
        return r.choices([word(), word().title(), word().upper(), r.choice("aioyAI"), word() + word() + word()], (12, 3, 1, 1, 1))[0]

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def hexes(k: int) -> str:
        return "".join(r.choice("0123456789abcdef") for _ in range(k))

    def end(s: str) -> str:
        return s + r.choice(["", "", "", ".", ","])

    def email():
        user = r.choice([f"{word()}.{digits(2)}", word(), f"{word()}_{word()}", f"{word()}.{word()}", f"{word()}{digits(3)}", f"{word()}-{word()}", f"{word()}+{word()}"])
        host = r.choice([f"{word()}{digits(1)}.{word()}.com", f"{word()}.org", f"{word()}.co.uk", f"{word()}-{word()}.net", f"mail.{word()}.de"])
        return [(end(f"{user}@{host}"), "EMAIL")]

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        forms = ([f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{r.randint(1, 99)}-{a}-{b}-{c}"], [f"+{r.randint(1, 99)}{digits(10)}"])
        f = list(r.choices(forms, (5, 2, 2, 2, 1, 1))[0])
        f[-1] = end(f[-1])
        return [(t, "PHONE") for t in f]

    def ip():
        return [(end(".".join(str(r.randint(0, 255)) for _ in range(4))), "IP")]

    def account():
        k = r.choice([9, 10, 11, 12, 12, 12, 13, 14, 15, 16, 16])
        f = r.choice([[digits(k)], [digits(k)], [digits(k)], [f"{digits(3)}-{digits(2)}-{digits(4)}"], [digits(4), digits(4), digits(4), digits(4)], ["-".join(digits(4) for _ in range(4))]])
        f[-1] = end(f[-1])
        return [(t, "ACCOUNT") for t in f]

    def secret():
        k = r.randint(0, 5)
        if k == 5:  # of letters alone, in mixed case
            return [(end("".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.choice([14, 16, 18, 20, 24])))), "SECRET")]
        if k == 0:
            return [(end(r.choice(["AKIA", "ASIA", "AKIA"]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))), "SECRET")]
        if k == 1:
            return [(end(r.choice(["password=", "passwd=", "secret=", "api_key=", "pwd:"]) + hexes(r.choice([12, 16, 18, 18, 24]))), "SECRET")]
        if k == 2:
            return [(r.choice(["token", "key", "secret"]), "O"), ("=", "O"), (end(f'"{hexes(r.choice([32, 39, 40, 40, 41, 64]))}"'), "SECRET")]
        if k == 3:
            return [(end(r.choice(["ghp_", "sk-", "xoxb-"]) + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(36))), "SECRET")]
        return [(end(hexes(r.choice([32, 40, 64]))), "SECRET")]

    def nothing():
        sym = r.choice(["***", "%%%", "$$$", "&&&", "###", "!!"])
        return [
            (t, "O")
            for t in r.choice([
                [f"{r.randint(1, 9)}.{r.randint(0, 9)}."], [f"{r.randint(0, 99)}."], [f"{digits(2)}:{digits(2)}"], [f"{digits(4)}"], [f"${digits(2)}.{digits(2)}"], [word(), "|", word()], [word() + sym, word() + sym], [word().upper() + sym],
                [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{word()}-{word()}"], ["CC", "BY-NC", "4.0."], [f"{r.randint(1, 12)}/{r.randint(1, 30)}"], [f"{digits(1)}.{digits(1)}.{digits(1)}"], [f"{digits(3)},{digits(3)}"], [f"x={digits(1)}"], ["="], [f"@{word()}"], ["--", word()],
                [f"{word().title()}{word().title()}"], [f"{word().title()}-{word().title()}"], [word().upper()], [word().upper(), word().upper()], [word() + word() + word()], [f"{word()[0].upper()}.{word()[0].upper()}."], ["e.g."], [f"{word()}/{word()}"], [f"{word()}_{word()}"], [f"[{word()}]"],
                [f"{word()}:"], [f"{word().title()}'{word()}"], [f"{digits(1)},{digits(3)},{digits(3)}"], [f"{digits(2)}/{digits(2)}/{digits(4)}"], [f"{digits(4)}-{digits(4)}"], [f"#{digits(4)}"], [f"{word()}{digits(2)}"], [f"v{digits(1)}.{digits(2)}.{digits(1)}"], [f"{word().title()}'s"], ["…"], ["—"], [f"«{word()}»"], [f"{word()}é{word()}"], [f"Ü{word()}"], [f"{word().upper()}È{word().upper()}"], [f"{word().upper()}É{word().upper()}Ó{word().upper()}"], [f"{word()}ñ{word()}ß"], [f"{word()}-é{word()}"],
                [f"{word()};{word()}"], [f"{word()}...{word()}"], [f"{digits(3)}"], [f"{digits(1)}"], [f"{digits(7)}"], [f"(c)"], [f"{digits(2)}.{digits(2)}.{digits(4)}"], [f"{word()}-{word()}-{word()}"], [f"{digits(1)})"], [f"({digits(2)})"], [f"{digits(2)}{word()[:2]}"], [f"http://{word()}.org/{word()}/{digits(4)}"], [f"<{word()}>"],
                [f"({word()})"], [f'"{word()}"'], [f"{digits(2)}%"], [f"{word()}'s"], [f"{digits(6)}"], [f"{digits(5)}"], [f"http://{word()}.com/{word()}"],
            ])
        ]

    out = []
    for _ in range(n):
        sent: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 2)):
            sent += [(end(plain()), "O") for _ in range(r.randint(0, 3))]
            what = r.choice([email, phone, ip, account, secret, nothing, nothing, nothing])()
            was = None
            for t, k in what:
                sent.append((t, "O" if k == "O" else f"{'I' if was == k else 'B'}-{k}"))
                was = k
            sent += [(end(plain()), "O") for _ in range(r.randint(0, 2))]
        if r.random() < 0.1:  # every token with a mark, as some texts have it
            sent = [(t + r.choice(["***", "%%%", "$$$", "&&&", "###", "!!"]), y) for t, y in sent]
        out.append(sent)
    return out


def labelled_table(spark: SparkSession, n: int = SENTENCES, seed: int = SEED) -> DataFrame:
    """(sentence, position, token, label)."""
    return spark.createDataFrame([(i, j, t, y) for i, s in enumerate(labelled_sentences(n, seed)) for j, (t, y) in enumerate(s)], "sentence int, position int, token string, label string")


# --- model


class Crf:
    """Weights: ``own`` by feature, ``left`` and ``right`` by the neighbours' coarse shapes, ``trans`` by label pair."""

    def __init__(self, own: dict[str, int], near: dict[str, int], w: np.ndarray, wl: np.ndarray, wr: np.ndarray, trans: np.ndarray):
        self.own, self.near, self.w, self.wl, self.wr, self.trans = own, near, w, wl, wr, trans
        t = trans
        # what a label other than O can gain over O through the transitions beside it, at most
        self.gain = max(float((t[:, [y]] + t[[y], :] - t[:, [0]] - t[[0], :]).max()) for y in range(1, len(LABELS)))
        self._known: dict[Form, tuple[np.ndarray, int]] = {}

    def of(self, f: Form) -> tuple[np.ndarray, int]:
        """(emissions by the form alone, what neighbours see)."""
        if f not in self._known:
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[f] = self.w[[self.own[x] for x in ["bias", *features(f)] if x in self.own]].sum(axis=0), self.near.get(coarse(f), 0)
        return self._known[f]

    def scores(self, tokens: list[str]) -> np.ndarray:
        """Emission scores of a sequence; the plain reading, for tests."""
        of = [self.of(form(t)) for t in tokens]
        k = [self.near["^"], *(n for _, n in of), self.near["^"]]
        return np.array([e + self.wl[k[i]] + self.wr[k[i + 2]] for i, (e, _) in enumerate(of)]).reshape(-1, len(LABELS))

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best labels of one sequence of emissions."""
        return self.viterbi_batch(e[None], np.array([len(e)]))[0]

    def viterbi_batch(self, e: np.ndarray, n: np.ndarray, edge: bool = False) -> np.ndarray:
        """Of sequences padded to one length; ``edge``: an O stands before and after each."""
        size, length, _ = e.shape
        if not length:
            return np.zeros((size, 0), dtype=np.int64)
        back = np.zeros(e.shape, dtype=np.int8)
        best = e[:, 0] + (self.trans[0] if edge else 0)
        final = best.copy()
        for i in range(1, length):
            s = best[:, :, None] + self.trans
            back[:, i] = s.argmax(axis=1)
            best = s.max(axis=1) + e[:, i]
            final[n > i] = best[n > i]
        if edge:
            final = final + self.trans[:, 0]
        out = np.zeros((size, length), dtype=np.int64)
        y = final.argmax(axis=1)
        for i in range(length - 1, -1, -1):
            here = n > i
            out[here, i] = y[here]
            y = np.where(here, back[np.arange(size), i, y], y) if i else y
        return out


class Likelihood:
    """The mean log-likelihood of labelled sentences and its gradient, by forward-backward over all sentences at once."""

    def __init__(self, sentences: list[list[tuple[str, str]]]):
        seen = [[(form(t), y) for t, y in s] for s in sentences]
        self.own: dict[str, int] = {"bias": 0}
        self.near: dict[str, int] = {"?": 0, "^": 1}
        for s in seen:
            for f, _ in s:
                for x in features(f):
                    self.own.setdefault(x, len(self.own))
                self.near.setdefault(coarse(f), len(self.near))
        S, T, L = self.size = len(seen), max(map(len, seen)), len(LABELS)
        label = {y: i for i, y in enumerate(LABELS)}
        self.n = np.array([len(s) for s in seen])
        y = np.zeros((S, T), dtype=np.int64)
        place, feat, self.left, self.right = [], [], np.zeros((S, T), np.int64), np.zeros((S, T), np.int64)
        for i, s in enumerate(seen):
            k = [1, *(self.near[coarse(f)] for f, _ in s), 1]
            for j, (f, lab) in enumerate(s):
                y[i, j], self.left[i, j], self.right[i, j] = label[lab], k[j], k[j + 2]
                for x in ["bias", *features(f)]:
                    place.append(i * T + j)
                    feat.append(self.own[x])
        place, feat = np.array(place), np.array(feat)
        order = np.argsort(place, kind="stable")
        self.place, self.feat = place[order], feat[order]
        self.at = np.flatnonzero(np.append(True, self.place[1:] != self.place[:-1]))
        self.mask = np.arange(T) < self.n[:, None]
        self.shapes = [(len(self.own), L), (len(self.near), L), (len(self.near), L), (L, L)]
        self.gold = np.zeros((S, T, L))
        self.gold[np.arange(S)[:, None], np.arange(T), y] = self.mask
        self.both = (self.gold[:, :-1, :, None] * self.gold[:, 1:, None, :]).sum(axis=(0, 1))
        by = np.argsort(self.feat, kind="stable")  # every feature occurs
        self.place_by_feat, self.feat_at = self.place[by], np.searchsorted(self.feat[by], np.arange(len(self.own)))

    def _sums(self, near: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Of the rows of g, by neighbour; rows beyond a sentence's end are 0."""
        return np.stack([np.bincount(near.ravel(), g[:, y], len(self.near)) for y in range(len(LABELS))], axis=1)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        cuts = np.cumsum([a * b for a, b in self.shapes])[:-1]
        return [p.reshape(s) for p, s in zip(np.split(x, cuts), self.shapes)]

    def at_point(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        S, T, L = self.size
        w, wl, wr, tr = self.parts(x)
        e = np.zeros((S * T, L))
        e[self.place[self.at]] = np.add.reduceat(w[self.feat], self.at, axis=0)
        e = e.reshape(S, T, L) + wl[self.left] + wr[self.right]
        M = np.exp(tr - (top := tr.max()))
        a, b = np.zeros((S, T, L)), np.zeros((S, T, L))
        peak = e.max(axis=2, keepdims=True)
        E = np.exp(e - peak)
        scale = E[:, 0].sum(axis=1, keepdims=True)
        a[:, 0] = E[:, 0] / scale
        logz = np.log(scale[:, 0]) + peak[:, 0, 0]
        for i in range(1, T):
            v = (a[:, i - 1] @ M) * E[:, i]
            scale = v.sum(axis=1, keepdims=True)
            a[:, i] = v / scale
            logz += np.where(self.n > i, np.log(scale[:, 0]) + peak[:, i, 0] + top, 0)
        b[np.arange(S), self.n - 1] = 1
        for i in range(T - 2, -1, -1):
            v = (E[:, i + 1] * b[:, i + 1]) @ M.T
            v = v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
            b[:, i] = np.where((self.n - 1 > i)[:, None], v, b[:, i])
        p = a * b
        p = p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300) * self.mask[:, :, None]
        g = self.gold - p
        g2 = g.reshape(-1, L)
        gw = np.add.reduceat(g2[self.place_by_feat], self.feat_at, axis=0)
        gl, gr = (self._sums(near, g2) for near in (self.left, self.right))
        v = E[:, 1:] * b[:, 1:]
        z = np.maximum(((a[:, :-1] @ M) * v).sum(axis=2, keepdims=True), 1e-300)
        pairs = M * ((a[:, :-1] / z * self.mask[:, 1:, None]).reshape(-1, L).T @ v.reshape(-1, L))
        both = self.both
        value = (self.gold * e).sum() + (both * tr).sum() - logz.sum()
        return value / S, np.concatenate([v.ravel() for v in (gw, gl, gr, both - pairs)]) / S


def train(sentences: list[list[tuple[str, str]]], rounds: int = 120, rate: float = 0.2, l2: float = 1e-4) -> Crf:
    """Adam on the mean log-likelihood."""
    of = Likelihood(sentences)
    x = np.zeros(sum(a * b for a, b in of.shapes))
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, rounds + 1):
        grad = of.at_point(x)[1] - l2 * x
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        x += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Crf(of.own, of.near, *of.parts(x))


def fit(labelled: DataFrame) -> Crf:
    """From the labelled table, whose rows are few by design."""
    by: dict[int, list[tuple[int, str, str]]] = {}
    for r in labelled.collect():
        by.setdefault(r["sentence"], []).append((r["position"], r["token"], r["label"]))
    return train([[(t, y) for _, t, y in sorted(by[k])] for k in sorted(by)])


# --- decoding

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of non-space bytes."""
    ok = ~_SPACE[buf]
    before = np.concatenate([[False], ok[:-1]]) if len(ok) else ok
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    after = np.concatenate([ok[1:], [False]]) if len(ok) else ok
    after[offs[1:][offs[1:] > 0] - 1] = False
    start, end = np.flatnonzero(ok & ~before), np.flatnonzero(ok & ~after) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


_IS_TAIL = np.zeros(256, dtype=bool)
_IS_TAIL[list(_TAIL.encode())] = True
_WHOLE = (np.arange(256) & 0xC0) != 0x80
#: Two counts of each byte in one number: characters and letters; digits and capitals.
_CHARS = (_WHOLE + (_WHOLE & np.isin(_CLASS, list(b"aAu"))) * (1 << 32)).astype(np.int64)
_DIGITS = ((_CLASS == ord("9")) + (_CLASS == ord("A")) * (1 << 32)).astype(np.int64)


def forms(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[Form]]:
    """(form of each token, as an index; the forms), as ``form`` gives them."""
    place = np.arange(len(buf))
    solid = np.maximum.accumulate(np.where(_IS_TAIL[buf], -1, place))[end - 1]  # the last byte that is no mark
    end = np.where(solid >= start, solid + 1, end)
    classes = _CLASS[buf]
    new = np.append(True, classes[1:] != classes[:-1])
    new[start] = True
    runs = np.flatnonzero(new)
    first = np.searchsorted(runs, start)
    n_runs = np.searchsorted(runs, end) - first
    between = lambda x: (c := np.concatenate([[0], np.cumsum(x[buf])]))[end] - c[start]
    a, b = between(_CHARS), between(_DIGITS)
    counts = [a & 0xFFFFFFFF, b & 0xFFFFFFFF, a >> 32, b >> 32, n_runs]
    counts = [np.minimum(c, cap).astype(np.uint64) for c, cap in zip(counts, CAPS)]
    heads = np.append(classes[runs], np.zeros(RUNS, np.uint8)).astype(np.uint64)
    low, high = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for k in range(RUNS):
        c = np.where(n_runs > k, heads[first + k], np.uint64(0))
        if k < 8:
            low |= c << np.uint64(8 * k)
        else:
            high |= c << np.uint64(8 * (k - 8))
    for k, c in enumerate(counts):
        high |= c << np.uint64(32 + 6 * k)
    _, at, index = np.unique(finish(low) * np.uint64(0x9E3779B97F4A7C15) ^ high, return_index=True, return_inverse=True)  # 64-bit hashes
    made = []
    for lo, hi in zip(low[at].tolist(), high[at].tolist()):
        shape = (lo.to_bytes(8, "little") + (hi & 0xFFFFFFFF).to_bytes(4, "little")).rstrip(b"\0").decode("latin-1")
        made.append((shape, *((hi >> (32 + 6 * k)) & 63 for k in range(5))))
    return index, made


def decode(model: Crf, column: pa.Array) -> list[tuple[int, str, int, int, str]]:
    """(row, kind, start, end, value) of all spans, in characters."""
    buf, offs = raw(column)
    start, end, row = _tokens(buf, offs)
    if not len(start):
        return []
    index, made = forms(buf, start, end)
    known = [model.of(f) for f in made]
    emit, seen = np.array([e for e, _ in known]), np.array([k for _, k in known])
    near = seen[index]
    first = np.append(True, row[1:] != row[:-1])
    last = np.append(row[1:] != row[:-1], True)
    edge = model.near["^"]
    prev = np.where(first, edge, np.append(edge, near[:-1]))
    nxt = np.where(last, edge, np.append(near[1:], edge))
    # each combination of a form and what stands beside it is scored once
    codes, which = np.unique((index.astype(np.int64) * len(model.near) + prev) * len(model.near) + nxt, return_inverse=True)
    f, p, q = codes // len(model.near) ** 2, codes // len(model.near) % len(model.near), codes % len(model.near)
    e = emit[f] + model.wl[p] + model.wr[q]
    sure = e[:, 0] - e[:, 1:].max(axis=1) > model.gain
    ids = np.flatnonzero(~sure[which])
    if not len(ids):
        return []
    e = e[which[ids]]
    new = np.append(True, (ids[1:] != ids[:-1] + 1) | (row[ids[1:]] != row[ids[:-1]]))
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(ids)))
    label = np.zeros(len(ids), dtype=np.int64)
    # an O is on either side of a segment, unless the text ends there
    opens, closes = ~first[ids[head]], ~last[ids[head + size - 1]]
    for n in np.unique(size):
        of = np.flatnonzero(size == n)
        at = head[of][:, None] + np.arange(n)
        x = e[at]
        x[opens[of], 0] += model.trans[0]
        x[closes[of], n - 1] += model.trans[:, 0]
        label[at] = model.viterbi_batch(x, np.full(len(of), n))
    return _spans(buf, offs, row, start, end, ids, label)


def _spans(buf, offs, row, start, end, ids, label) -> list[tuple[int, str, int, int, str]]:
    out: list[list] = []
    for i, y in zip(ids[label > 0].tolist(), label[label > 0].tolist()):
        kind = (y - 1) // 2
        if y % 2 == 0 and out and out[-1][1] == kind and out[-1][4] == i - 1 and row[i] == row[i - 1]:
            out[-1][3], out[-1][4] = int(end[i]), i
        else:
            out.append([int(row[i]), kind, int(start[i]), int(end[i]), i])
    if not out:
        return []
    spans = []
    for r, kind, s, e, _ in out:
        value = buf[s:e].tobytes().decode("utf-8", "replace")
        cut = value.rstrip(_TAIL + "\"'>]").lstrip("\"'<[")
        cut = cut.rstrip(")") if cut.count(")") > cut.count("(") else cut
        cut = cut or value
        lead = len(value[: value.find(cut)].encode())
        spans.append((r, KINDS[kind], s + lead, s + lead + len(cut.encode()), cut))
    chars = char_starts(buf, np.array([[s, e, offs[r]] for r, _, s, e, _ in spans]))
    return [(r, k, int(c[0] - c[2]), int(c[1] - c[2]), v) for (r, k, _, _, v), c in zip(spans, chars)]


def personal_data(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, kind, start, end, value), a row a span."""
    sent = docs.sparkSession.sparkContext.broadcast((model.own, model.near, model.w, model.wl, model.wr, model.trans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = Crf(*sent.value)
        for b in batches:
            for off, part in pieces(strings(b.column("text"))):
                rows = decode(crf, part)
                ids = b.column("doc_id").take(pa.array([off + r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[k] for r in rows], t) for k, t in ((1, pa.string()), (2, pa.int64()), (3, pa.int64()), (4, pa.string())))], names=["doc_id", "kind", "start", "end", "value"])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, kind string, start bigint, end bigint, value string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), fit(labelled_table(spark)))
