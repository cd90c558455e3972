"""Plain versions of the corpus operators, and fixtures; nothing here uses the package's own arithmetic."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

from millrace.llm.words import WORD

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows, schema=SCHEMA):
    """``rows``: (doc_id, text) or (doc_id, text, lang)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, schema)


def words(text):
    return re.findall(WORD, (text or "").lower())


def grams(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def line_dedup(rows, min_chars, batch=lambda d: 0):
    """Texts of (doc_id, text) after line dedup, in the order of the rows; documents go by batch, then id, then text hash,
    which only matters for rows of one id: fixtures have none that share a line."""
    norm = lambda s: re.sub(r"[ \t\r\f\v]+", " ", s).strip(" ").lower()
    owner = {}
    for d, t in sorted({r for r in rows if r[1] is not None}, key=lambda r: (batch(r[0]), r[0] is None, r[0] or 0)):
        for i, x in enumerate(t.split("\n")):
            owner.setdefault(norm(x), (d, t, i))
    out = []
    for d, t in rows:
        out.append(None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if len(norm(x)) < min_chars or owner[norm(x)] == (d, t, i)))
    return out


def jaccard_pairs(rows, n, percent):
    """{(a, b, shared, total)} of different documents."""
    sets = [(d, g) for d, g in sorted({(d, frozenset(grams(t, n))) for d, t in rows if d is not None and t is not None}, key=lambda x: x[0]) if g]
    out = set()
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and (s := len(x & y)) and s * (100 + percent) >= percent * (len(x) + len(y)):
            out.add((a, b, s, len(x) + len(y) - s))
    return out


def groups(pairs):
    """Smallest member by member."""
    up = {}

    def root(a):
        while up.get(a, a) != a:
            a = up[a]
        return a

    for a, b, *_ in pairs:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {a: root(a) for p in pairs for a in p[:2]}


def contamination(rows, items, n, min_words):
    """{(doc_id, item_id): [(start, end)]} by word."""
    bench = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(n, len(w))
        if t is not None and k >= min_words:
            for a in range(len(w) - k + 1):
                bench[tuple(w[a : a + k])].add(i)
    sizes = {len(g) for g in bench}
    out = defaultdict(list)
    for d, t in rows:
        w = words(t)
        marks = defaultdict(set)
        for k in sizes:
            for a in range(len(w) - k + 1):
                for i in bench.get(tuple(w[a : a + k]), ()):
                    marks[i].add((a, a + k))
        for i, spans in marks.items():
            for s, e in sorted(spans):
                have = out[(d, i)]
                if have and s <= have[-1][1]:
                    have[-1] = (have[-1][0], max(have[-1][1], e))
                else:
                    have.append((s, e))
    return dict(out)


def without_words(text, spans):
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in re.finditer(WORD, text.lower())]
    drop = set()
    for s, e in spans:
        drop.update(range(at[s][0], at[e - 1][1]))
    return "".join(c for i, c in enumerate(text) if i not in drop)


def repeated_spans(rows, length):
    """{(doc_id, start, end)}: merged windows that stand in more than one place; equal rows are one."""
    docs = sorted({(d, tuple(words(t))) for d, t in rows if t is not None}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    seen = Counter(w[i : i + length] for _, w in docs for i in range(len(w) - length + 1))
    out = []
    for d, w in docs:
        spans = []
        for i in range(len(w) - length + 1):
            if seen[w[i : i + length]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out += [(d, s, e) for s, e in spans]
    return sorted(out, key=repr)


def packed_ok(rows, lengths, capacity):
    """Each document's words lie in bins once, in order, without overlap or overflow; at most two large pieces a bin."""
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append((r["start_token"], r["n_tokens"], r["piece"]))
        by_bin[r["bin_id"]].append((r["offset"], r["n_tokens"], r["slot"]))
    assert set(by_doc) == {d for d, n in lengths.items() if n}
    for d, parts in by_doc.items():
        at = 0
        for s, n, _ in sorted(parts):
            assert s == at and 0 < n <= capacity
            at += n
        assert at == lengths[d]
    for parts in by_bin.values():
        at = 0
        for k, (o, n, slot) in enumerate(sorted(parts)):
            assert o == at and slot == k
            at += n
        assert at <= capacity
        assert sum(n * 3 > capacity for _, n, _ in parts) <= 2
    return by_bin


def pack_sizes(sizes, capacity):
    """Rooms that large-item matching, then best fit, leaves, by a plain search."""
    large = sorted((s for s in sizes if s * 3 > capacity), reverse=True)
    rooms = []
    while large:
        room = capacity - large.pop(0)
        mate = next((i for i, s in enumerate(large) if s <= room), None)
        rooms.append(room - (large.pop(mate) if mate is not None else 0))
    for s in sorted((s for s in sizes if s * 3 <= capacity), reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return sorted(rooms)
