"""DuckDB SQL that states what each source processor returns of the documents, framed as raw articles (see ``plans.text``)."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.text import BULLET
from ..operators.guidelines import PHRASES
from . import sql as S

NL = "chr(10)"


def any_of(x: str, prefixes: Sequence[str]) -> str:
    """Whether the line, in one of its four forms, starts with one of the prefixes."""
    low = f"lower({x})"
    forms = [x, S.strip(low), S.strip(S.rep(low, "#")), S.strip(S.sub(low, "[^a-zA-Z ]"))]
    return "(" + " OR ".join(f"starts_with({f}, {S.lit(p.lower())})" for f in forms for p in prefixes) + ")" if prefixes else "false"


def bare(x: str) -> str:
    return S.strip(S.rep(f"lower({x})", "#"))


def digits(x: str) -> str:
    return f"regexp_full_match({x}, '[0-9]+')"


def contains_any(x: str, parts: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {S.lit(p)})" for p in parts) + ")"


def n_words(x: str) -> str:
    return S.words(S.strip(x))


def capitalized(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ')"


def first_line(x: str) -> str:
    return f"string_split({x}, {NL})[1]"


class Chain:
    """CTEs of (doc_id, title, url, t), each a step of the last."""

    def __init__(self, article: str, keep_blanks: bool = False):
        self.ctes = [f"s0 AS (SELECT doc_id, title, url, {'t' if keep_blanks else S.strip('t')} AS t FROM ({article}))"]
        self.n = 0

    def step(self, t: str, **columns: str) -> Chain:
        new = ", ".join(f"{v} AS {k}" for k, v in {**columns, "t": t}.items())
        self.ctes.append(f"s{self.n + 1} AS (SELECT * REPLACE ({new}) FROM s{self.n})")
        self.n += 1
        return self

    def where(self, condition: str) -> Chain:
        self.ctes.append(f"s{self.n + 1} AS (SELECT * FROM s{self.n} WHERE {condition})")
        self.n += 1
        return self

    def lines(self, keep: str, to: str = "x") -> Chain:
        """Of the lines x (and columns of the row) those that are kept, each closed by a line feed."""
        return self.step(f"array_to_string(list_transform(list_filter({S.lines('t')}, lambda x: {keep}), lambda x: {to} || {NL}), '')")

    def clean(self) -> Chain:
        for f in (S.remove_urls, S.remove_references, S.normalize_lists, S.remove_weird_chars, S.normalize_sections, lambda t: S.strip(S.normalize_newlines(t))):
            self.step(f("t"))
        return self

    def truncate(self, source: str | None = None, start: Sequence[str] = (), remove: Sequence[str] = (), stop: Sequence[str] = ()) -> Chain:
        p = PHRASES.get(source, {})
        start, remove, stop = start or p.get("start", ()), remove or p.get("remove", ()), stop or p.get("stop", ())
        n, s = self.n, f"s{self.n}"
        self.ctes += [
            f"l{n} AS (SELECT doc_id, i, x, {any_of('x', start)} AS s, {any_of('x', remove)} AS r, {any_of('x', stop)} AS p, NOT regexp_matches(x, '[a-zA-Z]') AS b FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, {S.lines('t')} AS ls FROM {s})))",
            f"a{n} AS (SELECT doc_id, min(CASE WHEN s THEN i END) AS i0, count(*) AS n FROM l{n} GROUP BY doc_id)",
            f"z{n} AS (SELECT l.doc_id, any_value(i0) AS i0, coalesce(min(CASE WHEN p AND NOT r AND i IS DISTINCT FROM i0 THEN i END), any_value(n)) AS stop FROM l{n} l JOIN a{n} USING (doc_id) GROUP BY l.doc_id)",
            f"k{n} AS (SELECT l.doc_id, string_agg(x, {NL} ORDER BY i) AS kept FROM l{n} l JOIN z{n} USING (doc_id) WHERE i < stop AND CASE WHEN i0 IS NULL OR stop < i0 THEN NOT r AND NOT b ELSE i = i0 OR (i > i0 AND NOT r AND NOT b) END GROUP BY l.doc_id)",
            f"s{n + 1} AS (SELECT p.* REPLACE ({S.strip('coalesce(k.kept, ' + S.lit('') + ')')} AS t) FROM {s} p LEFT JOIN k{n} k USING (doc_id))",
        ]
        self.n += 1
        return self

    def sql(self, source: str, title: str = "CAST(NULL AS VARCHAR)", url: str = "CAST(NULL AS VARCHAR)") -> str:
        return f"WITH RECURSIVE {', '.join(self.ctes)} SELECT doc_id, '{source}' AS source, {title} AS title, t AS clean_text, {url} AS url FROM s{self.n}"


_ENOUGH = f"len(list_filter({S.lines('t')}, lambda l: len(string_split(l, ' ')) > 10)) >= 3"


def _aafp(raw: str) -> str:
    own = f"list_filter({S.lines('t')}, lambda l: starts_with(l, 'The AAFP supports'))"
    low = "lower(title)"
    single = f"len(list_filter(string_split_regex({S.strip(bare('x'))}, '[ \\t]+'), lambda w: length(w) > 1)) = 0"
    c = Chain(raw).where(f"NOT coalesce(ends_with({S.strip(own + '[1]')}, 'on this topic.'), false)")
    c.step("t", title=S.rep(S.rep(S.strip("title"), " | AAFP"), " - Choosing Wisely")).truncate("aafp")
    c.lines(f"NOT ({single}) AND NOT starts_with({low}, {bare('x')}) AND NOT contains({bare('x')}, '|') AND NOT contains({bare('x')}, 'http')")
    return c.step(f"title || {NL} || {NL} || t").clean().sql("aafp", "title", "url")


def _cco(raw: str) -> str:
    bullet = f"starts_with({S.strip('x')}, '{BULLET}')"
    c = Chain(raw).truncate("cco").lines(f"{bullet} OR ({n_words('x')} >= 3 AND regexp_matches(x, '[a-zA-Z]'))", f"(CASE WHEN {bullet} THEN '- ' || {S.strip('substring(x, 2)')} ELSE regexp_replace(x, '^o ', '- ') END)")
    return c.clean().sql("cco")


def _cdc(raw: str) -> str:
    letters = "regexp_replace(lower(x), '[^a-zA-Z]', '', 'g')"
    blank = S.strip(S.sub("lower(x)", f"[{BULLET}#]")) + " = ''"
    c = Chain(raw)
    c.ctes += [
        f"r AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, {S.lines('t')} AS ls FROM s0)) WHERE NOT ({blank}))",
        f"e AS (SELECT doc_id, min(i) AS stop FROM r WHERE NOT starts_with(x, 'q ') AND starts_with({letters}, 'acknowledg') GROUP BY doc_id)",
        f"""m AS (SELECT r.doc_id, string_agg(CASE WHEN starts_with(x, 'q ') THEN '- ' || {S.strip('substring(x, 3)')} WHEN starts_with(x, '#') AND {letters} = '' THEN {capitalized('x')} ELSE {S.strip('x')} END || {NL}, '' ORDER BY i) AS m
        FROM r LEFT JOIN e USING (doc_id) WHERE stop IS NULL OR i < stop GROUP BY r.doc_id)""",
        "s1 AS (SELECT s0.* REPLACE (coalesce(m.m, '') AS t) FROM s0 LEFT JOIN m USING (doc_id))",
    ]
    c.n = 1
    return c.clean().step(f"replace(t, {NL} || '# -', {NL} || '#')").sql("cdc")


def _cdc_diseases(raw: str) -> str:
    c = Chain(raw).where(f"{S.strip(first_line('t'))} <> '### Disease Directory'").truncate("cdc_diseases")
    c.ctes.append(f"h AS (SELECT doc_id, {S.strip('substring(' + first_line('t') + ', 4)')} AS head FROM s{c.n})")
    c.lines(f"{n_words('x')} >= 3 AND NOT {contains_any('x', PHRASES['cdc_diseases']['remove'])}", S.rep(S.rep(S.rep("x", "+ ", "- "), "**"), "*", "- "))
    return c.step(f"title || {NL} || {NL} || t").sql("cdc", f"(SELECT head FROM h WHERE h.doc_id = s{c.n}.doc_id)")


def _cma(raw: str) -> str:
    c = Chain(raw).step("t", title=first_line("t")).truncate("cma").lines("NOT contains(x, '|') AND NOT contains(x, title)")
    return c.step(f"title || {NL} || {NL} || t").clean().sql("cma", "title")


def _cma_pdfs(raw: str) -> str:
    core = f"lower({S.strip(S.sub('x', '[#.]'))})"
    return Chain(raw).truncate("cma_pdfs").lines(f"{core} NOT IN ('', '{BULLET}') AND NOT {digits(core)}", r"regexp_replace(x, '^\d+\.\s', '- ')").clean().sql("cma")


def _cps(raw: str) -> str:
    c = Chain(raw).truncate("cps").lines(f"{n_words('x')} >= 3 AND NOT {contains_any('x', PHRASES['cps']['remove'])}", S.strip("x")).clean()
    return c.where(f"len({S.lines('t')}) >= 3").sql("cps")


def _drugs(raw: str) -> str:
    c = Chain(raw).step(f"array_to_string(list_filter({S.lines('t')}, lambda x: NOT contains(x, '|')), {NL})").truncate("drugs")
    c.step(S.strip(S.sub(S.rep(S.rep(S.rep("t", "*", "-"), "["), "]"), r"\([^)]+\)")), title=S.strip("string_split(title, ' - ')[1]"))
    return c.step(S.rep("t", "--")).clean().sql("drugs", "title", "url")


def _gc(raw: str) -> str:
    core = "regexp_replace(x, '[^a-zA-Z0-9]', '', 'g')"
    quotes = lambda x: S.rep(S.rep(x, '["'), '"]')
    c = Chain(raw).step(quotes("t"), title=quotes(S.strip("title"))).truncate("gc").lines("true", S.strip("x"))
    c.step(f"substring(t, 1, length(t) - 1)")
    c.lines("x <> '(c)'", f"(CASE WHEN {core} = upper({core}) AND {core} <> lower({core}) AND length({core}) > 2 THEN {NL} || '# ' || x ELSE x END)")
    return c.clean().where(_ENOUGH).sql("gc", "title")


def _icrc(raw: str) -> str:
    c = Chain(raw, keep_blanks=True).truncate("icrc")
    return c.lines("regexp_matches(x, '[a-zA-Z]')", f"(CASE WHEN regexp_matches(x, '^[0-9]+[a-zA-Z]+') THEN '- ' || {S.strip('substring(x, 2)')} ELSE x END)").clean().sql("icrc")


def _idsa(raw: str) -> str:
    numbered = digits(f"string_split({bare('x')}, '.')[1]")
    after = S.strip(f"substring(x, strpos({bare('x')}, '.') + 1)")
    c = Chain(raw).where("NOT contains(t, 'This new guideline is currently in development')").step("t", title=first_line("t")).truncate("idsa")
    c.lines(f"{numbered} OR NOT starts_with(lower(title), {bare('x')})", f"(CASE WHEN {numbered} THEN '- ' || {after} ELSE x END)").step(f"title || {NL} || {NL} || t")
    for old, new in ((" ,", ""), (" .", "."), ("*", ""), (" )", ""), ("-. ", "- ")):
        c.step(S.rep("t", old, new))
    return c.clean().where(f"len({S.lines('t')}) >= 5").sql("idsa", "title", "url")


def _magic(raw: str) -> str:
    c = Chain(raw)
    c.step(f"array_to_string(list_transform(list_filter(string_split(t, 'Loading Data...' || {NL}), lambda x: NOT contains(x, 'Write header here') AND NOT contains(x, 'Write remark here')), lambda x: x || {NL} || {NL}), '')")
    at = lambda k: S.strip(f"ls[i + {k}]")
    head = f"{digits(at(1))} AND NOT {digits(at(2))} AND {digits(at(3))}"
    # the walk over lines: it skips what it has used
    c.ctes += [
        f"g AS (SELECT doc_id, {S.lines('t')} AS ls FROM s1)",
        f"w AS (SELECT doc_id, 0 AS i, -1 AS pos, CAST(NULL AS VARCHAR) AS o FROM g UNION ALL SELECT w.doc_id, i + CASE WHEN {head} THEN 2 ELSE 1 END, i, CASE WHEN {head} THEN '# ' ELSE '' END || {at(2)} FROM w JOIN g USING (doc_id) WHERE i < len(ls) - 3)",
        f"v AS (SELECT doc_id, coalesce(string_agg(o || {NL}, '' ORDER BY pos) FILTER (WHERE pos >= 0), '') AS o, max(i) AS i FROM w GROUP BY doc_id)",
        f"s2 AS (SELECT s1.* REPLACE (v.o || CASE WHEN v.i = len(g.ls) - 3 THEN array_to_string(g.ls[v.i + 1:], {NL}) ELSE '' END AS t) FROM s1 JOIN v USING (doc_id) JOIN g USING (doc_id))",
    ]
    c.n = 2
    c.truncate("magic").lines(f"{bare('x')} <> '' AND NOT contains(x, '|')", S.strip("x")).step(S.sub("t", "\\n+", "\n"))
    for old, new in (("\n**", "\n## "), ("*", ""), ("\n(", "("), ("\n)", ")"), ("\n;", ";")):
        c.step(S.rep("t", old, new))
    name = S.strip(S.sub(f"lower({first_line('y')})", "[^a-zA-Z ]"))
    gone = " OR ".join(f"starts_with({name}, {S.lit(p)})" for p in PHRASES["magic"]["sections"])
    c.step(f"array_to_string(list_transform(list_filter(string_split({S.strip('t')}, {NL} || {NL}), lambda y: NOT ({gone})), lambda y: y || {NL} || {NL}), '')")
    core = S.strip(S.sub("lower(x)", "[^a-zA-Z0-9 ]"))
    return c.lines(f"NOT starts_with(x, '!') AND NOT {digits(core)}", f"(CASE WHEN starts_with(x, '#') AND len(string_split(x, ' ')) > 7 THEN {S.strip(S.rep('x', '#'))} ELSE x END)").clean().sql("magic")


def _mayo(raw: str) -> str:
    c = Chain(raw, keep_blanks=True).step(f"'# Symptoms discussion' || {NL} || {NL} || t || '# Update information' || {NL} || {NL} || 'gone'").clean()
    return c.step(f"array_to_string(list_filter({S.lines('t')}, lambda x: NOT contains(x, 'MayoClinic')), {NL})").sql("mayo", "title")


def _nice(raw: str) -> str:
    c = Chain(raw, keep_blanks=True).step(f"'# Symptoms discussion' || {NL} || {NL} || t").clean()
    return c.step(f"title || {NL} || {NL} || 'An overview' || {NL} || {NL} || t").sql("nice", "title", "url")


def _who(raw: str) -> str:
    c = Chain(raw).truncate("who").lines(f"{n_words('x')} >= 3", S.strip(S.rep("x", BULLET + " ", "- ")))
    return c.step("replace(t, chr(57393), '')").clean().sql("who")


def _wikidoc(raw: str) -> str:
    c = Chain(raw, keep_blanks=True).truncate("wikidoc")
    before = "(PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    c.ctes += [
        f"f AS (SELECT doc_id, i, x, starts_with(x, 'Any recommendations found on these pages') AS notice, starts_with(x, '#') AS head FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, {S.lines('t')} AS ls FROM s1)))",
        f"q AS (SELECT *, max(CASE WHEN notice THEN i END) OVER {before} AS n, max(CASE WHEN head THEN i END) OVER {before} AS h FROM f)",
        f"o AS (SELECT doc_id, string_agg(x || {NL}, '' ORDER BY i) AS o FROM q WHERE head OR (NOT notice AND NOT starts_with(x, 'CLASS') AND (n IS NULL OR coalesce(h > n, false))) GROUP BY doc_id)",
        "s2 AS (SELECT s1.* REPLACE (coalesce(o.o, '') AS t) FROM s1 LEFT JOIN o USING (doc_id))",
    ]
    c.n = 2
    return c.step(S.sub("t", "Redirect to.*")).clean().where(_ENOUGH).sql("wikidoc", "title", "url")


def processor_sql(name: str, raw: str) -> str:
    """``raw``: an SQL expression of the article's text over ``documents``."""
    article = f"SELECT doc_id, 'Title ' || doc_id AS title, 'http://x/' || doc_id AS url, {raw} AS t FROM documents"
    return globals()[f"_{name}"](article)


NAMES = [n[1:] for n, f in list(globals().items()) if n.startswith("_") and callable(f)]
