"""Pieces of DuckDB SQL that state what the text functions compute."""

from __future__ import annotations

from ..functions.text import BLANKS, BULLET, PRIVATE_BULLET

Q = "'"


def lit(s: str) -> str:
    return Q + s.replace(Q, Q + Q) + Q


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, 'g')"


def rep(x: str, old: str, new: str = "") -> str:
    return f"replace({x}, {lit(old)}, {lit(new)})"


def strip(x: str) -> str:
    return f"trim({x}, {lit(BLANKS)})"


def lines(x: str) -> str:
    return f"string_split({x}, chr(10))"


def words(x: str) -> str:
    """The number of blank-separated words."""
    return f"len(list_filter(string_split_regex({x}, {lit('[' + BLANKS + ']+')}), lambda w: w <> ''))"


def remove_urls(x: str) -> str:
    return sub(x, r"(?:https|http)?://[\w./?=&%-]*\b")


def remove_references(x: str) -> str:
    for p in (r"<.*?>", r"\[.*?\]\(.*?\)", r"\[.*?\]"):
        x = sub(x, p)
    return x


def normalize_sections(x: str) -> str:
    level = f"replace({x}, chr(10) || repeat('#', coalesce(list_min(list_transform(regexp_extract_all({x}, '\\n#+'), lambda h: length(h) - 1)), 1)), chr(10) || '#')"
    return f"CASE WHEN contains({x}, chr(10) || '#') THEN {sub(level, chr(92) + 'n#{3,}', chr(10) + '###')} ELSE {x} END"


def normalize_lists(x: str) -> str:
    x = rep(x, "\n* ", "\n- ")
    x = sub(x, f"\\n[{BULLET}o{PRIVATE_BULLET}]", "\n-")
    for old, new in (("\n+ ", "\n- "), (BULLET + " ", "- "), ("* ", "- ")):
        x = rep(x, old, new)
    return x


def remove_weird_chars(x: str) -> str:
    x = sub(x, f"[◆{BULLET}{PRIVATE_BULLET}▪■□]")
    for old, new in (("*-", ""), ("\n>", "\n"), ("**", ""), ("�", "")):
        x = rep(x, old, new)
    return x


def normalize_newlines(x: str) -> str:
    kept = f"array_to_string(list_transform(list_filter({lines(x)}, lambda l: regexp_matches(l, '[a-zA-Z]')), lambda l: l || chr(10)), '')"
    return sub(sub(sub(kept, f"\\n[{BLANKS}]*\\n", "\n"), "\\n{2,}", "\n"), "\\n#", "\n\n#")


def clean_ctes(source: str, x: str, keep: str = "*") -> str:
    """A chain of CTEs c0 to c6, each a step; c6 has ``t`` cleaned."""
    steps = [remove_urls, remove_references, normalize_lists, remove_weird_chars, normalize_sections, lambda t: strip(normalize_newlines(t))]
    out = [f"c0 AS (SELECT {keep}, {x} AS t FROM {source})"]
    out += [f"c{i} AS (SELECT * REPLACE ({f('t')} AS t) FROM c{i - 1})" for i, f in enumerate(steps, 1)]
    return ", ".join(out)


def fingerprint(x: str) -> str:
    return sub(f"lower(substring({x}, 1, 500))", "[^a-zA-Z0-9]")


def uniform(key: str, salt: str = "42") -> str:
    return f"(CAST(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '{salt}'), 1, 8)) AS UBIGINT) AS DOUBLE) / 4294967296.0)"
