"""Text functions as Spark expressions; nothing here leaves the JVM.

All of them return null for null. Character classes follow Python's ``re`` on ``str`` (Unicode), so the patterns carry
Java's ``(?U)``, and ``.`` stops at line feeds only, ``(?d)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() takes off.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BULLET = "•"
PRIVATE_BULLET = ""


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f reads it: Catalyst copies a column to each place that names it, and
    plans and work would grow with every step."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Python's str.split(): parts between runs of blanks, none for blank text."""
    return let(strip(c), lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, f"[{BLANKS}]+")))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def unlines(c: Column) -> Column:
    """Each line closed by a line feed."""
    return F.array_join(F.transform(c, lambda x: F.concat(x, F.lit("\n"))), "")


def sub(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, pattern, by)


def starts_with_any(c: Column, prefixes: Sequence[str]) -> Column:
    """Whether c starts with one of the prefixes; they are literals."""
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def contains_any(c: Column, parts: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


# --- cleaning


def remove_urls(c: Column) -> Column:
    # a character class: an alternation under a star would overflow the regex stack on long addresses
    return sub(c, r"(?U)(?:https|http)?://[\w./?=&%-]*\b")


def remove_references(c: Column) -> Column:
    """Tags, then [label](target), then [label]; each the shortest from its first opening on the line."""
    for pattern in (r"(?d)<.*?>", r"(?d)\[.*?\]\(.*?\)", r"(?d)\[.*?\]"):
        c = sub(c, pattern)
    return c


def normalize_sections(c: Column, most: int = 3) -> Column:
    """Headers of the lowest level in the text become one #, none has more than ``most``."""

    def to(c: Column) -> Column:
        runs = F.regexp_extract_all(c, F.lit("\n#+"), F.lit(0))
        least = F.array_min(F.transform(runs, lambda x: F.length(x) - 1))
        level = F.replace(c, F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.coalesce(least, F.lit(1)))), F.lit("\n#"))
        return F.when(c.contains("\n#"), sub(level, "\n#{%d,}" % most, "\n" + "#" * most)).otherwise(c)

    return let(c, to)


def normalize_lists(c: Column) -> Column:
    """Bullets of all kinds to "- "; a line that begins with a small o counts as one."""
    c = F.replace(c, F.lit("\n* "), F.lit("\n- "))
    c = sub(c, f"\n[{BULLET}o{PRIVATE_BULLET}]", "\n-")
    c = F.replace(c, F.lit("\n+ "), F.lit("\n- "))
    c = F.replace(c, F.lit(BULLET + " "), F.lit("- "))
    return F.replace(c, F.lit("* "), F.lit("- "))


def remove_weird_chars(c: Column) -> Column:
    for x in ("◆", BULLET, PRIVATE_BULLET, *"▪■□"):  # a replacement each takes less time than one translation
        c = F.replace(c, F.lit(x), F.lit(""))
    c = F.replace(c, F.lit("*-"), F.lit(""))
    c = F.replace(c, F.lit("\n>"), F.lit("\n"))
    c = F.replace(c, F.lit("**"), F.lit(""))
    return F.replace(c, F.lit("�"), F.lit(""))


def normalize_newlines(c: Column) -> Column:
    """Only lines with an ASCII letter, and an empty line before each header."""
    kept = unlines(F.filter(lines(c), lambda x: x.rlike("[a-zA-Z]")))
    kept = sub(kept, f"\n[{BLANKS}]*\n", "\n")
    return sub(sub(kept, "\n{2,}", "\n"), "\n#", "\n\n#")


def clean(c: Column) -> Column:
    for step in (remove_urls, remove_references, normalize_lists, remove_weird_chars, normalize_sections, normalize_newlines):
        c = step(c)
    return strip(c)


#: Characters that are, or hold, an ASCII letter in lower case: the dotted capital I and the Kelvin sign are two of them.
LETTERS = "a-zA-Z\u0130\u212a"


def letters_start(prefixes: Sequence[str]) -> str:
    """The start of a text whose letters and spaces alone, in lower case and stripped, start with one of the prefixes; none if none can."""
    own = [p for p in prefixes if re.fullmatch("[a-z](?:[a-z ]*)", p)]
    at = {"i": "[iI\u0130]", "k": "[kK\u212a]", " ": " "}
    one = lambda p: f"[^{LETTERS} ]*+".join(at.get(x, f"[{x}{x.upper()}]") for x in p) + (f"[^{LETTERS}]*+[{LETTERS}]" if p.endswith(" ") else "")
    return f"[^{LETTERS}]*+(?:{'|'.join(map(one, own))})" if own else ""


def line_start(prefixes: Sequence[str]) -> str:
    """A pattern of the lines that start with one of the prefixes as they are, in lower case and stripped, without # besides, or with
    letters only. It looks at a line's start alone: to make these forms takes many times as long as to find the lines."""
    low = [p.lower() for p in prefixes]
    if "" in low:
        return "^"
    code = lambda x: f"\\x{{{ord(x):x}}}"

    def folded(p: str, gap: str) -> str:
        # a dotted capital I is an i and a dot, so it can only be the last
        cased = lambda x: x + x.upper() if len(x.upper()) == 1 else x
        more = lambda i, x: "\u212a" if x == "k" else "\u0130" if x == "i" and i == len(p) - 1 else ""
        return gap.join("[" + "".join(map(code, cased(x) + more(i, x))) + "]" for i, x in enumerate(p))

    def stripped(p: str, also: str, gap: str) -> str:
        return folded(p, gap) + (f"[{BLANKS}{also}]*+[^{BLANKS}{also}]" if p[-1] in BLANKS else "")

    inner = [p for p in low if p[0] not in BLANKS]
    forms = [
        letters_start(low),
        f"[{BLANKS}]*+(?:{'|'.join(stripped(p, '', '') for p in inner)})" if inner else "",
        f"[{BLANKS}#]*+(?:{'|'.join(stripped(p, '#', '#*+') for p in inner if '#' not in p)})" if any("#" not in p for p in inner) else "",
        *["".join(map(code, p)) for p in low if p[0] in BLANKS or p[-1] in BLANKS],
    ]
    return f"^(?:{'|'.join(f for f in forms if f)})"


def at_least_words(c: Column, n: int) -> Column:
    """Whether there are that many words; the rest of the text is not looked at."""
    return c.rlike(f"[^{BLANKS}]" + f"[^{BLANKS}]*+[{BLANKS}]++[^{BLANKS}]" * (n - 1))


def truncate(c: Column, starters: Sequence[str] = (), removers: Sequence[str] = (), stoppers: Sequence[str] = ()) -> Column:
    """From the first line that starts with a starter to the next that starts with a stopper, without lines that start
    with a remover or hold no letter. A line is looked at as it is, in lower case, without #, and with letters only.
    Without any starting line, or with a stopping line before it, the text counts from the top."""

    flag = lambda x, prefixes: x.rlike(line_start(prefixes)) if prefixes else F.lit(False)
    marks = lambda x: F.struct(x.alias("x"), flag(x, starters).alias("s"), flag(x, removers).alias("r"), flag(x, stoppers).alias("p"), (~x.rlike(f"[{LETTERS}]")).alias("b"))
    marked = F.transform(lines(c), marks)

    # places count from 1, 0 is none: where the text starts, and the first stop other than there
    start = lambda m: F.array_position(F.transform(m, lambda y: y.s), True) if starters else F.lit(0).cast("long")
    stop = lambda m, a: F.array_position(F.transform(m, lambda y, i: y.p & ~y.r & (i + 1 != a)), True) if stoppers else F.lit(0).cast("long")

    def live(y: Column, i: Column, a: Column, b: Column) -> Column:
        plain, n = ~y.r & ~y.b, i + 1
        return ((b == 0) | (n < b)) & F.when((a == 0) | ((b > 0) & (b < a)), plain).otherwise((n == a) | ((n > a) & plain))

    kept = let(marked, lambda m: let(start(m), lambda a: let(stop(m, a), lambda b: F.transform(F.filter(m, lambda y, i: live(y, i, a, b)), lambda y: y.x))))
    return F.when(c.isNotNull(), strip(F.array_join(kept, "\n")))


def concatenate_sections(sections: Column) -> Column:
    """An array of (name, body), glued as "# name", empty line, body."""
    return F.array_join(F.transform(sections, lambda s: F.concat(F.lit("# "), s["name"], F.lit("\n\n"), s["body"])), "")


def prefix_fingerprint(c: Column, chars: int = 500) -> Column:
    return sub(F.lower(F.substring(c, 1, chars)), "[^a-zA-Z0-9]")


# --- captions and headers

MAIN_SECTIONS = tuple(
    sorted(
        "abstract introduction background related method material result analysis discussion conclusion contribution statement declaration strength limitation funding disclosure acknowledgment ethical tables figures appendix".split()
        + ["future research"]
    )
)


def first_words(c: Column, n: int) -> Column:
    """The first n words and ... if there are more, else c as it is."""
    w = words(c)
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit("..."))).otherwise(c)


def summarize_caption(c: Column, most: int) -> Column:
    return first_words(F.when(F.length(c) > 20, F.split(c, "[.;:()]")[0]).otherwise(c), most)


def is_main_section(c: Column) -> Column:
    return (F.size(F.split(c, " ")) <= 3) & contains_any(F.lower(c), MAIN_SECTIONS)


def capitalize(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def capitalize_words(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), capitalize), " ")


def squeeze_article(c: Column) -> Column:
    """White space of a rendered article."""
    for pattern, by in (("\n+", "\n"), ("\n# ", "\n\n# "), ("\n## ", "\n\n## "), (" +", " ")):
        c = sub(c, pattern, by)
    for tag in ("fig_ref", "bib_ref"):
        c = F.replace(c, F.lit(f"[/{tag}] ."), F.lit(f"[/{tag}]."))
    return c


# --- citations


def citation_author(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, ".", 1), ", ", 1)


def citation_year(c: Column) -> Column:
    """Between the last semicolon and the space before it; empty without a semicolon."""
    head = F.when(c.contains(";"), F.regexp_extract(c, "(?s)^(.*);", 1)).otherwise("")
    return F.regexp_extract(head, "(?s)([^ ]*)$", 1)


def citation_title(c: Column) -> Column:
    """After the first full stop, to the last but a closing one."""
    c = F.when(c.endswith("."), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)
    first, last = F.instr(c, "."), F.length(c) - F.instr(F.reverse(c), ".") + 1
    return F.when((first > 0) & (last > first + 1), F.substring(c, first + 2, last - first - 1)).otherwise("")


def citation_query(author: Column, year: Column, title: Column) -> Column:
    return F.concat(F.lit("("), title, F.lit("[Title] AND "), author, F.lit("[Author - First] AND "), year, F.lit("[Date - Publication])"))


# --- small ones


def is_digits(c: Column) -> Column:
    return c.rlike(r"(?U)^\d+\z")


def is_upper(c: Column) -> Column:
    return (c == F.upper(c)) & (c != F.lower(c))


def single_letter_words(c: Column) -> Column:
    """Whether all words have one character; true without words."""
    return ~c.rlike(f"[^{BLANKS}][^{BLANKS}]")


def letter(i: Column) -> Column:
    """0 to A, 1 to B, and so on."""
    return F.chr(F.lit(65) + i)


def question_of(prompt: Column) -> Column:
    return strip(F.split(F.when(prompt.contains("Question:"), F.split(prompt, "Question:")[1]).otherwise(prompt), "\n\n")[0])


def token_estimate(c: Column) -> Column:
    return F.size(words(c))


def until_stop(c: Column, stop: str = "###") -> Column:
    return F.substring_index(c, stop, 1)


def dotted_numbers_to_hash(c: Column) -> Column:
    return sub(c, r"\b\d+(?:\.\d+){1,3}\b", "#")


def uniform(key: Column, salt: str) -> Column:
    """A number in [0, 1) from the key alone, so that samples don't depend on partitions."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sha256_prefix(content: Column, n: int = 400) -> Column:
    """Of the first n bytes of binary content."""
    return F.sha2(F.substring(content, 1, n), 256)
