"""Per-source cleaning of guideline articles, and the corpus build around it.

A processor maps the columns of a raw article to those of a cleaned one; a null text means that the article is not
kept. All but one are native expressions. ``build`` chains: process, language filter, prefix dedup, canonical record.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..sources.staging import stage
from . import dedup, lang


#: What begins an article's text, is taken out, or ends it, by source, in alphabetical order. These are the words of the sources'
#: own pages; results depend on them, so they can only be what they are. Order has no effect.
PHRASES: dict[str, dict[str, list[str]]] = {
    "aafp": {
        "start": ["clinical preventive service recommendation", "key recommendations", "recommendation"],
        "remove": ["**[", "---", "===", "[", "http"],
        "stop": ["*keyboard\\_tab*", "*these guidelines are provided only", "*these recommendations are provided only", "more about choosing wisely", "more about practice guidelines", "references", "related content", "sources"],
    },
    "cco": {
        "start": ["Guideline objectives", "Intended purpose", "Introduction", "Questions"],
        "remove": ["An assessment conducted in", "Care has been taken in the preparation", "These guidelines recommendations have been endorsed", "This is a quick reference guide", "This report is copyrighted by"],
    },
    "cdc_diseases": {
        "start": ["###"],
        "remove": [" | CDC", "insurance"],
        "stop": ["After Travel", "More Information"],
    },
    "cma": {
        "start": ["### 1. what", "### abstract", "### key information", "### what", "introduction", "key information", "overview", "preamble"],
        "remove": ["![", "* [", "+ [", "---", "===", "[", "figure", "footnote", "refer to", "table", "|"],
        "stop": ["### authors’ statement", "### references", "### selected references", "acknowledgements", "acknowledgments", "additional resources", "additional tables", "appendix", "list of abbreviations", "references", "report a problem", "selected references"],
    },
    "cma_pdfs": {
        "stop": ["acknowledg", "conflict of interest", "disclaimer", "funding"],
    },
    "cps": {
        "start": ["### Abstract"],
        "remove": ["Figure", "Key words:", "Keywords:", "The Canadian Paediatric Society gives permission", "|"],
        "stop": ["Acknowledgements", "Current:  About CPS position", "Selected resources"],
    },
    "drugs": {
        "remove": ["###", "* [", "---", "===", "Always consult your healthcare provider", "Frequently asked", "Further information", "More about", "[", "[Medical"],
    },
    "gc": {
        "start": ["Document Objectives"],
        "remove": ["(c)", "Publication Date", "http", "www"],
        "stop": ["Disclaimer", "Recommendation Grading", "Source Citation"],
    },
    "icrc": {
        "stop": ["acknowledgements", "acknowledgments", "contacts"],
    },
    "idsa": {
        "start": ["abstract", "introduction"],
        "remove": ["---", "===", "[!", "appropriate use criteria", "published"],
        "stop": ["acknowledgments", "disclaimer", "for more information", "notes", "references", "supplementary", "to access a more user", "to view the full version"],
    },
    "magic": {
        "start": ["abstract", "introduction"],
        "remove": ["![", "---", "< less", "===", "about this guideline", "loading data...", "more >", "please visit the", "updates", "view section text", "write general section text"],
        "sections": ["acknowledgements", "acknowledgments", "authorship", "contributors", "date of publication", "declarations of interest", "disclaimer", "disclosure", "external reviewers", "funding", "isbn", "members", "previous versions in magicapp", "publication approval", "publisher", "references"],
    },
    "nice": {
        "drop": ["advice", "committee", "implementation", "team", "update"],
    },
    "spor": {
        "stop": ["Conflict of interest"],
    },
    "who": {
        "start": ["Introduction "],
        "remove": ["Under the terms of this licence", "|"],
        "stop": ["Acknowl"],
    },
    "wikidoc": {
        "remove": ["Associate Editor", "Click here", "Editor", "For patient information click here", "How to edit trial information", "Media:", "Template:", "To go back to the main page"],
        "stop": ["external links"],
    },
}


@dataclass(frozen=True)
class Article:
    """The columns of a raw article; a column that the source lacks is null."""

    df: DataFrame

    def col(self, *names: str) -> Column:
        found = [F.col(n) for n in names if n in self.df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    @property
    def text(self) -> Column:
        return T.strip(self.col("content", "text"))

    @property
    def title(self) -> Column:
        return self.col("title", "name")


Processor = Callable[[Article], dict[str, Column]]
_first_line = lambda c: F.split(c, "\n")[0]
_bare = lambda x: T.strip(F.replace(F.lower(x), F.lit("#"), F.lit("")))  # noqa: E731 - a line without its header marks
_some_words = lambda x: T.at_least_words(x, 3)


def _lines(c: Column, keep: Callable[[Column], Column], to: Callable[[Column], Column] = lambda x: x) -> Column:
    return T.unlines(F.transform(F.filter(T.lines(c), keep), to))


def enough(c: Column, lines: int, words: int = 10) -> Column:
    """Whether that many lines have more than that many words."""
    return F.size(F.filter(T.lines(c), lambda x: F.size(F.split(x, " ")) > words)) >= lines


def aafp(a: Article) -> dict[str, Column]:
    own = F.filter(T.lines(a.text), lambda x: x.startswith("The AAFP supports"))
    borrowed = F.coalesce((F.size(own) > 0) & T.strip(F.get(own, F.lit(0))).endswith("on this topic."), F.lit(False))
    title = F.replace(F.replace(T.strip(a.title), F.lit(" | AAFP"), F.lit("")), F.lit(" - Choosing Wisely"), F.lit(""))
    body = T.truncate(
        a.text,
        PHRASES["aafp"]["start"],
        PHRASES["aafp"]["remove"],
        PHRASES["aafp"]["stop"],
    )
    keep = lambda x, low: T.let(_bare(x), lambda b: ~T.single_letter_words(b) & ~low.startswith(b) & ~T.contains_any(b, ("|", "http")))
    rows = T.let(F.lower(title), lambda low: _lines(body, lambda x: keep(x, low)))
    return {"title": title, "text": F.when(~borrowed, T.clean(F.concat(title, F.lit("\n\n"), rows))), "url": a.col("url")}


def cco(a: Article) -> dict[str, Column]:
    body = T.truncate(
        a.text,
        PHRASES["cco"]["start"],
        PHRASES["cco"]["remove"],
    )
    bullet = lambda x: T.strip(x).startswith(T.BULLET)
    keep = lambda x: bullet(x) | (_some_words(x) & x.rlike("[a-zA-Z]"))
    to = lambda x: F.when(bullet(x), F.concat(F.lit("- "), T.strip(F.substring(x, 2, 2**31 - 1)))).otherwise(T.sub(x, "^o ", "- "))
    return {"text": T.clean(_lines(body, keep, to))}


def cdc(a: Article) -> dict[str, Column]:
    letters = lambda x: T.sub(F.lower(x), "[^a-zA-Z]")
    rows = F.filter(T.lines(T.strip(a.col("text", "content"))), lambda x: T.strip(T.sub(F.lower(x), f"[{T.BULLET}#]")) != "")
    stop = F.array_position(F.transform(rows, lambda x: ~x.startswith("q ") & letters(x).startswith("acknowledg")), True)
    rows = F.when(stop > 0, F.slice(rows, F.lit(1), (stop - 1).cast("int"))).otherwise(rows)

    def to(x: Column) -> Column:
        # a header is only recased when it has no letters: case is looked for after lower-casing
        return F.when(x.startswith("q "), F.concat(F.lit("- "), T.strip(F.substring(x, 3, 2**31 - 1)))).when(x.startswith("#") & (letters(x) == ""), T.capitalize_words(x)).otherwise(T.strip(x))

    return {"text": F.replace(T.clean(T.unlines(F.transform(rows, to))), F.lit("\n# -"), F.lit("\n#")), "doi": a.col("doi")}


def cdc_diseases(a: Article) -> dict[str, Column]:
    body = T.truncate(a.text, PHRASES["cdc_diseases"]["start"], PHRASES["cdc_diseases"]["remove"], PHRASES["cdc_diseases"]["stop"])
    keep = lambda x: _some_words(x) & ~T.contains_any(x, PHRASES["cdc_diseases"]["remove"])

    def to(x: Column) -> Column:
        for old, new in (("+ ", "- "), ("**", ""), ("*", "- ")):
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    listing = T.strip(_first_line(a.text)) == "### Disease Directory"
    return {"title": T.strip(F.substring(_first_line(body), 4, 2**31 - 1)), "text": F.when(~listing, F.concat(a.title, F.lit("\n\n"), _lines(body, keep, to)))}


def cma(a: Article) -> dict[str, Column]:
    title = _first_line(a.text)
    body = T.truncate(
        a.text,
        PHRASES["cma"]["start"],
        PHRASES["cma"]["remove"],
        PHRASES["cma"]["stop"],
    )
    return {"title": title, "text": T.clean(T.let(title, lambda t: F.concat(t, F.lit("\n\n"), _lines(body, lambda x: ~x.contains("|") & ~x.contains(t)))))}


def cma_pdfs(a: Article) -> dict[str, Column]:
    body = T.truncate(T.strip(a.col("text", "content")), stoppers=PHRASES["cma_pdfs"]["stop"])
    core = lambda x: F.lower(T.strip(T.sub(x, r"[#.]")))
    keep = lambda x: T.let(core(x), lambda k: ~k.isin("", T.BULLET) & ~T.is_digits(k))
    return {"text": T.clean(_lines(body, keep, lambda x: T.sub(x, r"(?U)^\d+\.\s", "- "))), "doi": a.col("doi")}


def cps(a: Article) -> dict[str, Column]:
    drop = PHRASES["cps"]["remove"]
    body = T.truncate(a.text, PHRASES["cps"]["start"], drop, PHRASES["cps"]["stop"])
    out = T.clean(_lines(body, lambda x: _some_words(x) & ~T.contains_any(x, drop), T.strip))
    return {"text": T.let(out, lambda x: F.when(F.size(T.lines(x)) >= 3, x))}


def drugs(a: Article) -> dict[str, Column]:
    body = F.array_join(F.filter(T.lines(a.text), lambda x: ~x.contains("|")), "\n")
    body = T.truncate(body, removers=PHRASES["drugs"]["remove"])
    body = T.strip(T.sub(F.translate(F.replace(body, F.lit("*"), F.lit("-")), "[]", ""), r"\([^)]+\)"))
    return {"title": T.strip(F.split(a.title, " - ")[0]), "text": T.clean(F.replace(body, F.lit("--"), F.lit(""))), "url": a.col("url", "link")}


def gc(a: Article) -> dict[str, Column]:
    named = T.strip(a.title) == "Title"
    quotes = lambda c: F.replace(F.replace(c, F.lit('["'), F.lit("")), F.lit('"]'), F.lit(""))
    raw = F.when(named, F.substring(a.text, 7, 2**31 - 1)).otherwise(a.text)
    body = T.truncate(quotes(raw), PHRASES["gc"]["start"], PHRASES["gc"]["remove"], PHRASES["gc"]["stop"])
    # at least three ASCII letters and digits, among them a letter and none of lower case
    head = lambda x: ~x.rlike("[a-z]") & x.rlike("[A-Z]") & x.rlike("[A-Z0-9](?:[^A-Z0-9]*+[A-Z0-9]){2}")
    rows = F.filter(F.transform(T.lines(body), T.strip), lambda x: x != "(c)")
    out = T.clean(T.unlines(F.transform(rows, lambda x: F.when(head(x), F.concat(F.lit("\n# "), x)).otherwise(x))))
    return {"title": quotes(F.when(named, "").otherwise(T.strip(a.title))), "text": T.let(out, lambda x: F.when(enough(x, 3), x))}


def icrc(a: Article) -> dict[str, Column]:
    body = T.truncate(a.col("text", "content"), stoppers=PHRASES["icrc"]["stop"])
    to = lambda x: F.when(x.rlike(r"(?U)^\d+[a-zA-Z]+"), F.concat(F.lit("- "), T.strip(F.substring(x, 2, 2**31 - 1)))).otherwise(x)
    return {"text": T.clean(_lines(body, lambda x: x.rlike("[a-zA-Z]"), to))}


def idsa(a: Article) -> dict[str, Column]:
    title = _first_line(a.text)
    body = T.truncate(
        a.text,
        PHRASES["idsa"]["start"],
        PHRASES["idsa"]["remove"],
        PHRASES["idsa"]["stop"],
    )
    # whether the bare line has digits alone before its first full stop
    numbered = lambda x: x.rlike(rf"(?U)^[{T.BLANKS}#]*+\d[\d#]*+(?:\.|[{T.BLANKS}#]*+\z)")
    # of a number without a full stop all but nothing is cut, as for any other
    after = lambda x, b: T.strip(F.substring(x, F.instr(b, ".") + 1, F.length(x)))
    keep = lambda x, low: numbered(x) | ~low.startswith(_bare(x))
    to = lambda x: F.when(numbered(x), F.concat(F.lit("- "), after(x, _bare(x)))).otherwise(x)
    rows = T.let(F.lower(title), lambda low: _lines(body, lambda x: keep(x, low), to))
    out = F.concat(title, F.lit("\n\n"), rows)
    for old, new in ((" ,", ""), (" .", "."), ("*", ""), (" )", ""), ("-. ", "- ")):
        out = F.replace(out, F.lit(old), F.lit(new))
    out = T.clean(out)
    draft = a.text.contains("This new guideline is currently in development")
    return {"title": title, "text": T.let(out, lambda x: F.when(~draft & (F.size(T.lines(x)) >= 5), x)), "url": a.col("url")}


@F.pandas_udf(StringType())
def _magic_headers(s):  # noqa: ANN001
    """A line between two lines of digits is a header; the walk skips what it has used, so it is no window."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        x = t.split("\n")
        out, i = [], 0
        while i + 2 < len(x) and i != len(x) - 3:
            a, b, c = (y.strip() for y in x[i : i + 3])
            head = a.isdigit() and not b.isdigit() and c.isdigit()
            out.append(f"# {b}" if head else b)
            i += 2 if head else 1
        return "".join(o + "\n" for o in out) + ("\n".join(x[i:]) if i == len(x) - 3 else "")

    return s.map(one, na_action="ignore")


def magic(a: Article) -> dict[str, Column]:
    chunks = F.filter(F.split(a.text, "Loading Data\\.\\.\\.\n"), lambda x: ~T.contains_any(x, ("Write header here", "Write remark here")))
    body = _magic_headers(F.array_join(F.transform(chunks, lambda x: F.concat(x, F.lit("\n\n"))), ""))
    body = T.truncate(body, PHRASES["magic"]["start"], PHRASES["magic"]["remove"])
    body = T.sub(_lines(body, lambda x: (_bare(x) != "") & ~x.contains("|"), T.strip), "\n+", "\n")
    for old, new in (("\n**", "\n## "), ("*", ""), ("\n(", "("), ("\n)", ")"), ("\n;", ";")):
        body = F.replace(body, F.lit(old), F.lit(new))
    drop = PHRASES["magic"]["sections"]
    sections = F.filter(F.split(T.strip(body), "\n\n"), lambda x: ~_first_line(x).rlike("^" + T.letters_start(drop)))
    body = F.array_join(F.transform(sections, lambda x: F.concat(x, F.lit("\n\n"))), "")
    # of ASCII letters, digits and spaces, digits alone that no space parts
    number = lambda x: x.rlike(f"^[^{T.LETTERS}0-9]*+[0-9][^{T.LETTERS} ]*+(?: [^{T.LETTERS}0-9]*+)?\\z")
    long_head = lambda x: x.startswith("#") & (F.size(F.split(x, " ")) > 7)
    rows = _lines(body, lambda x: ~x.startswith("!") & ~number(x), lambda x: F.when(long_head(x), T.strip(F.replace(x, F.lit("#"), F.lit("")))).otherwise(x))
    return {"text": T.clean(rows)}


def mayo(a: Article) -> dict[str, Column]:
    body = T.clean(T.concatenate_sections(F.col("content")))
    return {"title": a.title, "text": F.array_join(F.filter(T.lines(body), lambda x: ~x.contains("MayoClinic")), "\n")}


def nice(a: Article) -> dict[str, Column]:
    low = lambda s: F.lower(s["name"])
    kept = F.filter(F.col("content"), lambda s: low(s).contains("discussion") | ~T.contains_any(low(s), PHRASES["nice"]["drop"]))
    name, overview = a.col("name"), a.col("overview")
    head = lambda c: F.when(F.length(c) > 0, F.concat(c, F.lit("\n\n"))).otherwise("")
    return {"title": name, "url": a.col("url"), "overview": overview, "text": F.when(F.size(kept) > 0, F.concat(head(name), head(overview), T.clean(T.concatenate_sections(kept))))}


def rch(a: Article) -> dict[str, Column]:
    return {"title": a.title, "url": a.col("url"), "text": a.col("content", "text")}


def spor(a: Article) -> dict[str, Column]:
    body = F.replace(F.replace(T.truncate(a.text, stoppers=PHRASES["spor"]["stop"]), F.lit("|"), F.lit("")), F.lit("---"), F.lit("\n"))
    return {"text": T.clean(_lines(body, _some_words, T.strip))}


def who(a: Article) -> dict[str, Column]:
    body = T.truncate(a.text, PHRASES["who"]["start"], PHRASES["who"]["remove"], PHRASES["who"]["stop"])
    rows = _lines(body, _some_words, lambda x: T.strip(F.replace(x, F.lit(T.BULLET + " "), F.lit("- "))))
    return {"text": T.clean(F.replace(rows, F.lit("\ue031"), F.lit("")))}


def wikidoc(a: Article) -> dict[str, Column]:
    body = T.truncate(a.col("text", "content"), removers=PHRASES["wikidoc"]["remove"], stoppers=PHRASES["wikidoc"]["stop"])

    notice = "Any recommendations found on these pages"
    # from a notice to the next header nothing stays; a section is a header with what follows, or what stands before the first
    sections = F.split(body, "\n(?=#)")
    kept = lambda s: F.when(s.startswith(notice), F.array().cast("array<string>")).otherwise(F.filter(T.lines(F.substring_index(s, "\n" + notice, 1)), lambda x: ~x.startswith("CLASS")))
    rows = F.flatten(F.transform(sections, kept))
    out = T.clean(T.sub(T.unlines(rows), "(?d)Redirect to.*"))
    urls = F.col("urls") if "urls" in a.df.columns else F.array(a.col("url"))
    return {"title": a.title, "url": F.get(urls, F.lit(0)), "text": T.let(out, lambda x: F.when(enough(x, 3), x))}


PROCESSORS: dict[str, Processor] = {f.__name__: f for f in (aafp, cco, cdc, cdc_diseases, cma, cma_pdfs, cps, drugs, gc, icrc, idsa, magic, mayo, nice, rch, spor, who, wikidoc)}
ALIASES = {"guidelinecentral": "gc"}
RECORD = ("source", "title", "clean_text", "raw_text", "url", "overview")


def process(df: DataFrame, source: str) -> DataFrame:
    """``df`` and the canonical record: source is the name up to its first underscore, raw_text what came in."""
    made = PROCESSORS[ALIASES.get(source, source)](Article(df))
    # the text comes out of an outer generator: a filter, or the one that is inferred for an inner one, would be pushed below and
    # have it computed twice
    raw = next((F.col(c) for c in ("content", "text") if c in df.columns), F.lit(None))
    kind = df.schema[next(c for c in ("content", "text") if c in df.columns)].dataType.typeName()
    none = F.lit(None).cast("string")
    out = {"source": F.lit(source.split("_")[0]), "title": made.get("title", none), "clean_text": F.array(made["text"]), "raw_text": raw if kind == "string" else F.to_json(raw), "url": made.get("url", none), "overview": made.get("overview", none)}
    made = df.select(*[F.col(c) for c in df.columns if c not in RECORD], *[c.alias(n) for n, c in out.items()])
    return made.select(*[F.explode_outer(c).alias(c) if c == "clean_text" else F.col(c) for c in made.columns]).filter("clean_text is not null")


def build(df: DataFrame, source: str, order: str, detect: Callable[[Column], Column] | None = lang.detect, min_chars: int = 10) -> DataFrame:
    """Process, keep English (by ``detect``, unless that is None), keep the first of equal fingerprints, keep what is long enough.
    The cleaned articles are written once; after that only keys are compared."""
    out = process(df, source)
    if detect is not None:
        out = out.filter(detect(F.substring("clean_text", 1, 10_000)) == "en")
    return dedup.first_by_prefix(stage(out, "processed"), "clean_text", order, by=["source"]).filter(F.length("clean_text") > min_chars)
