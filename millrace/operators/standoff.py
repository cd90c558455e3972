"""Articles with stand-off annotations, rendered to text with inline marks.

Annotations are spans over the raw text, by type, as JSON. Spans are painted in a fixed order of types, later types
over earlier ones; runs of one paint are rendered in turn. The painting and rendering is per document and sequential,
so it is one Arrow UDF; its clean-up is native.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TYPES = tuple("authorfirstname authorlastname authoraffiliation bibentry formula sectionheader bibref figureref tableref figure".split())
OTHERS = tuple("bibtitle bibauthorlastname figurecaption abstract".split())
PLAIN, HEAD = "T", "P"
_FIXED = {"authorfirstname": "RM", "authorlastname": "RM", "authoraffiliation": "RM", "bibentry": "BIB", "formula": "FML", "sectionheader": "SEC"}


@dataclass(frozen=True)
class Options:
    header: bool = False
    figures: bool = True
    tables: bool = True
    bibliography: bool = False

    def special_tokens(self) -> list[str]:
        names = ["bib_ref", "fig_ref", "formula", *(["fig"] if self.figures else []), *(["table"] if self.tables else []), *(["bib"] if self.bibliography else [])]
        return [f"[{s}{n}]" for n in names for s in ("", "/")]


class Article:
    """One article; annotations are decoded once, on first use."""

    def __init__(self, text: str, annotations: dict[str, str | None], options: Options):
        self.text, self.raw, self.options, self._decoded, self._memo = text, annotations, options, {}, {}

    def spans(self, kind: str) -> list[dict]:
        if kind not in self._decoded:
            found = json.loads(self.raw.get(kind) or "[]")
            self._decoded[kind] = [{**x, "start": int(x["start"]), "end": int(x["end"])} for x in found]
        return self._decoded[kind]

    def paint(self) -> tuple[np.ndarray, list[str]]:
        """(paint of each character, names of the paints)."""
        names = [PLAIN]
        number = {PLAIN: 0}
        out = np.zeros(len(self.text), dtype=np.int32)

        def put(a: int, b: int, name: str) -> None:
            if name not in number:
                number[name] = len(names)
                names.append(name)
            out[max(a, 0) : b] = number[name]

        for kind in TYPES:
            for x in self.spans(kind):
                a, b = x["start"], x["end"]
                if kind in _FIXED:
                    put(a, b, _FIXED[kind])
                elif kind == "figure":
                    parts = str((x.get("attributes") or {}).get("id", "")).split("_")
                    if len(parts) > 1:
                        put(a, b, f"{parts[0].upper()}_{parts[1]}")
                else:
                    before, after = self.text[a - 3 : a] if a >= 3 else "", self.text[b : b + 3]
                    a = a - 3 + before.index("(") if "(" in before else a
                    b = b + after.index(")") + 1 if ")" in after else b
                    if "attributes" not in x:
                        put(a, b, "b?")
                    elif "ref_id" in (x["attributes"] or {}):
                        put(a, b, str(x["attributes"]["ref_id"]))
        if not self.options.header:
            # a body that starts at 0 has no header; without section headers the header is left alone
            abstract, sections = self.spans("abstract"), self.spans("sectionheader")
            starts = [abstract[0]["start"]] if abstract and abstract[0]["start"] else []
            starts += [min(s["start"] for s in sections)] if sections else []
            if starts and min(starts):
                names.append(HEAD)
                head = out[: min(starts)]
                head[head == 0] = len(names) - 1
        return out, names

    def inside(self, kind: str, span: dict) -> dict | None:
        return next((x for x in self.spans(kind) if x["start"] >= span["start"] and x["end"] <= span["end"]), None)

    def named(self, kind: str, ident: str) -> dict | None:
        return next((x for x in self.spans(kind) if (x.get("attributes") or {}).get("id") == ident), None)

    def cite(self, ident: str, most: int = 12) -> str | None:
        """Title and first author's last name of a bibliography entry."""
        entry = self.named("bibentry", ident)
        title, author = (self.inside(k, entry) for k in ("bibtitle", "bibauthorlastname")) if entry else (None, None)
        if not title or not author:
            return None
        t, n = self.text[title["start"] : title["end"]], self.text[author["start"] : author["end"]]
        return f"{_first_words(t, most)}, {n}" if t and n else None

    def figure(self, ident: str, most: int | None = 12) -> tuple[str, str] | None:
        """Name (with its colon) and caption of a figure or table."""
        fig = self.named("figure", ident)
        cap = self.inside("figurecaption", fig) if fig else None
        if not cap or not cap["start"]:
            return None
        above = self.text[fig["start"] : cap["start"]].split("\n")
        if len(above) < 2:
            return None
        prefix = above[1]
        name = re.sub("[:()]", "", prefix.replace(" .", " "))
        for old, new in (("Fig.", "Figure"), ("Tab.", "Table"), (" Figure", ", Figure")):
            name = name.replace(old, new)
        name = name.strip()
        caption = self.text[cap["start"] : cap["end"]].replace(prefix, "").strip() if prefix else self.text[cap["start"] : cap["end"]].strip()
        if most:
            caption = _first_words(re.split("[.;:()]", caption)[0] if len(caption) > 20 else caption, most)
        if not caption.split():
            return None
        if caption.split()[0].isdigit():
            name, caption = f"{name} {caption.split()[0]}", " ".join(caption.split()[1:])
        caption = re.sub(r"^(?:[.,)]\s*)+", "", caption)
        return (f"{name}: " if name else ""), caption

    def render(self) -> str | None:
        if not self.text:
            return None
        paint, names = self.paint()
        cuts = np.flatnonzero(np.diff(paint)) + 1
        out: list[str] = []
        shown: list[str] = []
        after_figures = False
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(paint)).tolist()):
            part = self.text[a:b].strip().replace(T.BULLET, "- ")
            kind = names[paint[a]]
            if not part:
                continue
            if kind == PLAIN:
                if not after_figures:
                    out.append(part)
            elif kind == "SEC":
                part = f"{part[:1].upper()}{part[1:].lower()}"
                out.append(f"\n{'#' if _is_main(part) else '##'} {part}\n")
            elif kind == "BIB":
                if self.options.bibliography:
                    out.append(f" [bib] {part} [/bib]\n")
            elif kind == "FML":
                out.append(f"\n[formula] {part} [/formula]\n")
            elif "fig_" in kind or "tab_" in kind:
                if s := self._once(("f", kind), lambda k=kind: "".join(self.figure(k) or ())):
                    out.append(f" [fig_ref] {s} [/fig_ref] ")
            elif kind == "b?":
                out.append(" ")
            elif "FIG_" in kind or "TAB_" in kind:
                after_figures = True
                tag = "fig" if "FIG_" in kind else "table"
                if not (self.options.figures if tag == "fig" else self.options.tables):
                    continue
                head, _, rest = kind.partition("_")
                fig = self.figure(f"{head.lower()}_{rest}", None)
                if fig and all(fig) and "continued" not in "".join(fig).lower() and not any(re.sub("[:,()]", "", s.strip()) in fig[0].lower() for s in shown):
                    shown.append(fig[0].lower())
                    out.append(f"\n[{tag}] {''.join(fig)} [/{tag}]\n")
            elif "b" in kind:
                if s := self._once(("b", kind), lambda k=kind: self.cite(k)):
                    out.append(f" [bib_ref] {s} [/bib_ref] ")
        return "".join(out)

    def _once(self, key, make):
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]


def _first_words(s: str, most: int) -> str:
    w = s.split()
    return " ".join(w[:most]) + "..." if len(w) > most else s


def _is_main(s: str) -> bool:
    return len(s.split(" ")) <= 3 and any(m in s.lower() for m in T.MAIN_SECTIONS)


def render(text: Column, annotations: Column, options: Options = Options()) -> Column:
    """``annotations``: a struct of JSON strings. An article whose annotations can't be read is null."""

    def one(s: str | None, ann: dict[str, str | None] | None) -> str | None:
        try:
            return Article(s, ann or {}, options).render() if s else None
        except (ValueError, KeyError, TypeError, IndexError):
            return None

    @F.arrow_udf("string")
    def run(t: pa.Array, a: pa.Array) -> pa.Array:
        # article by article, so that no batch is there a second time as Python strings
        made = pa.array((one(s.as_py(), x.as_py()) for s, x in zip(t, a)), pa.string())
        pa.default_memory_pool().release_unused()
        return made

    return T.squeeze_article(run(text, annotations))


def full_texts(df: DataFrame, options: Options = Options(), english: Column | None = None) -> DataFrame:
    """Rendered articles: text in, language, rendering, title before; the raw content goes."""
    d = df.filter(F.length("content.text") > 0)
    d = d.filter(english) if english is not None else d
    d = d.withColumn("text", render(F.col("content.text"), F.col("content.annotations"), options)).drop("content").filter("text is not null")
    return with_title(d, "\n\n")


def abstracts(df: DataFrame, order: str, key: str = "corpusid", english: Column | None = None) -> DataFrame:
    """Cleaned abstracts: the first of each id counts, even where it is then left out for its text or language."""
    from . import dedup

    d = dedup.first_by_id(df, key, order, wide=True).withColumnRenamed("abstract", "text").filter(F.length("text") > 0)
    d = d.filter(english) if english is not None else d
    d = with_title(d, "\n").withColumn("text", T.remove_references(T.remove_urls(F.col("text"))))
    return d.drop("openaccessinfo") if "openaccessinfo" in d.columns else d


def with_title(df: DataFrame, sep: str) -> DataFrame:
    return df.withColumn("text", F.when(F.length("title") > 0, F.concat("title", F.lit(sep), "text")).otherwise(F.col("text"))) if "title" in df.columns else df
