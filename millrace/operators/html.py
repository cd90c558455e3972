"""HTML to markdown-like text, by rules of four kinds of sites; an Arrow UDF around the standard library's parser."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MUTE = frozenset(("script", "style", "noscript", "template"))


@dataclass
class Node:
    tag: str
    ident: str
    path: tuple[tuple[str, str, str], ...]  # (tag, id, class) of the ancestors, nearest first
    text: str = ""


class _Tree(HTMLParser):
    """Elements of the wanted tags in document order, with the text below each."""

    def __init__(self, tags: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.tags, self.nodes, self.open = tags, [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "br":
            self.handle_data("\n")
        if tag in _VOID:
            return
        if tag in ("p", "li"):  # an open one of the kind ends where the next begins
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag:
                    del self.open[i:]
                    break
                if self.open[i][0] in ("ul", "ol", "div", "table", "section", "article", "td"):
                    break
        node = None
        if tag in self.tags:
            node = Node(tag, a.get("id") or "", tuple((t, i, c) for t, i, c, _ in reversed(self.open)))
            self.nodes.append(node)
        self.open.append((tag, a.get("id") or "", a.get("class") or "", node))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if any(o[0] in _MUTE for o in self.open):
            return
        for o in self.open:
            if o[3] is not None:
                o[3].text += data


def nodes(html: str, tags: str) -> list[Node]:
    t = _Tree(frozenset(tags.split()))
    t.feed(html)
    t.close()
    return t.nodes


def encyclopaedia(html: str) -> str:
    """Headings, paragraphs and list items outside tables of contents and tables, up to the references."""
    out = []
    marks = {"h1": "\n\n# ", "h2": "\n\n# ", "h3": "\n\n## ", "h4": "\n\n### ", "li": "\n- "}
    for n in nodes(html, "h1 h2 h3 h4 p li"):
        if any(t == "table" or (t == "div" and i.startswith("toc")) for t, i, _ in n.path):
            continue
        text = n.text.strip()
        if n.tag[0] == "h" and (text == "References" or text.startswith("See also")):
            break
        if n.tag == "p":
            if any(t == "li" for t, _, _ in n.path):
                continue
            text = "\n".join(x for x in text.split("\n") if x.strip() and not x.startswith(("|", "{{", "}}")))
            out.append("\n" + text if text else "")
        else:
            out.append(marks[n.tag] + text)
    return "".join(out).strip()


def patient(html: str) -> str:
    """Second headings, paragraphs and list items, without references, tables of contents and nested content."""
    out = []
    for n in nodes(html, "h2 p li"):
        text = n.text.strip()
        kinds = " ".join(c for _, _, c in n.path)
        if not text or any(x in kinds for x in ("tableofcontents", "acces-list-container", "references")) or sum(t == "div" and "content" in c.split() for t, _, c in n.path) > 1:
            continue
        out.append({"h2": "\n ", "li": "\n- ", "p": "\n"}[n.tag] + text)
    return "".join(out).strip()


def guidance(html: str) -> str:
    """Third and fourth headings and paragraphs, without their numbers and [n]."""
    out = [{"h3": "\n\n# ", "h4": "\n\n## ", "p": "\n"}[n.tag] + re.sub(r"^\d+(\.\d+)*\s*", "", n.text.strip()) for n in nodes(html, "h3 h4 p")]
    return re.sub(r"\[\d+\]", "", "".join(out)).lstrip("\n")


def hospital(html: str) -> str:
    """From the key points if there are any, up to the date or the notes; lists once, with their inner lines indented."""
    found = nodes(html, "h2 h3 p li")
    start = next((k for k, n in enumerate(found) if n.ident == "key-points"), 0)
    out = []
    for n in found[start:]:
        if any(t == "table" and "table" in c.split() for t, _, c in n.path):
            continue
        text = n.text.strip().replace("  ", " ").replace("*", "")
        if not text or sum(t == "li" for t, _, _ in n.path) > 1:
            continue
        if text.startswith("Last updated") or (n.tag == "h2" and any(x in text for x in ("Parent information", "Additional", "References"))):
            break
        out.append({"h2": "\n\n# ", "h3": "\n\n## ", "p": "\n"}[n.tag] + text if n.tag != "li" else "\n- " + text.replace("\n", "\n\t- "))
    return "".join(out).strip()


FLAVOURS = {"encyclopaedia": encyclopaedia, "patient": patient, "guidance": guidance, "hospital": hospital}


def to_text(html: Column, flavour: str = "encyclopaedia") -> Column:
    rule = FLAVOURS[flavour]

    @F.arrow_udf("string")
    def convert(pages: pa.Array) -> pa.Array:
        # page by page, so that no batch is there a second time as Python strings
        made = pa.array((None if (x := p.as_py()) is None else rule(x) for p in pages), pa.string())
        pa.default_memory_pool().release_unused()
        return made

    return convert(html)


#: By site flavour: which sections of an article are taken, and what is cut from their names.
SECTION_RULES = {"patient": (r"Symptoms|Diagnosis", None), "guidance": (None, r"^\s*\d+\s*")}


def site_sections(sections: Column, flavour: str) -> Column:
    """Of an article's sections, an array of (name, html), those that are wanted, as (name, body)."""
    wanted, cut = SECTION_RULES[flavour]
    rule = FLAVOURS[flavour]
    kept = F.filter(sections, lambda s: s["name"].rlike(wanted)) if wanted else sections
    name = (lambda s: F.regexp_replace(s["name"], cut, "")) if cut else (lambda s: s["name"])

    @F.pandas_udf("array<string>")
    def bodies(pages: pd.Series) -> pd.Series:
        return pages.map(lambda xs: [rule(x) if x is not None else None for x in xs], na_action="ignore")

    made = bodies(F.transform(kept, lambda s: s["html"]))
    return F.zip_with(F.transform(kept, name), made, lambda n, b: F.struct(n.alias("name"), b.alias("body")))


def links(html: Column) -> Column:
    """Distinct link targets in order."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1)))


def guideline_link(url: Column, kind: str = "pdf", host: str | None = None) -> Column:
    """Link predicates of the scraped sites."""
    low = F.lower(url)
    ok = low.endswith(".pdf") if kind == "pdf" else ~(low.contains("choosing") | low.contains("choisir")) if kind == "page" else low.contains(kind)
    return ok & (F.parse_url(url, F.lit("HOST")) == host) if host else ok
