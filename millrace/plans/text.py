"""Queries of the text functions and source processors. The documents hold none of what cleaning removes, so a constant
noisy ending is put after each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import guidelines, html, sampling, standoff
from ..sources import io
from . import processors_sql
from . import sql as S
from .registry import query, table

NOISE = "\n## Head one\n#### Deep [1] b [t](u) here\nsee http://a.b/c?x=1 now\n* item two\n• dot\nof y and more words\n+ plus\n◆ x ** y\n123\n\n> quote <i>c</i> end\n*- star\nReferences\nlast line"
_X = f"text || {S.lit(NOISE)}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.concat("text", F.lit(NOISE)).alias("text"))


def _step(spark: SparkSession, d: str, f) -> DataFrame:
    return _noisy(spark, d).select("doc_id", f(F.col("text")).alias("text"))


def _step_sql(f) -> str:
    return f"WITH n AS (SELECT doc_id, {_X} AS t FROM documents) SELECT doc_id, {f('t')} AS text FROM n"


@query(_step_sql(S.remove_urls))
def remove_urls(spark, d):
    return _step(spark, d, T.remove_urls)


@query(_step_sql(S.remove_references))
def remove_references(spark, d):
    return _step(spark, d, T.remove_references)


@query(_step_sql(S.normalize_lists))
def normalize_lists(spark, d):
    return _step(spark, d, T.normalize_lists)


@query(_step_sql(S.normalize_sections))
def normalize_sections(spark, d):
    return _step(spark, d, T.normalize_sections)


@query(_step_sql(S.remove_weird_chars))
def remove_weird_chars(spark, d):
    return _step(spark, d, T.remove_weird_chars)


@query(_step_sql(S.normalize_newlines))
def normalize_newlines(spark, d):
    return _step(spark, d, T.normalize_newlines)


@query(f"WITH {S.clean_ctes('documents', _X, 'doc_id')} SELECT doc_id, t AS text FROM c6")
def clean_text(spark, d):
    return _step(spark, d, T.clean)


STARTERS, REMOVERS, STOPPERS = ("the ", "head"), ("see", "in "), ("references", "erthst")


def _any(x: str, prefixes: tuple[str, ...]) -> str:
    low = f"lower({x})"
    forms = [x, S.strip(low), S.strip(S.rep(low, "#")), S.strip(S.sub(low, "[^a-zA-Z ]"))]
    return "(" + " OR ".join(f"starts_with({f}, {S.lit(p)})" for f in forms for p in prefixes) + ")"


@query(f"""
WITH l AS (SELECT doc_id, i, x, {_any('x', STARTERS)} AS s, {_any('x', REMOVERS)} AS r, {_any('x', STOPPERS)} AS p, NOT regexp_matches(x, '[a-zA-Z]') AS b
  FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, {S.lines(_X)} AS ls FROM documents))),
a AS (SELECT doc_id, min(CASE WHEN s THEN i END) AS i0, count(*) AS n FROM l GROUP BY doc_id),
z AS (SELECT l.doc_id, any_value(i0) AS i0, coalesce(min(CASE WHEN p AND NOT r AND i IS DISTINCT FROM i0 THEN i END), any_value(n)) AS stop FROM l JOIN a USING (doc_id) GROUP BY l.doc_id),
k AS (SELECT l.doc_id, i, x FROM l JOIN z USING (doc_id) WHERE i < stop AND CASE WHEN i0 IS NULL OR stop < i0 THEN NOT r AND NOT b ELSE i = i0 OR (i > i0 AND NOT r AND NOT b) END)
SELECT d.doc_id, {S.strip("coalesce(string_agg(k.x, chr(10) ORDER BY k.i), '')")} AS text FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id
""")
def truncate_lines(spark, d):
    return _step(spark, d, lambda c: T.truncate(c, STARTERS, REMOVERS, STOPPERS))


@query(f"SELECT doc_id, {S.fingerprint('text')} AS fingerprint FROM documents")
def prefix_fingerprint(spark, d):
    return _docs(spark, d).select("doc_id", T.prefix_fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split(text, chr(10)), lambda l: len(string_split(l, ' ')) > 10)) >= 3")
def min_content(spark, d):
    return _docs(spark, d).filter(guidelines.enough(F.col("text"), 3)).select("doc_id")


@query(f"""SELECT doc_id, CASE WHEN {S.words('c')} > 8 THEN array_to_string(list_filter(string_split_regex(c, {S.lit('[' + T.BLANKS + ']+')}), lambda w: w <> '')[1:8], ' ') || '...' ELSE c END AS caption
FROM (SELECT doc_id, CASE WHEN length(text) > 20 THEN string_split_regex(text, '[.;:()]')[1] ELSE text END AS c FROM documents)""")
def summarize_captions(spark, d):
    return _docs(spark, d).select("doc_id", T.summarize_caption(F.col("text"), 8).alias("caption"))


_MAIN = " OR ".join(f"contains(lower(p_name), {S.lit(m)})" for m in T.MAIN_SECTIONS)


@query(f"""SELECT p_partkey, upper(substring(p_name, 1, 1)) || lower(substring(p_name, 2)) AS header, (len(string_split(p_name, ' ')) <= 3 AND ({_MAIN})) AS main,
array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(substring(w, 1, 1)) || lower(substring(w, 2))), ' ') AS words, len(string_split(p_name, ' ')) AS n FROM part""")
def section_headers(spark, d):
    c = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", T.capitalize(c).alias("header"), T.is_main_section(c).alias("main"), T.capitalize_words(F.col("p_type")).alias("words"), F.size(F.split(c, " ")).cast("long").alias("n"))


_REF = "p_brand || ', J, Roe, K. On ' || p_name || '. part two. J Med ' || (1990 + p_size) || ';5:1.'"
_C = "regexp_replace(c, '[.]$', '')"


@query(f"""SELECT p_partkey, string_split(string_split(c, '.')[1], ', ')[1] AS author, regexp_extract(regexp_extract(c, '(?s)^(.*);', 1), '([^ ]*)$', 1) AS year,
substring({_C}, strpos({_C}, '.') + 2, length({_C}) - strpos(reverse({_C}), '.') + 1 - strpos({_C}, '.') - 1) AS title FROM (SELECT p_partkey, {_REF} AS c FROM part)""")
def citation_parse(spark, d):
    p = table(spark, d, "part")
    c = F.concat("p_brand", F.lit(", J, Roe, K. On "), "p_name", F.lit(". part two. J Med "), (F.lit(1990) + F.col("p_size")).cast("string"), F.lit(";5:1."))
    return p.select("p_partkey", T.citation_author(c).alias("author"), T.citation_year(c).alias("year"), T.citation_title(c).alias("title"))


@query("""SELECT k // 20 AS batch, string_agg(q, ' OR ' ORDER BY p_partkey) AS query FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS k,
'(' || p_name || '[Title] AND ' || p_brand || '[Author - First] AND ' || (1990 + p_size) || '[Date - Publication])' AS q FROM part) GROUP BY 1 HAVING count(*) = 20""")
def search_queries(spark, d):
    """Queries in full batches of 20, by rank of the key."""
    q = T.citation_query(F.col("p_brand"), (F.lit(1990) + F.col("p_size")).cast("string"), F.col("p_name"))
    p = sampling.numbered(table(spark, d, "part").select("p_partkey", q.alias("q")), "p_partkey", "q")
    g = p.groupBy(F.floor((F.col("rank") - 1) / 20).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("rank", "q"))).alias("xs")).filter(F.size("xs") == 20)
    return g.select("batch", F.array_join(F.transform("xs", lambda x: x["q"]), " OR ").alias("query"))


@query("SELECT doc_id, sha1(text) AS sha1, sha256(encode(text)[1:400]) AS sha256, length(text) AS n FROM documents")
def content_hashes(spark, d):
    return _docs(spark, d).select("doc_id", F.sha1("text").alias("sha1"), T.sha256_prefix(F.encode("text", "utf-8")).alias("sha256"), F.length("text").cast("long").alias("n"))


@query("SELECT event_id, user_id, json_extract_string(props, '$.' || k) AS value, k FROM (SELECT *, unnest(json_keys(props)) AS k FROM events)")
def event_properties(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.from_json("props", "map<string,string>").alias("m"))
    return e.select("event_id", "user_id", F.explode("m").alias("k", "value"))


def raw_articles(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The documents as raw articles of a source."""
    x = F.concat(F.lit("Introduction to this\n### Abstract of it\nOverview of the guideline for all\n"), "text", F.lit(NOISE))
    docs = _docs(spark, d).select("doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), x.alias("text"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")).alias("url"))
    if name in ("mayo", "nice"):
        parts = F.array(F.struct(F.lit("Symptoms discussion").alias("name"), F.col("text").alias("body")), F.struct(F.lit("Update information").alias("name"), F.lit("gone").alias("body")))
        docs = docs.select("doc_id", F.col("title").alias("name"), parts.alias("content"), "url", F.lit("An overview").alias("overview"))
    return docs


def _guideline(spark: SparkSession, d: str, name: str) -> DataFrame:
    return guidelines.process(raw_articles(spark, d, name), name).select("doc_id", "source", "title", "clean_text", "url")


def _processor(name: str):
    def run(spark, d):
        return _guideline(spark, d, name)

    run.__name__ = f"process_{name}"
    return run


_RAW = f"'Introduction to this' || chr(10) || '### Abstract of it' || chr(10) || 'Overview of the guideline for all' || chr(10) || {_X}"
for _n in processors_sql.NAMES:
    query(processors_sql.processor_sql(_n, _RAW))(_processor(_n))

query(f"SELECT doc_id, 'rch' AS source, 'Title ' || doc_id AS title, {_RAW} AS clean_text, 'http://x/' || doc_id AS url FROM documents")(_processor("rch"))
_STOP = _any("x", ("conflict of interest",))
query(f"""
WITH l AS (SELECT doc_id, i, x, {_STOP} AS p, NOT regexp_matches(x, '[a-zA-Z]') AS b FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS x FROM (SELECT doc_id, {S.lines(S.strip(_RAW))} AS ls FROM documents))),
z AS (SELECT doc_id, coalesce(min(CASE WHEN p THEN i END), count(*)) AS stop FROM l GROUP BY doc_id),
u AS (SELECT doc_id, replace(replace({S.strip("string_agg(x, chr(10) ORDER BY i)")}, '|', ''), '---', chr(10)) AS t FROM l JOIN z USING (doc_id) WHERE i < stop AND NOT b GROUP BY doc_id),
w AS (SELECT doc_id, array_to_string(list_transform(list_filter({S.lines('t')}, lambda y: {S.words('y')} >= 3), lambda y: {S.strip('y')} || chr(10)), '') AS t0 FROM u),
{S.clean_ctes('w', 't0', 'doc_id')}
SELECT doc_id, 'spor' AS source, CAST(NULL AS VARCHAR) AS title, t AS clean_text, CAST(NULL AS VARCHAR) AS url FROM c6
""")(_processor("spor"))


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' AND length(text) > 10")
def lang_filter_given(spark, d):
    return _docs(spark, d).filter((F.col("lang") == "en") & (F.length("text") > 10)).select("doc_id", "lang")


def _html(flavour: str):
    def run(spark, d):
        p = table(spark, d, "pages")
        return p.select("page_id", html.to_text(F.col("html"), flavour).alias("text"))

    run.__name__ = f"html_{flavour}"
    return run


for _f in html.FLAVOURS:
    query()(_html(_f))


@query(r"""SELECT page_id, link FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1))) AS link FROM pages)""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("link"))


@query("SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, ends_with(lower(url), '.pdf') AS pdf, NOT (contains(lower(url), 'choosing') OR contains(lower(url), 'choisir')) AS page FROM pages")
def link_predicates(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", "url", F.parse_url(u, F.lit("HOST")).alias("host"), html.guideline_link(u).alias("pdf"), html.guideline_link(u, "page").alias("page"))


@query("SELECT page_id, regexp_replace(url, '\\b\\d+(?:\\.\\d+){1,3}\\b', '#', 'g') AS title FROM (SELECT page_id, page_id || '.' || page_id || ' ' || url AS url FROM pages)")
def dotted_titles(spark, d):
    u = F.concat_ws(".", "page_id", "page_id")
    return table(spark, d, "pages").select("page_id", T.dotted_numbers_to_hash(F.concat(u, F.lit(" "), "url")).alias("title"))


def annotated(docs: DataFrame) -> DataFrame:
    """The documents as articles with annotations: the first line a header, the second a figure caption, and references."""
    n = F.length("text").cast("long")
    span = lambda a, b, attrs="": F.concat(F.lit('[{"start":'), a.cast("string"), F.lit(',"end":'), b.cast("string"), F.lit(attrs + "}]"))
    first = F.instr("text", "\n").cast("long")
    head = F.when(first > 1, first - 1).otherwise(n)
    bib = F.greatest(n - 60, head)
    a = {
        "sectionheader": span(F.lit(0), head),
        "bibref": span(head + 1, F.least(head + 9, n), ',"attributes":{"ref_id":"b0"}'),
        "bibentry": span(bib, n, ',"attributes":{"id":"b0"}'),
        "bibtitle": span(bib, F.least(bib + 30, n)),
        "bibauthorlastname": span(F.least(bib + 31, n), F.least(bib + 40, n)),
        "formula": span(F.least(head + 40, n), F.least(head + 60, n)),
    }
    fields = [F.coalesce(a.get(t, F.lit(None)), F.lit(None).cast("string")).alias(t) for t in (*standoff.TYPES, *standoff.OTHERS)]
    return docs.select("doc_id", F.struct(F.col("text").alias("text"), F.struct(*fields).alias("annotations")).alias("content"), F.concat(F.lit("Article "), F.col("doc_id").cast("string")).alias("title"))


@query()
def standoff_render(spark, d):
    return standoff.full_texts(annotated(_docs(spark, d))).select("doc_id", "text")


@query(f"SELECT doc_id, {S.remove_references(S.remove_urls('t'))} AS text FROM (SELECT doc_id, {_X} AS t FROM documents)")
def abstract_clean(spark, d):
    a = _noisy(spark, d).withColumnRenamed("text", "abstract")
    return standoff.abstracts(a, "doc_id", "doc_id").select("doc_id", "text")


@query("SELECT doc_id, CASE WHEN contains(p, 's2orc') THEN 's2orc' WHEN contains(p, 'abstracts') THEN 'abstracts' WHEN contains(p, 'guidelines') THEN 'guidelines' WHEN contains(p, 'replay') THEN 'replay' ELSE 'unknown' END AS subset FROM (SELECT doc_id, ['a/s2orc/x', 'b/abstracts', 'guidelines.jsonl', 'replay/part', 'other'][1 + doc_id % 5] AS p FROM documents)")
def path_subset(spark, d):
    p = F.element_at(F.array(*map(F.lit, ("a/s2orc/x", "b/abstracts", "guidelines.jsonl", "replay/part", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _docs(spark, d).select("doc_id", io.provenance(p).alias("subset"))


def noisy(c: Column) -> Column:
    return F.concat(c, F.lit(NOISE))
