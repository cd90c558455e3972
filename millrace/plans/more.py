"""Queries of readers and writers, benchmark preparation, small expressions, and the streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import dedup, guidelines, html, joins, lang, scoring, standoff
from ..operators import prompts as P
from ..sources import io
from ..sources.staging import shared_dir, spread
from ..streaming import streams
from . import processors_sql
from . import sql as S
from .registry import query, table
from .text import _RAW, raw_articles

_DOC = "doc_id bigint, text string, lang string"


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang")


# --- readers and writers


@query("SELECT doc_id, text, lang FROM documents")
def jsonl_round_trip(spark, d):
    """Written as JSON lines, nulls too, and read back with a schema."""
    path = _path(spark, "lines")
    io.write_jsonl(_docs(spark, d), path)
    return io.read_jsonl(spark, path, _DOC)


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def jsonl_bad_lines(spark, d):
    """Every third line is cut off; bad lines are dropped."""
    path = _path(spark, "bad")
    line = F.to_json(F.struct("doc_id"))
    _docs(spark, d).select(F.when(F.col("doc_id") % 3 == 0, F.substring(line, 1, 6)).otherwise(line).alias("value")).write.text(path)
    return io.read_jsonl(spark, path, "doc_id bigint", bad="drop").filter("doc_id is not null")


@query("SELECT doc_id, text, lang FROM documents")
def gzip_members(spark, d):
    path = _path(spark, "gzip")
    _docs(spark, d).write.option("compression", "gzip").option("ignoreNullFields", False).json(path)
    return io.read_gzip(spark, path, _DOC)


@query("SELECT r_regionkey, r_name, CAST(n AS INTEGER) AS n FROM region JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1) ON r_regionkey = n_regionkey")
def json_documents(spark, d):
    """One document a region, over several lines each."""
    path = _path(spark, "documents")
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("nations"))
    r = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"))
    r.select(F.to_json(F.struct("r_regionkey", "r_name", "nations"), {"pretty": "true"}).alias("value"), "r_regionkey").write.partitionBy("r_regionkey").text(path)
    return io.read_json(spark, f"{path}/*", "r_regionkey bigint, r_name string, nations array<string>").select("r_regionkey", "r_name", F.size("nations").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' ELSE 'other' END AS bucket FROM documents")
def routed_folders(spark, d):
    path = _path(spark, "routed")
    io.write_routed(_docs(spark, d).drop("text"), path, F.when(F.col("lang") == "en", "english").otherwise("other"))
    return spark.read.schema("doc_id bigint, bucket string").json(path)


@query("SELECT count(*) * 2 AS rows, count(DISTINCT doc_id) AS ids FROM documents")
def save_modes(spark, d):
    """Written, appended, then left alone."""
    path, ids = _path(spark, "modes"), _docs(spark, d).select("doc_id")
    for mode in ("errorifexists", "append", "ignore"):
        io.write_jsonl(ids, path, mode)
    return io.read_jsonl(spark, path, "doc_id bigint").agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("ids"))


@query("SELECT doc_id, lang AS part FROM documents WHERE lang IN ('de', 'en')")
def named_parts(spark, d):
    """Parts of a corpus by name; what the rule refuses is not listed."""
    path = _path(spark, "parts")
    for lang_ in ("de", "en", "fr"):
        io.write_parquet(_docs(spark, d).filter(F.col("lang") == lang_).drop("lang"), f"{path}/{lang_}")
    return io.read_parts(spark, path, ["de", "en", "fr"], keep=lambda n: n != "fr").select("doc_id", "part")


@query("SELECT doc_id, text, 'starcoder' AS source, lang AS \"starcoder-lang\" FROM documents WHERE lang IN ('de', 'es')")
def code_parts(spark, d):
    path = _path(spark, "code")
    for name in ("de", "es", "git-x"):
        io.write_parquet(_docs(spark, d).filter(F.col("lang") == name).select("doc_id", F.col("text").alias("content")), f"{path}/{name}")
    return io.code_corpus(spark, path, ["de", "es", "git-x"], ignore_git=True).select("doc_id", "text", "source", "starcoder-lang")


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS id FROM customer")
def id_list(spark, d):
    path = _path(spark, "ids")
    table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_nationkey").cast("string")).alias("value")).unionByName(spark.range(1).select(F.lit("").alias("value"))).write.text(path)
    return io.read_ids(spark, path)


@query("SELECT item_id, text, s AS subset FROM benchmark, (SELECT unnest(['a', 'b']) AS s)")
def benchmark_subsets(spark, d):
    """The train split of two subset folders."""
    path = _path(spark, "benchmark")
    for s in ("a", "b"):
        lines = [r[0] for r in table(spark, d, "benchmark").select(F.to_json(F.struct("item_id", "text"))).collect()]  # a benchmark's few items
        io.write_text(spark, lines, f"{path}/{s}/x-train.jsonl")
    return io.read_benchmark(spark, path, "item_id bigint, text string", "train", ("a", "b"))


@query("SELECT p_partkey, 'Question: ' || p_name || CASE WHEN ends_with(p_name, '?') OR ends_with(p_name, '.') THEN '' ELSE '?' END AS prompt, CAST(p_size AS VARCHAR) AS gold FROM part")
def finetune_lines(spark, d):
    p = table(spark, d, "part")
    q = F.when(F.col("p_name").endswith("?") | F.col("p_name").endswith("."), F.col("p_name")).otherwise(F.concat("p_name", F.lit("?")))
    path = io.write_finetune(p.select("p_partkey", F.concat(F.lit("Question: "), q).alias("prompt"), F.col("p_size").cast("string").alias("gold")), _path(spark, "finetune"), "medqa", "medqa_cot", "train")
    assert path.endswith("/medqa_medqa_cot_train.jsonl")
    return io.read_jsonl(spark, path, "p_partkey bigint, prompt string, gold string")


@query("SELECT doc_id FROM documents WHERE contains('a_' || lang || '.jsonl', 'en') OR contains('a_' || lang || '.jsonl', 'fr')")
def files_by_name(spark, d):
    """Files whose name holds a wanted part and none of the others."""
    path = _path(spark, "files")
    names = ["a_en.jsonl", "a_fr.jsonl", "a_de.jsonl", "guideline_en.jsonl"]
    for n in names:
        io.write_jsonl(_docs(spark, d).filter(F.col("lang") == n.split("_")[1][:2]).select("doc_id"), f"{path}/{n}")
    return io.read_jsonl(spark, io.named([f"{path}/{n}" for n in names], ("en", "fr")), "doc_id bigint")


@query(f"SELECT event_id FROM events WHERE {S.uniform('event_id', '7')} <= 0.3")
def replay_share(spark, d):
    path = _path(spark, "replay")
    io.replay(table(spark, d, "events").select("event_id"), "event_id", path, 0.3, 7)
    return io.read_jsonl(spark, path, "event_id bigint")


@query("SELECT doc_id, coalesce(lang, 'None') || '# Head' || chr(10) || text || chr(10) || '# Tail' || chr(10) || 'end' AS text FROM documents")
def parsed_article(spark, d):
    sections = F.array(F.struct(F.lit("Head").alias("heading"), F.col("text").alias("text")), F.struct(F.lit("Tail").alias("heading"), F.lit("end").alias("text")))
    return _docs(spark, d).select("doc_id", io.article_text(F.col("lang"), sections).alias("text"))


@query("""SELECT line FROM (SELECT unnest(['# documents', 'en: ' || count_if(lang = 'en') || ' (' || printf('%.2f', count_if(lang = 'en') / count(*) * 100) || '%)', 'all: ' || count(*) || ' (100.00%)', repeat('-', 20)]) AS line FROM documents)""")
def written_report(spark, d):
    n = _docs(spark, d).agg(F.count_if(F.col("lang") == "en").alias("en"), F.count("*").alias("all")).first()
    path = _path(spark, "report")
    io.write_text(spark, io.text_report("documents", n.asDict(), n["all"]), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- language


_LETTERS = "regexp_extract_all(lower(substring(text, 1, 2000)), '\\p{L}+')"
_LISTED = ", ".join(f"('{k}', '{w}')" for k, v in lang.FREQUENT.items() for w in sorted(set(v.split())))
_MARKED = " ".join(f"WHEN '{k}' THEN len(regexp_extract_all(low, '[{m}]'))" for k, m in lang.MARKS.items())
_SCRIPT = " ".join(f"WHEN '{k}' THEN len(regexp_extract_all(low, '\\p{{{m}}}'))" for k, m in lang.SCRIPTS.items())
_KNOWN = ", ".join(f"('{k}')" for k in lang.LANGUAGES)
_DETECTED = f"""f(k, w) AS (VALUES {_LISTED}), names(k) AS (VALUES {_KNOWN}),
s AS (SELECT doc_id, lang, lower(substring(text, 1, 2000)) AS low, {_LETTERS} AS ws FROM documents),
h AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM s) x JOIN f USING (w) GROUP BY ALL),
sc AS (SELECT s.doc_id, names.k, coalesce(h.n, 0) / greatest(len(ws), 1) + (CASE names.k {_MARKED} ELSE 0 END) * 4.0 / greatest(len(regexp_extract_all(low, '\\p{{L}}')), 1)
  + (CASE names.k {_SCRIPT} ELSE 0 END) / greatest(len(regexp_extract_all(low, '\\p{{L}}')), 1) AS score FROM s CROSS JOIN names LEFT JOIN h ON h.doc_id = s.doc_id AND h.k = names.k),
best AS (SELECT doc_id, k, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS r FROM sc),
found AS (SELECT s.doc_id, CASE WHEN len(ws) > 0 AND score >= {lang.LEAST} THEN k ELSE '{lang.UNKNOWN}' END AS found, lang FROM best JOIN s USING (doc_id) WHERE r = 1)"""


@query(f"WITH {_DETECTED} SELECT lang, count(*) AS docs, count_if(lang = found) AS agreed FROM found GROUP BY lang")
def lang_detect(spark, d):
    """Rows and agreement with the given language, by language."""
    x = _docs(spark, d).select("lang", lang.detect(F.substring("text", 1, 2000)).alias("found"))
    return x.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("lang") == F.col("found")).alias("agreed"))


@query(f"""WITH p AS ({processors_sql.processor_sql("who", _RAW)}),
{_DETECTED.replace("substring(text, 1, 2000)", "substring(clean_text, 1, 10000)").replace("FROM documents", "FROM (SELECT doc_id, clean_text, NULL AS lang FROM p)")},
q AS (SELECT p.doc_id, source, clean_text, row_number() OVER (PARTITION BY source, {S.fingerprint('clean_text')} ORDER BY p.doc_id) AS r FROM p JOIN found USING (doc_id) WHERE found = 'en'),
fin AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM q WHERE r = 1 AND length(clean_text) > 10)
SELECT sha1(source || i) AS id, source, clean_text FROM fin""")
def guideline_build(spark, d):
    """The flagship, a source's corpus end to end: process, detect, first of each fingerprint, length, ids."""
    built = guidelines.build(raw_articles(spark, d, "who"), "who", "doc_id")
    return dedup.surrogate_ids(built, "source", "doc_id").select("id", "source", "clean_text")


# --- benchmarks

_P = "SELECT p_partkey, p_name AS q, p_brand AS b, p_type AS t, CAST(p_size AS VARCHAR) AS z FROM part"


def _mcq(q: str, *options: str) -> str:
    listed = " || ".join(f"chr(10) || '{'ABCDE'[i]}. ' || {o}" for i, o in enumerate(options))
    return f"'Question: ' || {q} || CASE WHEN ends_with({q}, '?') OR ends_with({q}, '.') THEN '' ELSE '?' END || chr(10) || chr(10) || 'Options:' || {listed}"


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("q"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").cast("string").alias("z"))


def _prepared(df: DataFrame, name: str) -> DataFrame:
    return P.BENCHMARKS[name].prepare(df).select("p_partkey", "prompt", "gold")


@query(f"SELECT p_partkey, b || chr(10) || t || chr(10) || q AS prompt, z AS gold, q || b AS long_answer FROM ({_P})")
def pubmedqa_prompts(spark, d):
    p = _parts(spark, d).select("p_partkey", F.array("b", "t").alias("CONTEXTS"), F.col("q").alias("QUESTION"), F.col("z").alias("final_decision"), F.concat("q", "b").alias("LONG_ANSWER"))
    return P.BENCHMARKS["pubmedqa"].prepare(p).select("p_partkey", "prompt", "gold", "long_answer")


@query(f"SELECT p_partkey, q AS prompt, z AS gold FROM ({_P})")
def pubmedqa_open_prompts(spark, d):
    return _prepared(_parts(spark, d).select("p_partkey", F.col("q").alias("QUESTION"), F.col("z").alias("final_decision")), "pubmedqa_validation")


@query(f"SELECT p_partkey, {_mcq('q', 'b', 't', 'z')} AS prompt, 'B' AS gold FROM ({_P})")
def medqa_prompts(spark, d):
    option = lambda k, v: F.struct(F.lit(k).alias("key"), F.col(v).alias("value"))
    return _prepared(_parts(spark, d).select("p_partkey", F.col("q").alias("question"), F.array(option("A", "b"), option("B", "t"), option("C", "z")).alias("options"), F.col("t").alias("answer")), "medqa")


@query(f"SELECT p_partkey, {_mcq('q', 'b', 't', 'z')} AS prompt, 'C' AS gold FROM ({_P})")
def medqa4_prompts(spark, d):
    """The options of a map are put in the order of their letters."""
    options = F.create_map(F.lit("C"), "z", F.lit("A"), "b", F.lit("B"), "t")
    return _prepared(_parts(spark, d).select("p_partkey", F.col("q").alias("question"), options.alias("options"), F.col("z").alias("answer")), "medqa4")


@query(f"SELECT p_partkey, q AS prompt, t AS gold FROM ({_P})")
def medicationqa_prompts(spark, d):
    return _prepared(_parts(spark, d).select("p_partkey", F.col("q").alias("Question"), F.col("t").alias("Answer")), "medicationqa")


@query(f"SELECT p_partkey, {_mcq('q', 'b', 't', 'z', 'b')} AS prompt, 'D' AS gold FROM ({_P})")
def mmlu_prompts(spark, d):
    p = _parts(spark, d).select("p_partkey", F.col("q").alias("input"), F.col("b").alias("A"), F.col("t").alias("B"), F.col("z").alias("C"), F.col("b").alias("D"), F.lit("D").alias("target"))
    return _prepared(p, "mmlu_medical")


@query(f"SELECT p_partkey, 'In the sentence below, mark every thing expression; there can be several.' || chr(10) || chr(10) || 'Sentence: ' || b || ' and ' || z AS prompt, b || '#' || z AS gold FROM ({_P})")
def blurb_prompts(spark, d):
    p = _parts(spark, d).select("p_partkey", F.lit("thing").alias("type"), F.array("b", F.lit("and"), "z").alias("tokens"), F.array(*map(F.lit, (1, 0, 1))).alias("ner_tags"))
    return _prepared(p, "blurb")


_DRAWS = ", ".join(f"""struct_pack(h := md5(question || 'order{i}'), c := {'b' if i == 0 else f"[q, t][CAST(floor({S.uniform('question', f'draw{i}')} * 2) AS INTEGER) + 1]"}, g := {i == 0})""" for i in range(4))


@query(f"""SELECT p_partkey, {_mcq('question', 'm[1].c', 'm[2].c', 'm[3].c', 'm[4].c')} AS prompt, chr(65 + CAST(list_position(list_transform(m, lambda x: x.g), true) - 1 AS INTEGER)) AS gold
FROM (SELECT *, list_sort([{_DRAWS}]) AS m FROM (SELECT *, q || p_partkey AS question FROM ({_P})))""")
def truthful_choices(spark, d):
    choices = F.struct(F.array("q", "b", "t").alias("choices"), F.array(*map(F.lit, (0, 1, 0))).alias("labels"))
    return _prepared(_parts(spark, d).select("p_partkey", F.concat("q", F.col("p_partkey").cast("string")).alias("question"), choices.alias("mc1_targets")), "truthfulqa")


_MMLU = "Answer the medical question: choose one of A to D."


@query(f"SELECT p_partkey, '{_MMLU}' || chr(10) || {_mcq('q', 'b', 't', 'z', 'b')} || chr(10) || 'The answer is:' || chr(10) AS prompt, 'D' AS gold FROM ({_P})")
def prepared_benchmark(spark, d):
    """Prompt and gold, then the benchmark's instruction."""
    p = _parts(spark, d).select("p_partkey", F.col("q").alias("input"), F.col("b").alias("A"), F.col("t").alias("B"), F.col("z").alias("C"), F.col("b").alias("D"), F.lit("D").alias("target"))
    return P.prepare(p, "mmlu_medical").select("p_partkey", "prompt", "gold")


@query("""WITH w AS (SELECT unnest(['click', 'view', 'none']) AS subset), j AS (SELECT event_type AS subset, user_id % 3 AS status FROM events)
SELECT w.subset, CAST(count(status) AS BIGINT) AS total, CAST(coalesce(count_if(status = 1), 0) AS BIGINT) AS correct, CAST(coalesce(count_if(status <> 2), 0) AS BIGINT) AS counted FROM w LEFT JOIN j USING (subset) GROUP BY w.subset""")
def wanted_subsets(spark, d):
    """A row for each wanted subset, one without rows too."""
    e = table(spark, d, "events").select(F.col("event_type").alias("subset"), (F.col("user_id") % 3).cast("int").alias("status"), F.col("event_type").alias("pred"), F.col("event_type").alias("answer"))
    return E.subset_report(e.filter("status is not null"), "subset", ["click", "view", "none"]).select("subset", "total", "correct", "counted")


@query("SELECT p_partkey, CASE WHEN p_size >= p_partkey % 60 THEN p_brand ELSE p_type END AS token FROM part")
def top_token(spark, d):
    scores = F.create_map("p_brand", F.col("p_size").cast("double"), "p_type", (F.col("p_partkey") % 60).cast("double"))
    return table(spark, d, "part").select("p_partkey", P.top_token(scores).alias("token"))


_T = "'<|im_start|>'"
_CHAT = {
    "orca": f"{_T} || ' system' || chr(10) || 'You help people find information.' || '<|im_end|>' || chr(10) || {_T} || ' question' || chr(10) || t || '<|im_end|>' || chr(10) || {_T} || ' answer' || chr(10)",
    "medical": f"{_T} || ' system' || chr(10) || 'You answer helpfully and truthfully.' || '<|im_end|>' || chr(10) || ' ' || {_T} || ' user' || chr(10) || t || '<|im_end|>' || chr(10) || ' ' || {_T} || ' assistant' || chr(10)",
    "medmcqa": f"{_T} || 'question' || chr(10) || t || '<|im_end|>' || chr(10) || {_T} || 'answer' || chr(10)",
    "med42": f"chr(10) || '<|system|>: You are a medical assistant.' || chr(10) || '<|prompter|>:' || {S.strip('text')} || chr(10) || '<|assistant|>:'",
    "base": "t",
}


@query(f"SELECT item_id, {', '.join(f'{v} AS {k}' for k, v in _CHAT.items())}, substring(t, 1, length(t) - 1) AS shots FROM (SELECT item_id, text, 'Q. Question: ' || text AS t FROM benchmark)")
def chat_templates(spark, d):
    """The template of each kind of checkpoint."""
    t = F.concat(F.lit("Q. Question: "), "text")
    names = {"orca": "7b-orca", "medical": "7b-medical", "medmcqa": "7b-medmcqa", "med42": "med42-70b", "base": "7b"}
    return table(spark, d, "benchmark").select("item_id", *[P.chat_template(t, c).alias(k) for k, c in names.items()], P.chat_template(t, "7b", 2).alias("shots"))


def _answers(spark, d) -> DataFrame:
    n = (F.col("event_id") % 50).cast("string")
    out = F.when(F.col("event_id") % 3 == 0, F.concat(n, F.lit("\n\nand on"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" "), n, F.lit("."))).otherwise("none")
    return table(spark, d, "events").select("event_id", out.alias("output"), F.when(F.col("event_id") % 2 == 0, n).otherwise("x").alias("gold"))


_NUMERIC = """SELECT event_id, CAST(CASE WHEN event_id % 3 = 2 THEN 2 WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS status, CASE WHEN event_id % 3 = 2 THEN 'none' ELSE CAST(event_id % 50 AS VARCHAR) END AS pred FROM events"""


@query(_NUMERIC)
def answer_numeric(spark, d):
    """Numbers; of several blocks the first counts, as in answers to few-shot prompts."""
    return E.judged(_answers(spark, d), shot=True, kind="numeric").select("event_id", "status", "pred")


@query("SELECT item_id, branch, text AS prompt, reverse(substring(text, 1, 10)) AS output FROM benchmark, (SELECT unnest(range(1, 11))::INTEGER AS branch)")
def generation_branches(spark, d):
    """Ten branches a prompt, from a deterministic stand-in for a model."""
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"))
    return P.generate(b, lambda xs: [x[:10][::-1] for x in xs], branches=10).select("item_id", "branch", "prompt", "output")


# --- expressions


@query(f"SELECT doc_id, '# first' || chr(10) || chr(10) || text || '# second' || chr(10) || chr(10) || lang AS text FROM documents")
def glued_sections(spark, d):
    sections = F.array(F.struct(F.lit("first").alias("name"), F.col("text").alias("body")), F.struct(F.lit("second").alias("name"), F.col("lang").alias("body")))
    return _docs(spark, d).select("doc_id", T.concatenate_sections(sections).alias("text"))


_SQUEEZED = "t"
for _p, _by in (("\\n+", "\n"), ("\\n# ", "\n\n# "), ("\\n## ", "\n\n## "), (" +", " ")):
    _SQUEEZED = S.sub(_SQUEEZED, _p, _by)
for _tag in ("fig_ref", "bib_ref"):
    _SQUEEZED = S.rep(_SQUEEZED, f"[/{_tag}] .", f"[/{_tag}].")
_LOOSE = f"text || {S.lit(chr(10) * 3 + '# head' + chr(10) + '## deep   er [/fig_ref] . and [/bib_ref] .')}"


@query(f"SELECT doc_id, {_SQUEEZED} AS text FROM (SELECT doc_id, {_LOOSE} AS t FROM documents)")
def squeezed_article(spark, d):
    c = F.concat("text", F.lit("\n" * 3 + "# head\n## deep   er [/fig_ref] . and [/bib_ref] ."))
    return _docs(spark, d).select("doc_id", T.squeeze_article(c).alias("text"))


@query(f"SELECT p_partkey, {S.strip('p_name')} AS question, p_type AS cut, regexp_full_match(c, '[0-9]+') AS digits, c = upper(c) AND c <> lower(c) AS capital, true AS single FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE 'ABC' END AS c FROM part)")
def small_predicates(spark, d):
    k = F.col("p_partkey") % 3
    c = F.when(k == 0, F.col("p_brand")).when(k == 1, F.col("p_size").cast("string")).otherwise("ABC")
    prompt = F.concat(F.lit("Do this. Question: "), "p_name", F.lit(" \n\nOptions: none"))
    return table(spark, d, "part").select("p_partkey", T.question_of(prompt).alias("question"), T.until_stop(F.concat("p_type", F.lit("### and more ###"))).alias("cut"), T.is_digits(c).alias("digits"), T.is_upper(c).alias("capital"), T.single_letter_words(F.lit(" a b  c ")).alias("single"))


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS pmid, p_type || ',' || p_name AS mesh, p_brand AS types FROM part")
def xml_fields(spark, d):
    x = F.concat(F.lit("<PubmedArticle><PMID>"), F.col("p_partkey").cast("string"), F.lit("</PMID><MeshHeading><DescriptorName>"), "p_type", F.lit("</DescriptorName><Q>no</Q></MeshHeading><MeshHeading><D>"), "p_name", F.lit("</D></MeshHeading><PublicationType>"), "p_brand", F.lit("</PublicationType></PubmedArticle>"))
    p = spread(table(spark, d, "part")).select("p_partkey", x.alias("x"))  # parsing is large against reading
    return p.select("p_partkey", F.xpath_string("x", F.lit("//PMID")).alias("pmid"), F.array_join(F.xpath("x", F.lit("//MeshHeading/*[1]/text()")), ",").alias("mesh"), F.array_join(F.xpath("x", F.lit("//PublicationType/text()")), ",").alias("types"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_type, p_type AS mesh, p_brand AS types FROM part")
def xml_mesh(spark, d):
    """Article-set XML made from parts, parsed, and joined back."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("pmid"), "p_type", "p_brand")
    one = F.concat(F.lit("<PubmedArticle><MedlineCitation><PMID>"), "pmid", F.lit("</PMID><MeshHeading><DescriptorName>"), "p_type", F.lit("</DescriptorName><QualifierName>q</QualifierName></MeshHeading><PublicationType>"), "p_brand", F.lit("</PublicationType></MedlineCitation></PubmedArticle>"))
    sets = p.groupBy(F.floor(F.col("pmid").cast("long") / 100).alias("b")).agg(F.concat(F.lit("<PubmedArticleSet>"), F.array_join(F.collect_list(one), ""), F.lit("</PubmedArticleSet>")).alias("xml"))
    return joins.enrich_from_xml(p, sets, "pmid").select("pmid", "p_type", F.array_join("mesh", ",").alias("mesh"), F.array_join("publicationtype", ",").alias("types"))


@query("SELECT o_orderkey, CASE WHEN k <= 1 THEN 1 WHEN k <= 3 THEN 3 END AS start FROM (SELECT o_orderkey, o_orderkey % 6 AS k FROM orders)")
def contained_interval(spark, d):
    """Of the annotations at [1, 2], [3, 4] and [5, 9] the first from k on that ends by 6."""
    spans = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 2), (3, 4), (5, 9))])
    return table(spark, d, "orders").select("o_orderkey", joins.within(spans, (F.col("o_orderkey") % 6).cast("int"), F.lit(6))["start"].alias("start"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Symptoms of it' ELSE 'Diagnosis' END AS patient, 'Context of it,Rules' AS guidance FROM pages")
def site_section_names(spark, d):
    """Sections that a site's rule takes, by name; their bodies go through the site's converter."""
    p = table(spark, d, "pages")
    part = lambda n: F.struct(n.alias("name"), F.col("html").alias("html"))
    mine = F.when(F.col("page_id") % 2 == 0, "Symptoms of it").otherwise("Diagnosis")
    patient = html.site_sections(F.array(part(F.lit("Doctors")), part(mine)), "patient")
    guidance = html.site_sections(F.array(part(F.lit("1 Context of it")), part(F.lit(" 12 Rules"))), "guidance")
    named = lambda c: F.array_join(F.transform(c, lambda s: s["name"]), ",")
    return p.select("page_id", named(patient).alias("patient"), named(guidance).alias("guidance"))


@query("SELECT o_orderkey, venue IN ('automobile', 'art and building') AS approved FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'automobile' WHEN 1 THEN 'art and building' WHEN 2 THEN 'art & building' ELSE 'x' END AS venue FROM orders)")
def approved_journals(spark, d):
    """Venues against a table of journals; & counts as and in the list alone."""
    listed = spark.createDataFrame([("Automobile.",), ("Art & Building",), ("Automobile",)], "name string")
    k = F.col("o_orderkey") % 4
    o = table(spark, d, "orders").select("o_orderkey", F.when(k == 0, "Auto-mobile").when(k == 1, "Art and Building,").when(k == 2, "Art & Building").otherwise("x").alias("venue"))
    return scoring.with_approved(o, scoring.approved_journals(listed)).select("o_orderkey", "approved")


@query("SELECT o_orderkey, coalesce(nullif(t, '') || chr(10) || chr(10), '') || o_orderstatus AS text FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS t FROM orders)")
def titled_text(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("text"))
    return standoff.with_title(o, "\n\n").select("o_orderkey", "text")


# --- streaming


@query("SELECT event_id FROM events WHERE event_type <> 'click' OR event_type IS NULL")
def stream_without_done(spark, d):
    """Micro-batches leave out the keys of a table of finished work."""
    done = table(spark, d, "events").filter("event_type = 'click'").select("event_id")
    base = _path(spark, "undone")
    left = streams.without_done(lambda: done, "event_id")
    src = table(spark, d, "events").select("event_id")
    src.write.parquet(f"{base}/in")
    stream = streams.read(spark, f"{base}/in", src.schema, "parquet")
    streams.each_batch(stream, f"{base}/checkpoint", lambda b, n: left(b).write.mode("append").parquet(f"{base}/out")).awaitTermination()
    return spark.read.schema(src.schema).parquet(f"{base}/out")


@query("SELECT event_id FROM events")
def stream_resumed(spark, d):
    """Two runs from one checkpoint: what the first has done the second leaves alone."""
    base, src = _path(spark, "resumed"), table(spark, d, "events").select("event_id")
    for part in (src.filter("event_id % 2 = 0"), src.filter("event_id % 2 = 1")):
        part.write.mode("append").parquet(f"{base}/in")
        streams.write(streams.read(spark, f"{base}/in", src.schema, "parquet"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(src.schema).parquet(f"{base}/out")


@query("SELECT event_id, event_type AS bucket FROM events WHERE event_type IN ('click', 'view')")
def stream_routed(spark, d):
    """A folder a bucket from each micro-batch."""
    base, src = _path(spark, "routed"), table(spark, d, "events").select("event_id", "event_type")
    src.write.parquet(f"{base}/in")
    streams.route(streams.read(spark, f"{base}/in", src.schema, "parquet"), F.col("event_type"), ["click", "view"], f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema("event_id bigint, bucket string").parquet(f"{base}/out")


@query(f"SELECT event_id FROM events WHERE {S.uniform('event_id', '5')} <= 0.4")
def stream_replay(spark, d):
    base, src = _path(spark, "replayed"), table(spark, d, "events").select("event_id")
    src.write.parquet(f"{base}/in")
    io.replay(streams.read(spark, f"{base}/in", src.schema, "parquet"), "event_id", f"{base}/out", 0.4, 5)
    return io.read_jsonl(spark, f"{base}/out", "event_id bigint")
