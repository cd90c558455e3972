"""Queries of corpus building: dedup, keys, statistics, joins, scoring, sampling, mixing, streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, joins, sampling, scoring, stats
from ..sources import io
from ..sources.staging import shared_dir, stage
from ..streaming import streams
from . import sql as S
from .registry import query, table
from .text import _X, noisy


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query(f"""WITH {S.clean_ctes("documents", _X, "doc_id, source, lang")},
k AS (SELECT *, row_number() OVER (PARTITION BY source, {S.fingerprint('t')} ORDER BY doc_id) AS r FROM c6 WHERE lang = 'en'),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM k WHERE r = 1 AND length(t) > 10)
SELECT sha1(source || i) AS id, source, t AS clean_text FROM f""")
def guideline_corpus(spark, d):
    """Clean, given language, first of each fingerprint, length, ids."""
    # the cleaned texts are written once, and only keys are compared
    x = stage(_docs(spark, d).filter("lang = 'en'").select("doc_id", "source", T.clean(noisy(F.col("text"))).alias("clean_text")), "cleaned")
    x = dedup.first_by_prefix(x, "clean_text", "doc_id", ["source"]).filter(F.length("clean_text") > 10)
    return dedup.surrogate_ids(x, "source", "doc_id").select("id", "source", "clean_text")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {S.fingerprint('text')} ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def prefix_dedup(spark, d):
    return dedup.first_by_prefix(_docs(spark, d), "text", "doc_id").select("doc_id", "source")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE user_id IS NULL OR user_id = 0 OR r = 1")
def id_dedup(spark, d):
    return dedup.first_by_id(table(spark, d, "events"), "user_id", "event_id").select("event_id", "user_id")


@query("SELECT doc_id, source, sha1(source || (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)) AS id FROM documents")
def surrogate_ids(spark, d):
    return dedup.surrogate_ids(_docs(spark, d), "source", "doc_id").select("doc_id", "source", "id")


@query("""WITH f AS (SELECT p_brand, arg_min(p_type, p_partkey) AS text FROM part GROUP BY p_brand)
SELECT p.p_brand AS name, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS urls, any_value(f.text) AS text, count(*) - 1 AS duplicates, CAST(count_if(p.p_type = f.text) - 1 AS INTEGER) AS same_text
FROM part p JOIN f ON p.p_brand = f.p_brand GROUP BY p.p_brand""")
def merge_names(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("name"), "p_partkey", F.col("p_type").alias("text"), F.col("p_partkey").cast("string").alias("url"))
    return dedup.merge_names(p, "name", "p_partkey").withColumn("urls", F.array_join("urls", ","))


@query("""SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (
SELECT *, sum(CASE WHEN event_type IS NOT DISTINCT FROM p AND k > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM (
SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)) GROUP BY user_id, event_type, g""")
def label_runs(spark, d):
    return dedup.runs(table(spark, d, "events"), ["user_id"], "event_id", "event_type")


@query("""SELECT source, count(*) AS docs, avg(l) AS mean_lines, avg(w) AS mean_words, CAST(sum(l) AS BIGINT) AS lines, CAST(sum(w) AS BIGINT) AS words
FROM (SELECT source, len(string_split(text, chr(10))) AS l, len(string_split(text, ' ')) AS w FROM documents) GROUP BY ROLLUP (source)""")
def source_stats(spark, d):
    return stats.source_stats(_docs(spark, d))


@query("SELECT l_orderkey AS k, l_partkey, l_quantity, o_totalprice, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
def metadata_join(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_quantity")
    o = table(spark, d, "orders").filter("o_orderdate >= timestamp_ntz'1995-01-01'").select(F.col("o_orderkey").alias("k"), "o_totalprice", "o_orderpriority", "o_orderdate")
    return joins.with_metadata(li, o, "k", "o_orderdate")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled FROM documents")
def semi_split(spark, d):
    a, b = joins.split_by_ids(_docs(spark, d).select("doc_id"), table(spark, d, "labels"), "doc_id")
    return a.withColumn("labelled", F.lit(True)).unionByName(b.withColumn("labelled", F.lit(False)))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_fulltext(spark, d):
    return joins.without(_docs(spark, d).select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) THEN 1 ELSE 0 END AS INTEGER) AS flagged FROM orders")
def mark_reference(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 5000")
    return joins.mark(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, F.col("o_custkey"), "c_custkey", "flagged").select("o_orderkey", "flagged")


@query("""WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN p_name || ' overview' ELSE p_name || ' ' || p_type END AS name FROM part)
SELECT p_partkey, name FROM n a WHERE NOT EXISTS (SELECT 1 FROM n o WHERE ends_with(o.name, 'overview') AND starts_with(a.name, trim(replace(o.name, 'overview', ''))) AND NOT ends_with(a.name, 'overview'))""")
def prefix_theta_anti(spark, d):
    n = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, F.concat("p_name", F.lit(" overview"))).otherwise(F.concat("p_name", F.lit(" "), "p_type")).alias("name"))
    return joins.without_subarticles(n).select("p_partkey", "name")


@query("SELECT s_suppkey, s_name, coalesce(n_name, 'Unknown') AS category FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey")
def category_lookup(spark, d):
    n = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("category"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("k"))
    return joins.lookup(s, n, "k", "category").select("s_suppkey", "s_name", "category")


@query("SELECT o_orderkey, v AS answer FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag, l_linenumber) AS v FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def update_by_key(spark, d):
    # partitions follow the sizes of files, not their names, so a row's place is told by file and row
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("answer"), "l_linenumber", *place)
    return joins.update_by_key(table(spark, d, "orders").select("o_orderkey"), a, "o_orderkey", "answer", "l_linenumber", ["file", "row"])


@query("SELECT doc_id, source, kind FROM (SELECT doc_id, source, 'old' AS kind FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en')")
def replace_sources(spark, d):
    x = _docs(spark, d).select("doc_id", "source", "lang")
    new = x.filter("source in ('src1', 'src2') and lang = 'en'").withColumn("kind", F.lit("new"))
    return joins.replace_source(x.withColumn("kind", F.lit("old")), new).select("doc_id", "source", "kind")


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def not_yet_done(spark, d):
    done = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k"))
    return joins.without(table(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct(), done, "k")


# --- scoring

def _articles(spark: SparkSession, d: str) -> DataFrame:
    """Orders as articles: dates are shifted forward by 22 years so that all date bands occur."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    kinds = F.element_at(F.array(*map(F.lit, ("Review", "Guideline", "Letter", "Clinical Trial, Phase II", "Case Reports", "Preprint", "Other"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    types = F.when(F.col("o_orderkey") % 5 == 0, F.array(kinds, F.lit("Review"))).otherwise(F.array(kinds))
    mesh = F.array(F.when(F.col("o_orderkey") % 11 == 0, "Animals").otherwise("Humans"))
    date = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 264), "yyyy-MM-dd")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", types.alias("publicationtype"), mesh.alias("mesh"), F.col("c_mktsegment").alias("venue"), date.alias("publicationDate"), F.col("o_totalprice").cast("long").alias("citationCount"))


_ART = """a AS (SELECT o_orderkey, c_mktsegment AS venue, CAST(CAST(o_orderdate AS DATE) + INTERVAL 264 MONTH AS DATE) AS d, CAST(trunc(o_totalprice) AS BIGINT) AS cites,
  ['Review', 'Guideline', 'Letter', 'Clinical Trial, Phase II', 'Case Reports', 'Preprint', 'Other'][1 + o_orderkey % 7] AS t1, o_orderkey % 5 = 0 AS two, o_orderkey % 11 = 0 AS animals FROM orders JOIN customer ON o_custkey = c_custkey),
b AS (SELECT *, floor(date_diff('day', d, DATE '2023-07-15') / 365.0) + 1 AS years FROM a),
c AS (SELECT *, CASE WHEN years <> 0 THEN cites / years END AS per_year FROM b),
q AS (SELECT quantile_cont(per_year, 0.75) AS top25, quantile_cont(per_year, 0.5) AS middle50, quantile_cont(per_year, 0.25) AS bottom25 FROM c),
e AS (SELECT *, lower(venue) IN ('automobile', 'building') AS approved,
  CASE t1 WHEN 'Review' THEN 0.5 WHEN 'Guideline' THEN 1 WHEN 'Letter' THEN 0.1 WHEN 'Clinical Trial, Phase II' THEN 0.4 WHEN 'Preprint' THEN -1000000 ELSE 0 END + CASE WHEN two THEN 0.5 ELSE 0 END + CASE WHEN animals THEN -1000000 ELSE 0 END + CASE WHEN lower(venue) IN ('automobile', 'building') THEN 1 ELSE 0 END AS base,
  CASE WHEN d < DATE '2013-07-17' THEN 'old' WHEN CAST(d AS TIMESTAMP) < TIMESTAMP '2018-01-14 12:00:00' THEN 'middle' WHEN d IS NOT NULL THEN 'new' END AS band,
  CASE WHEN per_year <= bottom25 THEN 'bottom' WHEN per_year <= top25 THEN 'middle' WHEN per_year IS NOT NULL THEN 'top' END AS cband FROM c, q),
f AS (SELECT *, CAST(CASE WHEN base > 0 THEN coalesce(base + CASE band WHEN 'old' THEN 0 WHEN 'middle' THEN 0.2 WHEN 'new' THEN 1 END + CASE cband WHEN 'bottom' THEN 0 WHEN 'middle' THEN 0.5 WHEN 'top' THEN 1 END, -1000000) ELSE base END AS DOUBLE) AS factor,
  CASE WHEN t1 IN ('Letter', 'Case Reports', 'Preprint') THEN 'publication_type' WHEN t1 = 'Other' AND NOT two THEN 'publication_notcovered' WHEN animals THEN 'mesh' WHEN band = 'old' THEN 'date' WHEN cband = 'bottom' THEN 'citation' WHEN per_year IS NULL THEN 'nometadata' WHEN NOT approved THEN 'journal' ELSE 'include' END AS reason FROM e)"""


def _approved():
    return scoring.journal_key(F.col("venue")).isin("automobile", "building")


def _with_bands(spark, d) -> DataFrame:
    a = _articles(spark, d)
    return scoring.with_thresholds(a, scoring.thresholds(a))


@query(f"WITH {_ART} SELECT top25, middle50, bottom25 FROM q")
def citation_thresholds(spark, d):
    return scoring.thresholds(_articles(spark, d))


@query(f"WITH {_ART} SELECT o_orderkey, round(factor, 6) AS factor FROM f")
def quality_factor(spark, d):
    return _with_bands(spark, d).select("o_orderkey", F.round(scoring.factor(_approved()), 6).alias("factor"))


@query(f"WITH {_ART} SELECT o_orderkey, reason FROM f")
def include_reason(spark, d):
    return _with_bands(spark, d).select("o_orderkey", scoring.reason(_approved()).alias("reason"))


_STAGES = ("publication_type", "publication_notcovered", "mesh", "date", "citation", "nometadata", "journal")


@query(f"""WITH {_ART}, s AS (SELECT unnest({list(_STAGES)}) AS reason, unnest(range({len(_STAGES)})) AS stage),
n AS (SELECT stage, s.reason, count(f.reason) AS n FROM s LEFT JOIN f ON f.reason = s.reason GROUP BY ALL)
SELECT CAST(stage AS INTEGER) AS stage, reason, n, CAST((SELECT count(*) FROM f) - sum(n) OVER (ORDER BY stage) AS BIGINT) AS remaining FROM n""")
def filter_waterfall(spark, d):
    r = _with_bands(spark, d).select(scoring.reason(_approved()).alias("reason"))
    n = r.groupBy("reason").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    s = spark.createDataFrame(list(enumerate(_STAGES)), "stage int, reason string").join(n, "reason", "left").fillna(0, "n")
    return joins.running_remainder(s.crossJoin(F.broadcast(total)), "stage", "n", F.col("total")).select("stage", "reason", "n", "remaining")


@query("SELECT doc_id, CAST(quality - 1000000 * toxic AS DOUBLE) AS factor FROM labels WHERE quality - 1000000 * toxic >= 0")
def label_factor(spark, d):
    f = F.col("quality") + F.col("toxic") * scoring.DROP
    return table(spark, d, "labels").select("doc_id", f.cast("double").alias("factor")).filter("factor >= 0")


_UP = f"""u AS (SELECT o_orderkey, factor, {S.uniform('o_orderkey')} AS u FROM f WHERE factor >= 0),
x AS (SELECT *, 1 + factor AS a, factor AS b, exp(factor) AS c FROM u),
n AS (SELECT o_orderkey, CAST(floor(a) + CASE WHEN u < a - floor(a) THEN 1 ELSE 0 END AS BIGINT) AS linear, CAST(floor(b) + CASE WHEN u < b - floor(b) THEN 1 ELSE 0 END AS BIGINT) AS proportional, CAST(least(floor(c) + CASE WHEN u < c - floor(c) THEN 1 ELSE 0 END, 5) AS BIGINT) AS exponential FROM x)"""


def _counts(spark, d) -> DataFrame:
    f = _with_bands(spark, d).select("o_orderkey", scoring.factor(_approved()).alias("factor")).filter("factor >= 0")
    return f.select("o_orderkey", *[c(F.col("factor"), "o_orderkey").alias(n) for n, c in scoring.COUNTS.items()])


@query(f"WITH {_ART}, {_UP} SELECT o_orderkey, linear, proportional, exponential FROM n")
def upsample_counts(spark, d):
    return _counts(spark, d)


@query(f"WITH {_ART}, {_UP}, t AS (SELECT o_orderkey, linear, {S.uniform('o_orderkey', 'split')} < 0.03 AS test FROM n) SELECT o_orderkey, 'test' AS split FROM t WHERE test UNION ALL SELECT o_orderkey, 'train' FROM (SELECT o_orderkey, unnest(range(linear)) FROM t WHERE NOT test)")
def upsample_rows(spark, d):
    s = sampling.train_test(_counts(spark, d).select("o_orderkey", "linear"), "o_orderkey", 0.03, "split")
    return sampling.replicate(s, F.when(F.col("split") == "test", 1).otherwise(F.col("linear"))).select("o_orderkey", "split")


_Q = ", ".join(f"quantile_cont(linear, {q / 100}) AS q{q}" for q in (10, 20, 30, 40, 50, 60, 70, 80, 90, 99))


@query(f"WITH {_ART}, {_UP} SELECT avg(linear) AS mean, round(stddev_pop(linear), 9) AS std, min(linear) AS min, max(linear) AS max, {_Q} FROM n")
def upsample_stats(spark, d):
    return stats.distribution(_counts(spark, d), F.col("linear")).withColumn("std", F.round("std", 9))


@query(f"WITH {_ART}, {_UP} SELECT linear, count(*) AS n FROM n GROUP BY linear")
def replication_histogram(spark, d):
    return io.histogram(_counts(spark, d), "linear")


@query(f"WITH {_ART} SELECT t AS publicationtype, count(*) AS n FROM (SELECT t1 AS t FROM a UNION ALL SELECT 'Review' FROM a WHERE two) GROUP BY t")
def publication_type_counts(spark, d):
    return stats.counts(_articles(spark, d), "publicationtype", explode=True)


@query("SELECT c_mktsegment AS venue, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def venue_counts(spark, d):
    return stats.counts(_articles(spark, d), "venue")


@query(f"""WITH {_ART}, t AS (SELECT count(*) AS total, count_if(band = 'old') AS a, count_if(band = 'middle') AS b, count_if(band = 'new') AS c, count_if(cband = 'bottom') AS d, count_if(cband = 'middle') AS e, count_if(cband = 'top') AS f, count_if(approved) AS g FROM f)
SELECT category, n, 100 * n / total AS percent FROM (SELECT total, unnest(['old', 'middle', 'new', 'bottom', 'middle50', 'top', 'approved']) AS category, unnest([a, b, c, d, e, f, g]) AS n FROM t)""")
def category_stats(spark, d):
    date = scoring.parsed_date(F.col("publicationDate"))
    band, cites = scoring.date_band(date), scoring.citation_band(scoring.citations_per_year(F.col("citationCount"), date))
    cond = {"old": band == "old", "middle": band == "middle", "new": band == "new", "bottom": cites == "bottom", "middle50": cites == "middle", "top": cites == "top", "approved": _approved()}
    return stats.categories(_with_bands(spark, d), cond)


# --- sampling


@query(f"SELECT doc_id, CASE WHEN {S.uniform('doc_id')} < 0.03 THEN 'test' ELSE 'train' END AS split FROM documents")
def bernoulli_split(spark, d):
    return sampling.train_test(_docs(spark, d).select("doc_id"), "doc_id", 0.03)


@query(f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {S.uniform('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, CASE WHEN r <= floor(n * 0.9) THEN 'train' WHEN r <= floor(n * 0.9) + floor((n - floor(n * 0.9)) * 0.5) THEN 'validation' ELSE 'test' END AS split FROM r""")
def exact_split(spark, d):
    return sampling.exact_split(_docs(spark, d).select("doc_id"), "doc_id")


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (ORDER BY {S.uniform('doc_id')}, doc_id) AS r, count(*) OVER () AS n FROM documents) WHERE r <= floor(n * 0.37)")
def downsample_exact(spark, d):
    return sampling.exactly(_docs(spark, d).select("doc_id", "source"), "doc_id", 0.37)


@query(f"SELECT doc_id FROM documents WHERE {S.uniform('doc_id', 's')} <= 0.2")
def downsample_stream(spark, d):
    return sampling.bernoulli(_docs(spark, d).select("doc_id"), "doc_id", 0.2, "s", inclusive=True)


@query(f"""WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), k AS (SELECT floor(sum(n) * 0.3) AS keep FROM n),
p AS (SELECT sum(n) AS t FROM n WHERE source IN ('src1', 'src2')), a AS (SELECT source, n, floor(least(1.0, keep / t) * n) AS q FROM n, k, p WHERE source IN ('src1', 'src2')),
l AS (SELECT keep - (SELECT sum(q) FROM a) AS keep FROM k), o AS (SELECT sum(n) AS t FROM n WHERE source NOT IN ('src1', 'src2')),
q AS (SELECT source, q FROM a UNION ALL SELECT source, floor(least(1.0, keep / t) * n) FROM n, l, o WHERE source NOT IN ('src1', 'src2'))
SELECT doc_id, source FROM (SELECT doc_id, d.source, q, row_number() OVER (PARTITION BY d.source ORDER BY {S.uniform('doc_id')}, doc_id) AS r FROM documents d JOIN q ON q.source = d.source) WHERE r <= q""")
def downsample_priority(spark, d):
    return sampling.downsample(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 0.3, ("src1", "src2"))


@query(f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {S.uniform('doc_id')}, doc_id) AS r FROM documents) WHERE r <= 5")
def sample_per_source(spark, d):
    return sampling.per_group(_docs(spark, d).select("doc_id", "source"), "source", "doc_id", 5)


@query(f"SELECT doc_id FROM documents ORDER BY {S.uniform('doc_id', 'mix')}, doc_id")
def interleave(spark, d):
    return sampling.shuffled(_docs(spark, d).select("doc_id"), "doc_id", "mix")


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def distinct_sources(spark, d):
    return stats.sources(_docs(spark, d))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 60 OFFSET 40")
def rows_between(spark, d):
    return io.rows_between(_docs(spark, d).select("doc_id"), "doc_id", 40, 100)


# --- mixing


@query("SELECT 'guidelines' AS subset, text, doc_id, CAST(NULL AS BIGINT) AS item_id, CAST(NULL AS VARCHAR) AS role FROM documents UNION ALL SELECT 'benchmark', text, NULL, item_id, NULL FROM benchmark UNION ALL SELECT 'replay', text, NULL, NULL, role FROM conversations")
def corpus_combine(spark, d):
    parts = {
        "guidelines": _docs(spark, d).select("doc_id", F.col("text").alias("clean_text")),
        "benchmark": table(spark, d, "benchmark").select("item_id", "text"),
        "replay": table(spark, d, "conversations").select("role", "text"),
    }
    return io.combine(parts).select("subset", "text", "doc_id", "item_id", "role")


@query(f"SELECT source, CAST(sum(t) AS BIGINT) AS tokens, count(*) AS docs, avg(t) AS mean_tokens, avg(t) * 1000000 AS expected_tokens FROM (SELECT source, {S.words('text')} AS t FROM documents) GROUP BY source")
def token_estimate(spark, d):
    return stats.token_totals(_docs(spark, d), "text", "source", 1_000_000)


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN lang <> 'en' THEN 'not english' WHEN length(text) <= 100 THEN 'short' ELSE 'kept' END AS status FROM documents) GROUP BY status")
def step_counts(spark, d):
    t = F.col("text")
    return stats.step_counts(_docs(spark, d), {"empty": t.isNull() | (t == ""), "not english": F.col("lang") != "en", "short": F.length(t) <= 100})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'pmc' WHEN o_orderkey % 3 = 1 THEN 'pm' END AS kind, CASE WHEN o_orderkey % 3 <> 2 THEN CAST(o_custkey AS VARCHAR) END AS id FROM orders")
def id_routing(spark, d):
    k = F.col("o_orderkey") % 3
    c = F.col("o_custkey").cast("string")
    ids = F.struct(F.when(k == 1, c).otherwise("").alias("PubMed"), F.when(k == 0, c).alias("PubMedCentral"))
    o = table(spark, d, "orders").select("o_orderkey", ids.alias("externalids"))
    return o.select("o_orderkey", io.id_kind(F.col("externalids.PubMed"), F.col("externalids.PubMedCentral")).alias("kind"), io.external_id(o, "papers").alias("id"))


# --- streaming


def _streamed(spark: SparkSession, d: str, name: str, do) -> DataFrame:
    """The table as a file stream, through ``do``, to a table. The folder is shared: see spark.checkpoint.dir."""
    import uuid

    src = table(spark, d, name)
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # a single file is streamed from its folder by its name, a folder of files as it is
    r = spark.readStream.schema(src.schema).format("parquet")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    one = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    stream = r.option("pathGlobFilter", f"{name}.parquet").load(d) if one else r.load(f"{d}/{name}.parquet")
    out = do(stream)
    streams.write(out, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


@query(f"SELECT DISTINCT md5({S.fingerprint('text')}) AS fingerprint FROM documents")
def stream_dedup(spark, d):
    return _streamed(spark, d, "documents", lambda s: streams.distinct_by_prefix(s, "text").select("fingerprint"))


@query(f"SELECT event_id, event_type FROM events WHERE {S.uniform('event_id', 's')} <= 0.25")
def stream_sample(spark, d):
    return _streamed(spark, d, "events", lambda s: streams.bernoulli(s, "event_id", 0.25, "s").select("event_id", "event_type"))
