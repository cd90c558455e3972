"""Queries of benchmark prompts and answer scoring; predictions and golds are derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import prompts as P
from . import sql as S
from .registry import query, table

_ANSWERS = ("A. because of it", "b", "So, the answer is: C ###", "\n## yes\nmore", "nono", "maybe", "zzz", "é d!")
_GOLDS = ("a", "b", "c", "yes", "no")


def _generations(spark: SparkSession, d: str) -> DataFrame:
    """Events as generated answers: one prompt a user and kind."""
    pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), (k + 1).cast("int"))
    e = table(spark, d, "events")
    return e.select("event_id", F.concat(F.lit("Prompt "), F.col("user_id").cast("string")).alias("prompt"), pick(_ANSWERS, F.col("event_id") % 8).alias("output"), pick(_GOLDS, F.col("user_id") % 5).alias("gold"), F.col("event_type").alias("subset"))


_GEN = f"""g AS (SELECT event_id, 'Prompt ' || user_id AS prompt, lower([{", ".join(S.lit(a).replace(chr(10), "' || chr(10) || '") for a in _ANSWERS)}][1 + event_id % 8]) AS o, [{", ".join(map(S.lit, _GOLDS))}][1 + user_id % 5] AS answer, event_type AS subset FROM events),
h AS (SELECT *, CASE WHEN contains(o, chr(10) || '##') THEN {S.strip("string_split(string_split(o, chr(10) || '##')[2], chr(10))[1]")} ELSE o END AS o1 FROM g),
i AS (SELECT *, {S.sub(S.strip(S.sub('o1', '[^a-zA-Z0-9]', ' ')), ' +', ' ')} AS o2 FROM h),
j AS (SELECT *, substring({S.sub('o2', '[^\\x00-\\x7f]')}, 1, 1) AS p FROM i),
r AS (SELECT event_id, prompt, subset, CASE WHEN p IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') THEN CASE WHEN p = answer THEN 1 ELSE 0 END ELSE 2 END AS status, CASE WHEN p IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') THEN p ELSE o END AS pred, answer FROM j)"""


def _judged(spark, d) -> DataFrame:
    return E.judged(_generations(spark, d))


@query(f"WITH {_GEN} SELECT event_id, CAST(status AS INTEGER) AS status, pred, answer FROM r")
def answer_normalise(spark, d):
    return _judged(spark, d).select("event_id", "status", "pred", "answer")


_BOOL = "CASE WHEN contains(o2, 'yesyes') THEN replace(o2, 'yesyes', 'yes') WHEN contains(o2, 'nono') THEN replace(o2, 'nono', 'no') WHEN contains(o2, 'yesno') THEN replace(o2, 'yesno', 'yes') WHEN contains(o2, 'noyes') THEN replace(o2, 'noyes', 'no') ELSE o2 END"


@query(f"WITH {_GEN.split(',' + chr(10) + 'j AS')[0]}, k AS (SELECT *, {_BOOL} AS p FROM i) SELECT event_id, CAST(CASE WHEN p IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') THEN CASE WHEN p = answer THEN 1 ELSE 0 END ELSE 2 END AS INTEGER) AS status, CASE WHEN p IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') THEN p ELSE o END AS pred FROM k")
def answer_boolean(spark, d):
    return E.judged(_generations(spark, d), kind="boolean").select("event_id", "status", "pred")


_COT = f"""{_GEN.split(',' + chr(10) + 'j AS')[0]}, k AS (SELECT *, list_filter(string_split_regex(string_split(o2, 'answer is')[-1], {S.lit('[' + S.BLANKS + ']+')}), lambda w: w <> '')[1] AS tok FROM i),
m AS (SELECT *, substring(tok, 1, 1) AS p FROM k),
r AS (SELECT event_id, prompt, subset, CASE WHEN p IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') THEN CASE WHEN p = answer THEN 1 ELSE 0 END ELSE 2 END AS status, CASE WHEN p IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no') THEN p ELSE o END AS pred, answer FROM m)"""


@query(f"WITH {_COT} SELECT event_id, CAST(status AS INTEGER) AS status, pred FROM r")
def answer_cot(spark, d):
    return E.judged(_generations(spark, d), cot=True).select("event_id", "status", "pred")


def _report(by: str, source: str = "r", head: str = "") -> str:
    g, p = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    on = f"USING ({by})" if by else "ON true"
    return f"""{head}n AS (SELECT {p}l, CAST(sum(t) AS DOUBLE) AS t, CAST(sum(g) AS DOUBLE) AS g, CAST(sum(b) AS DOUBLE) AS b FROM (SELECT {p}pred AS l, 1 AS t, 0 AS g, CASE WHEN pred = answer THEN 1 ELSE 0 END AS b FROM {source} UNION ALL SELECT {p}answer, 0, 1, 0 FROM {source}) GROUP BY {p}l),
w AS (SELECT {p}sum(t * CASE WHEN g > 0 THEN b / g ELSE 0 END) / sum(t) AS precision, sum(t * CASE WHEN t > 0 THEN b / t ELSE 0 END) / sum(t) AS recall, sum(t * CASE WHEN t + g > 0 THEN 2 * b / (t + g) ELSE 0 END) / sum(t) AS f1 FROM n {g}),
a AS (SELECT {p}count_if(status = 1) / count(*) AS accuracy, CASE WHEN count_if(status <> 2) > 0 THEN count_if(status = 1) / count_if(status <> 2) ELSE 0 END AS accuracy_calibrate, CAST(count_if(status = 1) AS BIGINT) AS correct, CAST(count_if(status <> 2) AS BIGINT) AS counted,
  CAST(count_if(status = 2) AS BIGINT) AS unable_to_find_answer, count(*) AS total, avg(CASE WHEN pred = answer THEN 1 ELSE 0 END) AS raw_match FROM {source} {g})
SELECT {p}accuracy, accuracy_calibrate, correct, counted, unable_to_find_answer, total, raw_match, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM a JOIN w {on}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query(f"WITH {_GEN}, {_report('')}")
def accuracy_report(spark, d):
    return _rounded(E.accuracy_report(_judged(spark, d)))


@query(f"WITH {_GEN}, {_report('subset')}")
def subset_report(spark, d):
    return _rounded(E.accuracy_report(_judged(spark, d), ["subset"]))


@query(f"WITH {_GEN}, {_report('')}".replace("SELECT accuracy, accuracy_calibrate, correct, counted, unable_to_find_answer, total, raw_match, ", "SELECT "))
def weighted_prf(spark, d):
    return _rounded(E.weighted_scores(_judged(spark, d), "pred", "answer"))


_VOTES = f"""{_COT}, c AS (SELECT lower(prompt) AS prompt, pred, count(*) AS votes, min(event_id) AS seen, arg_min(answer, event_id) AS ans FROM r GROUP BY 1, 2),
v AS (SELECT prompt, pred, votes, first_value(ans) OVER (PARTITION BY prompt ORDER BY seen) AS answer, row_number() OVER (PARTITION BY prompt ORDER BY votes DESC, seen) AS k FROM c), best AS (SELECT prompt, pred, answer, votes FROM v WHERE k = 1)"""


def _votes(spark, d) -> DataFrame:
    return E.majority(E.judged(_generations(spark, d), cot=True), "prompt", "event_id")


@query(f"WITH {_VOTES} SELECT * FROM best")
def majority_vote(spark, d):
    return _votes(spark, d)


_VALID = "pred IN ('a', 'b', 'c', 'd', 'e', 'yes', 'no')"


@query(f"WITH {_VOTES}, y AS (SELECT *, CASE WHEN {_VALID} AND pred = answer THEN 1 WHEN {_VALID} THEN 0 ELSE 2 END AS status FROM best), {_report('', 'y')}")
def vote_report(spark, d):
    return _rounded(E.vote_report(_votes(spark, d)))


@query("SELECT event_id, event_type AS subset FROM events WHERE NOT coalesce(contains(event_type, 'li'), false)")
def without_subsets(spark, d):
    return E.without_subsets(_generations(spark, d), "li").select("event_id", "subset")


# of each row's words the first is the one that is an entity of the gold answer, which has it, Brand and a number
@query("""WITH c AS (SELECT CAST(count(*) AS DOUBLE) AS h, sum(len(string_split(p_name, ' '))) AS p, sum(1 + len(string_split(p_brand, '#'))) AS t, count(*) AS total FROM part),
r AS (SELECT h / p AS precision, h / t AS recall, total FROM c) SELECT precision, recall, total, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM r""")
def entity_prf(spark, d):
    """Entities: the words of part names against the first of them and the brand."""
    p = table(spark, d, "part").select(F.array_join(F.split("p_name", " "), "#").alias("output"), F.concat_ws("#", F.split("p_name", " ")[0], "p_brand").alias("gold"))
    return E.entity_scores(p)


# --- prompts

_MCQ = "'Question: ' || p_name || CASE WHEN ends_with(p_name, '?') OR ends_with(p_name, '.') THEN '' ELSE '?' END || chr(10) || chr(10) || 'Options:' || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || p_size || chr(10) || 'D. none'"


def _questions(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.select("p_partkey", F.col("p_name").alias("question"), F.col("p_brand").alias("opa"), F.col("p_type").alias("opb"), F.col("p_size").cast("string").alias("opc"), F.lit("none").alias("opd"), (F.col("p_partkey") % 5).cast("int").alias("cop"))


def _mcq(spark, d) -> DataFrame:
    return P.BENCHMARKS["medmcqa"].prepare(_questions(spark, d)).select("p_partkey", "prompt", "gold")


@query(f"SELECT p_partkey, {_MCQ} AS prompt, CASE WHEN p_partkey % 5 < 4 THEN chr(CAST(65 + p_partkey % 5 AS INTEGER)) END AS gold FROM part")
def mcq_format(spark, d):
    return _mcq(spark, d)


@query(f"SELECT p_partkey, 'Be exact.' || chr(10) || {_MCQ} || chr(10) || 'The answer is:' || chr(10) AS prompt, 'since it is' || '.' || chr(10) || 'The answer is: ' || CASE WHEN p_partkey % 5 < 4 THEN chr(CAST(65 + p_partkey % 5 AS INTEGER)) END || ' ###' AS gold FROM part")
def instruction(spark, d):
    return P.instructed(_mcq(spark, d).withColumn("steps", F.lit("since it is")), "Be exact.", "The answer is:", "steps").drop("steps")


@query(f"""WITH q AS (SELECT p_partkey, {_MCQ} AS prompt, CASE WHEN p_partkey % 5 < 4 THEN chr(CAST(65 + p_partkey % 5 AS INTEGER)) END AS gold FROM part),
s AS (SELECT prompt || chr(10) || 'The answer is: ' || gold AS d, {S.uniform('p_partkey')} AS u, p_partkey FROM q WHERE gold IS NOT NULL ORDER BY u, p_partkey LIMIT 3),
h AS (SELECT string_agg(d, chr(10) || chr(10) ORDER BY u, p_partkey) AS head FROM s)
SELECT p_partkey, head || chr(10) || chr(10) || prompt AS prompt, gold FROM q, h""")
def few_shot(spark, d):
    q = _mcq(spark, d)
    return P.few_shot(q, q.filter("gold is not null"), "p_partkey", 3)


@query("SELECT item_id, '<|im_start|>question' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>answer' || chr(10) AS medqa, text AS raw, substring(text, 1, length(text) - 1) AS shot FROM benchmark")
def prompt_templates(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", P.chat_template(t, "7b-medqa").alias("medqa"), P.chat_template(t, "base").alias("raw"), P.chat_template(t, "base", 2).alias("shot"))


@query("""SELECT conv_id, 'Be kind.' || chr(10) || '### ' || string_agg(CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' ELSE role END || ': ' || text, chr(10) || '### ' ORDER BY turn, role) || chr(10) || '### Assistant:' AS prompt
FROM conversations GROUP BY conv_id""")
def chat_render(spark, d):
    return P.multi_turn(table(spark, d, "conversations"), "conv_id", "Be kind.")


@query("SELECT p_partkey, p_name || '#' || p_brand || ' ' || p_type AS gold FROM part")
def ner_entities(spark, d):
    tokens = F.array("p_name", F.lit("and"), "p_brand", "p_type")
    tags = F.array(*map(F.lit, (1, 0, 1, 2)))
    return table(spark, d, "part").select("p_partkey", P.entities(tokens, tags).alias("gold"))


@query("SELECT p_partkey, 'q ' || p_name AS prompt, CAST(p_size AS VARCHAR) AS gold, 'steps of ' || p_brand AS steps FROM part")
def math_answers(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("q "), "p_name").alias("question"), F.concat(F.lit("steps of "), "p_brand", F.lit("\n#### "), F.col("p_size").cast("string")).alias("answer"))
    return P.BENCHMARKS["gsm8k"].prepare(p).select("p_partkey", "prompt", "gold", "steps")


@query("SELECT item_id, seed, text || ' #' AS prompt, substring(reverse(text || ' #'), 1, 20) AS output FROM benchmark, (SELECT unnest([32, 432, 1234]) AS seed)")
def generation(spark, d):
    """A deterministic stand-in for a model: the prompt reversed, to 20 characters."""
    b = table(spark, d, "benchmark").select("item_id", F.concat("text", F.lit(" #")).alias("prompt"))
    return P.generate(b, lambda xs: [x[::-1][:20] for x in xs], seeds=(1234, 432, 32)).select("item_id", "seed", "prompt", "output")
