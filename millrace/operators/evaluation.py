"""Scoring of generated answers: normalisation, accuracy reports, majority votes, entity matches."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

ACCEPTED = ("a", "b", "c", "d", "e", "yes", "no")
ANSWER_TYPES = {"mcq": "medmcqa medqa medqa4 mmlu mmlu_medical mmlu_general truthfulqa", "boolean": "pubmedqa pubmedqa_validation", "ner": "blurb", "numeric": "gsm8k"}


def answer_type(benchmark: str) -> str:
    return next((k for k, v in ANSWER_TYPES.items() if benchmark in v.split()), "mcq")


def ascii_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7f]", "")


def clean_choice(c: Column) -> Column:
    return F.substring(ascii_only(c), 1, 1)


def clean_boolean(c: Column) -> Column:
    """Of doubled answers the first; one kind of doubling is looked for at a time."""
    out = c
    for pair, one in reversed((("yesyes", "yes"), ("nono", "no"), ("yesno", "yes"), ("noyes", "no"))):
        out = F.when(c.contains(pair), F.replace(c, F.lit(pair), F.lit(one))).otherwise(out)
    return ascii_only(out)


def judge(output: Column, gold: Column, shot: bool = False, cot: bool = False, kind: str = "mcq") -> Column:
    """(status, pred, gold) of lower-case answers: status 1 right, 0 wrong, 2 none found; then pred is the whole output
    and gold the untouched answer."""
    after = T.strip(F.split(F.split(output, "\n##")[1], "\n")[0])
    o = F.when(output.contains("\n##"), F.lower(after)).otherwise(output)
    marked = gold.contains("###")
    found = gold.contains("answer is:")
    g = F.when(marked & found, T.strip(F.split(F.split(gold, "answer is:")[1], "###")[0])).otherwise(gold)
    if shot:
        o = T.strip(F.split(o, "\n\n")[0])
    o = F.regexp_replace(T.strip(F.regexp_replace(o, "[^a-zA-Z0-9]", " ")), " +", " ")
    lost = marked & ~found
    if cot:
        parts = F.split(o, "answer is")
        tokens = T.words(F.element_at(parts, -1))
        lost = lost | (F.size(tokens) == 0)
        o = F.get(tokens, F.lit(0))
    if kind == "boolean":
        o = clean_boolean(o)
    elif kind == "mcq":
        o = clean_choice(o)
    ok = ~lost & F.coalesce(o.isin(*ACCEPTED) if kind != "numeric" else o.rlike("^[0-9]+$"), F.lit(False))
    return F.when(ok, F.struct(F.when(o == g, 1).otherwise(0).alias("status"), o.alias("pred"), g.alias("gold"))).otherwise(F.struct(F.lit(2).alias("status"), output.alias("pred"), gold.alias("gold")))


def judged(df: DataFrame, output: str = "output", gold: str = "gold", **how) -> DataFrame:
    """``df`` with status, pred and answer."""
    j = judge(F.lower(F.col(output)), F.lower(F.col(gold)), **how)
    return df.withColumn("__mr_j", j).select(*df.columns, F.col("__mr_j.status").alias("status"), F.col("__mr_j.pred").alias("pred"), F.col("__mr_j.gold").alias("answer"))


def weighted_scores(df: DataFrame, pred: str, gold: str, by: list[str] | None = None, swapped: bool = True) -> DataFrame:
    """(by, precision, recall, f1), weighted over labels. ``swapped`` takes predictions for the truth, as the reports do."""
    by = by or []
    truth, guess = (pred, gold) if swapped else (gold, pred)
    d = df.select(*by, F.col(truth).alias("t"), F.col(guess).alias("g"))
    label = d.select(*by, F.explode(F.array(F.struct(F.col("t").alias("l"), F.lit(1).alias("t"), F.lit(0).alias("g"), F.when(F.col("t") == F.col("g"), 1).otherwise(0).alias("b")), F.struct(F.col("g").alias("l"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("b")))).alias("x"))
    n = label.groupBy(*by, "x.l").agg(F.sum("x.t").alias("T"), F.sum("x.g").alias("G"), F.sum("x.b").alias("B"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    total = F.sum("T")
    out = n.groupBy(*by).agg(
        (F.sum(F.col("T") * share(F.col("B"), F.col("G"))) / total).alias("precision"), (F.sum(F.col("T") * share(F.col("B"), F.col("T"))) / total).alias("recall"), (F.sum(F.col("T") * share(2 * F.col("B"), F.col("T") + F.col("G"))) / total).alias("f1")
    )
    return out


def accuracy_report(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of judged rows: accuracy, accuracy of what was found, counts, and the weighted scores."""
    by = by or []
    right, counted = F.sum(F.when(F.col("status") == 1, 1).otherwise(0)), F.sum(F.when(F.col("status") != 2, 1).otherwise(0))
    r = df.groupBy(*by).agg(
        (right / F.count("*")).alias("accuracy"), F.when(counted > 0, right / counted).otherwise(0.0).alias("accuracy_calibrate"), right.alias("correct"), counted.alias("counted"), (F.count("*") - counted).alias("unable_to_find_answer"), F.count("*").alias("total"),
        F.avg(F.when(F.col("pred") == F.col("answer"), 1).otherwise(0)).alias("raw_match"),
    )
    s = weighted_scores(df, "pred", "answer", by)
    return r.join(s, by) if by else r.crossJoin(s)


def majority(df: DataFrame, prompt: str, order: str, pred: str = "pred", gold: str = "answer") -> DataFrame:
    """(prompt, pred, answer, votes): the most frequent prediction of a prompt, of equals the first seen."""
    v = df.withColumn("__mr_p", F.lower(prompt)).groupBy("__mr_p", pred).agg(F.count("*").alias("votes"), F.min(order).alias("seen"), F.min_by(gold, order).alias("g"))
    best = F.struct("votes", (-F.col("seen")).alias("seen"))
    return v.groupBy("__mr_p").agg(F.max_by(pred, best).alias("pred"), F.min_by("g", "seen").alias("answer"), F.max("votes").alias("votes")).withColumnRenamed("__mr_p", "prompt")


def vote_report(votes: DataFrame) -> DataFrame:
    valid = F.coalesce(F.col("pred").isin(*ACCEPTED), F.lit(False))
    status = F.when(valid & (F.col("pred") == F.col("answer")), 1).when(valid, 0).otherwise(2)
    return accuracy_report(votes.withColumn("status", status))


def subset_report(df: DataFrame, subset: str, wanted: list[str]) -> DataFrame:
    """A row for each wanted subset, empty ones too."""
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], f"{subset} string")
    return names.join(accuracy_report(df.filter(F.col(subset).isin(*wanted)), [subset]), subset, "left").fillna(0, ["total", "correct", "counted"])


def without_subsets(df: DataFrame, part: str, subset: str = "subset") -> DataFrame:
    """Rows whose subset's name does not hold ``part``; rows without a subset stay."""
    return df.filter(~F.coalesce(F.col(subset).contains(part), F.lit(False)))


# --- entities

_VOWEL = re.compile(r"[aeiou]|(?<=[^aeiou])y")


def stem(word: str) -> str:
    """Porter's steps 1 to 5 for lower-case ASCII words."""
    w = word
    if len(w) <= 2:
        return w
    m = lambda s: len(re.findall(r"v+c+", "".join("v" if _is_vowel(s, i) else "c" for i in range(len(s)))))
    vowel = lambda s: any(_is_vowel(s, i) for i in range(len(s)))
    double = lambda s: len(s) > 1 and s[-1] == s[-2] and not _is_vowel(s, len(s) - 1)
    cvc = lambda s: len(s) > 2 and not _is_vowel(s, len(s) - 1) and _is_vowel(s, len(s) - 2) and not _is_vowel(s, len(s) - 3) and s[-1] not in "wxy"
    for a, b in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(a):
            w = w[: len(w) - len(a)] + b
            break
    if w.endswith("eed"):
        w = w[:-1] if m(w[:-3]) > 0 else w
    else:
        for a in ("ed", "ing"):
            if w.endswith(a) and vowel(w[: -len(a)]):
                w = w[: -len(a)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif double(w) and w[-1] not in "lsz":
                    w = w[:-1]
                elif m(w) == 1 and cvc(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for a, b in table:
            if w.endswith(a):
                w = w[: len(w) - len(a)] + b if m(w[: len(w) - len(a)]) > 0 else w
                break
    for a in _STEP4:
        if w.endswith(a):
            s = w[: len(w) - len(a)]
            if m(s) > 1 and (a != "ion" or s.endswith(("s", "t"))):
                w = s
            break
    if w.endswith("e") and (m(w[:-1]) > 1 or (m(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if double(w) and w.endswith("l") and m(w[:-1]) > 1 else w


def _is_vowel(s: str, i: int) -> bool:
    return s[i] in "aeiou" or (s[i] == "y" and i > 0 and not _is_vowel(s, i - 1))


_pairs = lambda s: [tuple(p.split(":")) for p in s.split()]
_STEP2 = _pairs("ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble")
_STEP3 = _pairs("icate:ic ative: alize:al iciti:ic ical:ic ful: ness:")
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), key=len, reverse=True)


def entity_key(e: str) -> str:
    """Lower case, the last word stemmed; stands in for a lemma."""
    head, _, last = e.lower().strip().rpartition(" ")
    return f"{head} {stem(last)}" if head else stem(last)


def match_entities(predicted: list[str], truth: list[str]) -> tuple[int, int, int]:
    """(matches, predicted, true): each true entity is matched once; a parenthesised form counts by its inside or its outside."""
    left = Counter(map(entity_key, truth))
    hit = 0
    for p in map(entity_key, predicted):
        inner = re.search(r" \((.*?)\)", p)
        forms = [p, inner.group(1).strip(), re.sub(r"\(.*?\)", "", p), re.sub(r" ?\(.*?\)", "", p)] if inner else [p]
        for f in forms:
            if left[f] > 0:
                left[f] -= 1
                hit += 1
                break
    return hit, len(predicted), len(truth)


def entity_scores(df: DataFrame, output: str = "output", gold: str = "gold", sep: str = "#") -> DataFrame:
    """(precision, recall, f1, total) over all rows; entities are separated by ``sep``."""

    @F.pandas_udf("struct<hit:int,p:int,t:int>")
    def match(o: pd.Series, g: pd.Series) -> pd.DataFrame:
        cut = lambda s: [x for x in (s or "").split(sep) if x.strip()]
        return pd.DataFrame([match_entities(cut(a), cut(b)) for a, b in zip(o, g)], columns=["hit", "p", "t"])

    n = df.select(match(output, gold).alias("m")).agg(F.sum("m.hit").alias("h"), F.sum("m.p").alias("p"), F.sum("m.t").alias("t"), F.count("*").alias("total"))
    precision = F.when((F.col("p") == 0) & (F.col("t") == 0), 1.0).when((F.col("p") > 0) & (F.col("t") > 0), F.col("h") / F.col("p")).otherwise(0.0)
    recall = F.when((F.col("p") == 0) & (F.col("t") == 0), 1.0).when(F.col("t") > 0, F.col("h") / F.col("t")).otherwise(0.0)
    n = n.select(precision.alias("precision"), recall.alias("recall"), "total")
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


