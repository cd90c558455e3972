"""Line predicates that look at a line's start, held against the forms they stand for."""

from __future__ import annotations

import random
import re

from millrace.functions import text as T
from millrace.operators.guidelines import PHRASES
from millrace.plans import text as plans
from oracle import SF
from pyspark.sql import functions as F


def forms(x: str) -> list[str]:
    low = x.lower()
    return [x, low.strip(T.BLANKS), low.replace("#", "").strip(T.BLANKS), re.sub("[^a-zA-Z ]", "", low).strip(T.BLANKS)]


def test_line_starts_are_those_of_the_four_forms(spark):
    draw = random.Random(7)
    odd = list(" #\t 　aAiIkKKİé.*[1-̇|’") + ["\U0001f600"]
    some = lambda n: "".join(draw.choice(odd) for _ in range(n))
    lists = [p[k] for p in PHRASES.values() for k in p] + [["iki", "ai ", "#i"], ["k i", " a", "i"], [""]]
    rows = [(some(draw.randint(0, 9)),) for _ in range(500)]
    for p in (x for one in lists for x in one):
        for _ in range(8):
            body = "".join((c.upper() if draw.random() < 0.1 else c) + (some(1) if draw.random() < 0.05 else "") for c in p)
            rows.append((some(draw.choice((0, 1, 3))) + body + some(draw.choice((0, 1, 8))),))
    df = spark.createDataFrame(rows, "x string")
    got = df.select("x", *[F.col("x").rlike(T.line_start(one)).alias(f"s{i}") for i, one in enumerate(lists)], *[T.at_least_words(F.col("x"), n).alias(f"w{n}") for n in (1, 3)], T.single_letter_words(F.col("x")).alias("single")).collect()
    for r in got:
        f = forms(r.x)
        for i, one in enumerate(lists):
            assert r[f"s{i}"] == any(y.startswith(p.lower()) for y in f for p in one), (r.x, one)
        words = [w for w in re.split(f"[{T.BLANKS}]+", r.x) if w]
        assert (r.w1, r.w3, r.single) == (len(words) >= 1, len(words) >= 3, all(len(w) == 1 for w in words)), r.x


def test_truncation_makes_no_form_of_a_whole_line(spark):
    """Of each line only the start is looked at: no copy in lower case, no copy without its other characters."""
    for name in ("who", "cdc_diseases", "cco", "cps", "spor", "wikidoc", "cma_pdfs"):
        plan = plans._guideline(spark, SF, name)._jdf.queryExecution().optimizedPlan().toString()
        assert "[^a-zA-Z ], ," not in plan, name
