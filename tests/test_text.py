"""Text functions against plain Python of the same meaning."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import guidelines, html, lang

SAMPLES = [
    None, "", "  \n ", "plain", "see http://a.b/c?x=1&y=2 and https://x.y-z/ now", "a [label](target) b [1] c <i>x</i> d", "\n# A\n### B\n##### C\ntext", "\n### A\n#### B",
    "\n* one\n• two\n+ three\no four", "a ◆ b ** c *- d\n> quote �", "x\n\n\n123\n\ny\n#z\n  \nq", "é ü  words\tmore", "line one\nline two\n\n- list",
]


def apply(spark, f, values=SAMPLES):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def py_sections(s):
    if "\n#" not in s:
        return s
    least = min(len(h) - 1 for h in re.findall("\n#+", s))
    return re.sub("\n#{3,}", "\n###", s.replace("\n" + "#" * least, "\n#"))


def py_newlines(s):
    s = "".join(x + "\n" for x in s.split("\n") if re.search("[a-zA-Z]", x))
    s = re.sub(r"\n\s*\n", "\n", s)
    return re.sub("\n#", "\n\n#", re.sub("\n{2,}", "\n", s))


@pytest.mark.parametrize(
    ("ours", "plain"),
    [
        (T.strip, str.strip),
        (T.words, str.split),
        (T.remove_references, lambda s: re.sub(r"\[.*?\]", "", re.sub(r"\[.*?\]\(.*?\)", "", re.sub("<.*?>", "", s)))),
        (T.normalize_sections, py_sections),
        (T.normalize_newlines, py_newlines),
        (T.prefix_fingerprint, lambda s: re.sub("[^a-zA-Z0-9]", "", s[:500].lower())),
        (T.capitalize_words, lambda s: " ".join(w.capitalize() for w in s.split(" "))),
        (T.is_digits, lambda s: s.isdigit()),
        (T.is_upper, str.isupper),
        (T.single_letter_words, lambda s: all(len(w) == 1 for w in s.split())),
        (T.token_estimate, lambda s: len(s.split())),
        (lambda c: T.dotted_numbers_to_hash(F.concat(c, F.lit(" 1.2.3"))), lambda s: re.sub(r"\b\d+(?:\.\d+){1,3}\b", "#", s + " 1.2.3")),
    ],
)
def test_same_as_plain(spark, ours, plain):
    for given, got in zip(SAMPLES, apply(spark, ours)):
        if given is not None:
            assert got == plain(given), given


def truncated(text, starters, removers, stoppers):
    """By a walk over the lines."""
    forms = lambda x: (x, x.lower().strip(), x.lower().replace("#", "").strip(), re.sub("[^a-zA-Z ]", "", x.lower()).strip())
    hit = lambda x, ps: any(f.startswith(p.lower()) for f in forms(x) for p in ps)
    out, started = [], False
    for x in text.split("\n"):
        if not started and hit(x, starters):
            out, started = [x], True
        elif not hit(x, removers):
            if hit(x, stoppers):
                break
            if forms(x)[3]:
                out.append(x)
    return "\n".join(out).strip()


def test_truncate_is_the_walk(spark):
    r = random.Random(6)
    lines = ["Start here", "## START", "remove it", "stop now", "# Stop", "plain words", "123", "", "more - text", "* remove"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(300)]
    for starters, removers, stoppers in ((("start",), ("remove",), ("stop",)), ((), ("remove",), ("stop",)), (("start",), (), ()), ((), (), ())):
        got = apply(spark, lambda c: T.truncate(c, starters, removers, stoppers), texts)  # noqa: B023
        assert got == [truncated(t, starters, removers, stoppers) for t in texts]


def test_a_long_text_is_truncated_in_linear_time(spark):
    text = "intro\nstart\n" + "words of a line\n" * 60_000 + "stop\nend"
    assert len(apply(spark, lambda c: T.truncate(c, ["start"], [], ["stop"]), [text])[0].split("\n")) == 60_001


def test_let_computes_once(spark):
    plan = spark.range(1).select(T.let(F.upper(F.col("id").cast("string")), lambda x: F.concat(x, x, x)).alias("y"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(") == 1


def test_processors_leave_out_what_they_must(spark):
    rows = [("Title: x", "Introduction to it\nOne line of text\n" + "long " * 12 + "words"), (None, None), ("t", "")]
    df = spark.createDataFrame(rows, "title string, text string")
    for name in guidelines.PROCESSORS:
        if name not in ("mayo", "nice"):
            out = guidelines.process(df, name)
            assert [c for c in guidelines.RECORD if c in out.columns] == list(guidelines.RECORD)
            assert out.filter("clean_text is null").count() == 0


def test_language(spark):
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el gato y los perros", "", None, "12", "il gatto che non è con gli altri di questo", "кошка и собака", "猫と犬がいる", "zzyx qwrt plmk vbnd"]
    assert lang.names(pa.array(texts, pa.string())) == ["en", "de", "fr", "es", "unknown", "unknown", "unknown", "it", "ru", "ja", "unknown"]


def test_html():
    page = "<html><h1>T</h1><p>One<br>two</p><ul><li>a<li>b</ul><table><tr><td><p>no</p></td></tr></table><script>x()</script><h2>References</h2><p>gone</p>"
    assert html.encyclopaedia(page) == "# T\nOne\ntwo\n- a\n- b"
    assert html.guidance("<h3>1.2 Head</h3><p>1.1 Text [3]</p>") == "# Head\nText "
    assert html.hospital('<p>before</p><h2 id="key-points">Key</h2><ul><li>x\ny</li></ul><p>Last updated 2020</p><p>z</p>') == "# Key\n- x\n\t- y"
    assert html.patient("<h2>A</h2><div class='references'><p>no</p></div><p>yes</p>") == "A\nyes"
    assert html.encyclopaedia("") == "" and html.encyclopaedia("<p>open <b>tags") == "open tags"


def test_search_queries_of_any_keys(spark, tmp_path):
    """Gaps, repeats, nulls and an outlier among the keys leave no batch out."""
    import duckdb
    from millrace.plans import registry
    from oracle import same

    keys = [*range(-90, 300, 2), *[400] * 27, None, None, None, 10**12]
    parts = [(k, "same" if k in (400, None) else f"name {i}", "brand", 5) for i, k in enumerate(keys)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_size int").repartition(5).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    found = registry.queries()["search_queries"](spark, str(tmp_path))
    assert found.count() == len(keys) // 20
    same(found, con, registry.oracle_sql()["search_queries"])
