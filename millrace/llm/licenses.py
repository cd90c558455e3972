"""License scan by diagonal voting.

Every rolling 3-gram of words of every document is hashed and joined to the positions of the same 3-grams in the
license templates (a broadcast join: the templates are a fixed table of this module); each match votes for the offset
diagonal document position - template position of its license. Votes are aggregated by diagonal, neighbouring
diagonals that continue each other (a few words put in or left out) are merged to spans, and spans are verified:
each vote's words must be the template's words, not only their hash, enough of the template must be covered, and so must all
words that tell a short template from the like of it: version numbers and names (``required``). Of overlapping spans the
best stays.

The n-gram join runs in one generated-code stage over the scan; only matches are shuffled, by document.

Defined results
* null and empty texts and texts of fewer words than an n-gram match nothing; null doc_ids are carried through;
* a license that stands twice gives two spans; rows equal in doc_id and text are reported once;
* of overlapping spans that of higher coverage stays, then that with fewer words put in or left out (diagonals), then the
  longer, then the license that sorts first;
* a license has several templates, named license:kind (text, header, notice and so on); one without a kind has the bare name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, table, text_key
from .words import WORD, WORD_RE2, Words, char_starts, lists, pieces, signed, strings

K = 3
MAX_SHIFT = 4
MIN_COVERAGE = 0.7
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit": "Released under the MIT License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "all-rights-reserved": "All rights reserved.",
}

_TEXTS = Path(__file__).parent / "license_texts"
for _n, _file in (("apache-2.0", "Apache-2.0"), ("gpl-2.0", "GPL-2"), ("gpl-3.0", "GPL-3"), ("lgpl-2.1", "LGPL-2.1"), ("lgpl-3.0", "LGPL-3"), ("mpl-2.0", "MPL-2.0"), ("cc0-1.0", "CC0-1.0")):
    TEMPLATES[f"{_n}:text"] = (_TEXTS / f"{_file}.txt").read_text(encoding="utf-8")

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_HEAD = TEMPLATES["bsd-3-clause"] + ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "mit:text": f"{TEMPLATES['mit-text']} (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit:notice": "Licensed under the MIT License.",
    "mit:terms": "the terms of the MIT License.",
    "isc:text": f"{TEMPLATES['isc']}, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd-2-clause:text": f"{_BSD_HEAD} {_BSD_TAIL}",
    "bsd-3-clause:text": f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_TAIL}",
    "unlicense:text": f"{TEMPLATES['unlicense']} Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "apache-2.0:header": f"{TEMPLATES['apache-2.0']} (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-2.0:head": "Apache License Version 2.0, January 2004",
    "apache-2.0:notice": "the Apache License 2.0",
    "apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "mpl-2.0:header": f"{TEMPLATES['mpl-2.0']} If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl-2.0:notice": "Mozilla Public License Version 2.0",
    "mpl-2.0:short": "Mozilla Public License 2.0",
}
# notices of the GNU licenses begin at GNU: with words before it, a license's template would be covered in whole by a notice that has Lesser or Affero after it
for _n, _name, _versions in (("gpl", "GNU General Public License", ("1", "2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("lgpl", "GNU Library General Public License", ("2",)), ("agpl", "GNU Affero General Public License", ("3",))):
    for _v in _versions:
        _key = f"{_n}-{_v}" if "." in _v else f"{_n}-{_v}.0"
        TEMPLATES[f"{_key}:header"] = f"{_name} as published by the Free Software Foundation, either version {_v} of the License, or (at your option) any later version."
        TEMPLATES[f"{_key}:only"] = f"{_name} as published by the Free Software Foundation, version {_v} of the License."
        TEMPLATES[f"{_key}:notice"] = f"{_name} version {_v}"
        TEMPLATES[f"{_key}:short"] = f"{_name} v{_v}"
        if "." not in _v:
            TEMPLATES[f"{_key}:notice-0"] = f"{_name} version {_v}.0"
            TEMPLATES[f"{_key}:short-0"] = f"{_name} v{_v}.0"
# nothing stands after the version, so that Attribution isn't covered in whole by Attribution-ShareAlike
for _n, _name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("2.0", "2.5", "3.0", "4.0"):
        TEMPLATES[f"cc-{_n}-{_v}:name"] = f"Creative Commons {_name} {_v}"
        TEMPLATES[f"cc-{_n}-{_v}:spdx"] = f"SPDX-License-Identifier: CC-{_n}-{_v}"
        TEMPLATES.setdefault(f"cc-{_n}-{_v}", f"Licensed under CC {_n} {_v}.")
# of identifiers only those of three words or more: before a single word (MIT, ISC) the three of the tag alone would pass MIN_COVERAGE
for _n in ("apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0"):
    TEMPLATES[f"{_n}:spdx"] = f"SPDX-License-Identifier: {_n}"


#: Of templates of at most so many words all telling words have to be there; longer ones are told apart by their length.
SHORT = 60
TELLING = frozenset("lesser library affero sharealike noncommercial noderivatives sa nc nd mit apache mozilla cc0 bsd isc".split())


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def required(words: list[str]) -> list[int]:
    """Places of the words that tell a template from others: names, and version numbers but for a zero behind one."""
    if len(words) > SHORT:
        return []
    number = [any(c.isdigit() for c in w) and not (w == "0" and i > 0 and words[i - 1][-1:].isdigit()) for i, w in enumerate(words)]
    return [i for i, w in enumerate(words) if number[i] or w in TELLING]


def template_rows(templates: dict[str, str] = TEMPLATES, k: int = K) -> list[tuple[str, int, int, str, str, int]]:
    """(license, words, position, gram, its last word, hash)."""
    named = [(name, template_words(text)) for name, text in sorted(templates.items())]
    # the hashes of all templates at once, in the order of the rows
    _, h = Words(pa.array([" ".join(w) for _, w in named], pa.large_string()), lower=False).ngrams(k)
    grams = [(name, len(w), i, " ".join(w[i : i + k]), w[i + k - 1]) for name, w in named for i in range(len(w) - k + 1)]
    return [(*g, x) for g, x in zip(grams, signed(h).tolist(), strict=True)]


def _grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, low, at, h): the lower-case text, each word's first character, each n-gram's hash. An n-gram
    that would run into the next text has no hash."""
    d = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for off, part in pieces(strings(b.column("text"))):
                w = Words(part)
                low = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(w.offs.astype(np.int64)), pa.py_buffer(w.buf)).cast(pa.string())
                chars = char_starts(w.buf, np.concatenate([w.start, w.offs[:-1]]))
                at = (chars[: len(w.start)] - chars[len(w.start) :][w.row]).astype(np.int32)
                pos, h = w.ngrams(k)
                first = np.searchsorted(pos, w.first)
                # an n-gram's index among its text's is its first word's
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(off, len(part)), b.column("text_key").slice(off, len(part)), low, lists(at, w.first, pa.int32()), lists(signed(h), first, pa.int64())], names=["doc_id", "text_key", "low", "at", "h"]
                )

    return in_arrow(d, run, "doc_id bigint, text_key bigint, low string, at array<int>, h array<bigint>")


def votes(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K) -> DataFrame:
    """(doc_id, text_key, license, template_words, required, pos, tpos): verified n-gram matches."""
    spark = docs.sparkSession
    need = {name: required(template_words(text)) for name, text in templates.items()}
    t = spark.createDataFrame([(*r, need[r[0]]) for r in template_rows(templates, k)], "license string, template_words int, tpos int, gram string, tail string, th bigint, required array<int>")
    g = _grams(docs, k).select("doc_id", "text_key", "low", "at", F.posexplode("h").alias("pos", "h"))
    m = g.join(F.broadcast(t), F.col("h") == F.col("th"))
    start, last = F.col("at")[F.col("pos")], F.col("at")[F.col("pos") + k - 1]
    own = F.col("low").substr(start + 1, last - start + F.length("tail"))
    m = m.filter(F.regexp_replace(own, WORD.replace("[^", "[", 1), " ") == F.col("gram"))
    return m.select("doc_id", "text_key", "license", "template_words", "required", "pos", "tpos")


def license_spans(docs: DataFrame, templates: dict[str, str] = TEMPLATES, k: int = K, max_shift: int = MAX_SHIFT, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, start_word, end_word, votes, diagonals, covered, template_words, coverage)."""
    me = ["doc_id", "text_key", "license", "template_words", "required"]
    v = votes(docs, templates, k).withColumn("diagonal", F.col("pos") - F.col("tpos"))
    d = v.groupBy(*me, "diagonal").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("tpos").alias("tlo"), F.max("tpos").alias("thi"), F.collect_set("tpos").alias("ts"))
    w = Window.partitionBy(*me).orderBy("lo", "diagonal")
    goes_on = (F.abs(F.col("diagonal") - F.lag("diagonal").over(w)) <= max_shift) & (F.col("tlo") > F.lag("thi").over(w))
    d = d.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("span", F.sum("new").over(w))
    places = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("ts")), lambda x: F.sequence(x, x + (k - 1)))))
    s = d.groupBy(*me, "span").agg(F.min("lo").alias("start_word"), (F.max("hi") + k).alias("end_word"), F.sum(F.size("ts")).alias("votes"), F.count("*").alias("diagonals"), places.alias("places"))
    s = s.filter(F.size(F.array_except("required", "places")) == 0).withColumn("covered", F.size("places"))
    s = s.withColumn("coverage", F.col("covered") / F.col("template_words")).filter(F.col("coverage") >= min_coverage)
    # one array a document: the spans of one text are few
    x = F.struct((-F.col("coverage")).alias("c"), F.col("diagonals").alias("g"), (F.col("start_word") - F.col("end_word")).alias("l"), "license", "start_word", "end_word", "votes", "diagonals", "covered", "template_words", "coverage")
    per = s.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(x)).alias("xs"))
    best = F.aggregate("xs", F.filter("xs", lambda y: F.lit(False)), lambda a, y: F.when(F.exists(a, lambda z: (z.start_word < y.end_word) & (y.start_word < z.end_word)), a).otherwise(F.concat(a, F.array(y))))
    out = per.select("doc_id", F.explode(best).alias("x"))
    return out.select("doc_id", "x.license", "x.start_word", "x.end_word", "x.votes", "x.diagonals", "x.covered", "x.template_words", F.round("x.coverage", 4).alias("coverage"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_spans(table(spark, sf_dir, "documents"))


_REQUIRED = ", ".join(f"('{name}', {p})" for name, text in sorted(TEMPLATES.items()) for p in required(template_words(text)))
_VALUES = ", ".join(f"('{name}', {n}, {pos}, '{gram}')" for name, n, pos, gram, _, _ in template_rows())
ORACLE_SQL = f"""
WITH RECURSIVE t(license, template_words, tpos, gram) AS (VALUES {_VALUES}),
rq(license, p) AS (VALUES {_REQUIRED}),
nr AS (SELECT license, count(*) AS need FROM rq GROUP BY license),
d AS (SELECT DISTINCT doc_id, text, regexp_extract_all(lower(text), '{WORD_RE2}') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, text, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM (SELECT doc_id, text, w, unnest(generate_series(1, len(w) - {K - 1})) AS i FROM d)),
v AS (SELECT doc_id, text, license, template_words, pos, tpos, pos - tpos AS diagonal FROM g JOIN t USING (gram)),
a AS (SELECT doc_id, text, license, template_words, diagonal, min(pos) AS lo, max(pos) AS hi, min(tpos) AS tlo, max(tpos) AS thi, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT *, CASE WHEN abs(diagonal - lag(diagonal) OVER q) <= {MAX_SHIFT} AND tlo > lag(thi) OVER q THEN 0 ELSE 1 END AS new FROM a
      WINDOW q AS (PARTITION BY doc_id, text, license ORDER BY lo, diagonal)),
c AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, license ORDER BY lo, diagonal) AS span FROM b),
cov AS (SELECT x.doc_id, x.text, x.license, x.span, count(DISTINCT x.p) AS covered, count(DISTINCT rq.p) AS have FROM (SELECT c.doc_id, c.text, c.license, c.span, unnest(generate_series(v.tpos, v.tpos + {K - 1})) AS p
        FROM c JOIN v ON c.doc_id IS NOT DISTINCT FROM v.doc_id AND c.text = v.text AND c.license = v.license AND c.diagonal = v.diagonal) x LEFT JOIN rq ON rq.license = x.license AND rq.p = x.p GROUP BY ALL),
s AS (SELECT c.doc_id, c.text, c.license, c.template_words, min(lo) AS start_word, max(hi) + {K} AS end_word, sum(n) AS votes, count(*) AS diagonals, any_value(covered) AS covered, any_value(have) AS have
      FROM c JOIN cov ON c.doc_id IS NOT DISTINCT FROM cov.doc_id AND c.text = cov.text AND c.license = cov.license AND c.span = cov.span GROUP BY c.doc_id, c.text, c.license, c.template_words, c.span),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY covered / template_words DESC, diagonals, end_word - start_word DESC, license, start_word) AS k FROM s LEFT JOIN nr USING (license) WHERE covered / template_words >= {MIN_COVERAGE} AND have >= coalesce(need, 0)),
p AS (SELECT doc_id, text, 1 AS k, [k] AS kept, [[start_word, end_word]] AS spans FROM r WHERE k = 1
      UNION ALL
      SELECT p.doc_id, p.text, r.k, CASE WHEN o THEN kept ELSE list_append(kept, r.k) END, CASE WHEN o THEN spans ELSE list_append(spans, [start_word, end_word]) END
      FROM p JOIN (SELECT * FROM r) r ON p.doc_id IS NOT DISTINCT FROM r.doc_id AND p.text = r.text AND r.k = p.k + 1,
      LATERAL (SELECT len(list_filter(p.spans, lambda z: z[1] < r.end_word AND r.start_word < z[2])) > 0 AS o)),
f AS (SELECT doc_id, text, max_by(kept, k) AS kept FROM p GROUP BY doc_id, text)
SELECT r.doc_id, license, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, CAST(votes AS BIGINT) AS votes, diagonals, CAST(covered AS INTEGER) AS covered, template_words, round(covered / template_words, 4) AS coverage
FROM r JOIN f ON r.doc_id IS NOT DISTINCT FROM f.doc_id AND r.text = f.text AND list_contains(f.kept, r.k)
"""
