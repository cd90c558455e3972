from __future__ import annotations

import brute
import pytest
from millrace.llm import licenses
from oracle import SF, connect, same


def found(df):
    return sorted(((r.doc_id, r.license, r.start_word, r.end_word) for r in df.collect()), key=repr)


def test_sql(spark):
    same(licenses.query(spark, SF), connect(), licenses.ORACLE_SQL)


def test_spans(spark):
    mit, apache = licenses.TEMPLATES["mit-text"], licenses.TEMPLATES["apache-2.0"]
    n = len(brute.words(mit))
    split = " ".join([*mit.split()[:9], "really", "truly", *mit.split()[9:]])
    rows = [(1, f"intro {mit} outro"), (1, f"intro {mit} outro"), (2, None), (3, ""), (4, "all rights"), (None, apache), (5, f"{apache} and {apache}"), (6, "word " * 60_000 + mit), (7, split), (8, mit.upper().replace(" ", "\n")), (9, "permission is hereby granted")]
    a = len(brute.words(apache))
    got = found(licenses.license_spans(brute.table(spark, rows)))
    assert got == sorted([(1, "mit-text", 1, 1 + n), (None, "apache-2.0", 0, a), (5, "apache-2.0", 0, a), (5, "apache-2.0", a + 1, 2 * a + 1), (6, "mit-text", 60_000, 60_000 + n), (7, "mit-text", 0, n + 2), (8, "mit-text", 0, n)], key=repr)


def test_neighbouring_diagonals_are_merged(spark):
    words = licenses.TEMPLATES["mit-text"].split()
    r = licenses.license_spans(brute.table(spark, [(1, " ".join([*words[:9], "inserted", *words[9:]]))])).first()
    assert r.diagonals == 2 and r.coverage == 1.0


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_empty(spark, rows):
    assert licenses.license_spans(brute.table(spark, rows)).count() == 0


def test_clashing_columns(spark):
    d = brute.table(spark, [(1, licenses.TEMPLATES["mit"])]).selectExpr("*", "1 as license", "2 as pos", "3 as h", "4 as text_key", "5 as diagonal", "6 as th")
    assert [r[1] for r in found(licenses.license_spans(d))] == ["mit"]


_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."


def _full(name):
    return (licenses._TEXTS / f"{name}.txt").read_text(encoding="utf-8")


REAL = [
    (_GNU.format("", 3), "gpl-3.0"),
    (_GNU.format("", 2), "gpl-2.0"),
    (_GNU.format("Lesser ", 3), "lgpl-3.0"),
    (_GNU.format("Lesser ", 2.1), "lgpl-2.1"),
    (_GNU.format("Affero ", 3), "agpl-3.0"),
    ("Licensed under the GNU General Public License v3.0", "gpl-3.0"),
    ("Licensed under the GNU General Public License, version 3.", "gpl-3.0"),
    ("Licensed under the GNU General Public License v2", "gpl-2.0"),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "apache-2.0"),
    ("This project is licensed under the Apache License 2.0.", "apache-2.0"),
    ("Licensed under the Apache License, Version 1.1.", "apache-1.1"),
    ("This project is licensed under the MIT License.", "mit"),
    ("Distributed under the terms of the MIT license.", "mit"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0"),
    ("SPDX-License-Identifier: Zlib", None),
    ("This work is licensed under the GNU General Public License, version 1.", "gpl-1.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "lgpl-3.0"),
    ("This work is not licensed under the GNU General Public License, as of today.", None),
    ("Licensed under the Apache License, version of the day.", None),
    ("Licensed under the Apache License, Version 2", "apache-2.0"),
    ("Licensed under CC BY 5.0.", None),
    ("The terms of the lease are under the law of the state; the license was issued in version 3 of the form.", None),
    *((f"This work is licensed under a Creative Commons {name} {v} International License.", f"cc-{n}-{v}") for v in ("3.0", "4.0") for n, name in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"), ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"), ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives"))),
    *((_full(file), n) for file, n in (("Apache-2.0", "apache-2.0"), ("GPL-2", "gpl-2.0"), ("GPL-3", "gpl-3.0"), ("LGPL-2.1", "lgpl-2.1"), ("LGPL-3", "lgpl-3.0"), ("MPL-2.0", "mpl-2.0"), ("CC0-1.0", "cc0-1.0"))),
    (f"Copyright 2020 X\n\n{licenses.TEMPLATES.get('mit:text')}", "mit"),
    (licenses.TEMPLATES.get("bsd-2-clause:text"), "bsd-2-clause"),
    (licenses.TEMPLATES.get("bsd-3-clause:text"), "bsd-3-clause"),
]


def test_real_notices_and_texts(spark):
    got = {}
    for d, name, _, _ in found(licenses.license_spans(brute.table(spark, [(i, t) for i, (t, _) in enumerate(REAL)]))):
        got.setdefault(d, set()).add(name.partition(":")[0])
    wrong = [(t[:90], want, got.get(i)) for i, (t, want) in enumerate(REAL) if got.get(i, set()) != ({want} if want else set())]
    assert not wrong


def test_ties_go_to_the_fewer_changes_then_the_length_then_the_name(spark):
    t = {"b": "one two three four five", "a": "one two three four five", "long": "one two three four five six seven", "gap": "one two three five six seven"}
    assert found(licenses.license_spans(brute.table(spark, [(1, "one two three four five")]), t))[0][1] == "a"
    assert [x[1] for x in found(licenses.license_spans(brute.table(spark, [(1, "one two three four five six seven")]), t))] == ["long"]


def test_required_words():
    assert [licenses.template_words(t)[i] for t in ("GNU Lesser General Public License version 2.1", "Apache License 2.0") for i in licenses.required(licenses.template_words(t))] == ["lesser", "2", "1", "apache", "2"]
