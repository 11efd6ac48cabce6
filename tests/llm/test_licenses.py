import re

from cases import ROWS, documents, nothing
from pyspark.sql import functions as F

from palimpsest.llm import licenses as S
from palimpsest.llm import license_rules as R

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(text):
    """All columns, by plain loops."""
    w = WORDS.findall(lower(text))
    places = [(i, label) for p, label in R.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found = []
    for place, rule in enumerate(R.rules()):
        if all(k in lower(text) for k in rule.keywords):
            found += [(m.start(), m.end(), rule.priority, place, rule.label) for m in re.finditer(rule.pattern, text or "", re.A)]
    kept = [
        x for x in found
        if not any(y != x and y[0] <= x[0] and y[1] >= x[1] and (y[2] < x[2] or (y[2] == x[2] and (y[0] < x[0] or y[1] > x[1] or y[3] < x[3]))) for y in found)
    ]
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(x[4] for x in kept)})
    score = max((S.CONFIDENCE[x[2]] for x in kept), default=0.0)
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score


TEXTS = [
    "SPDX-License-Identifier: GPL-3.0-or-later", "This is released under the GNU General Public License v2.0, see the license file", "mit license mit license MIT-licence",
    "cc by cc-by-sa 4.0 CC BY NC ND 3.0", "Apache License\nVersion 2.0, Apache license; the apache software license 1.1", "copyright (c) 2020 all rights reserved", "gnu general public licenses",
    "xmit license", "mit license9", "émit license", "mit　license", "GNU\tGeneral---Public...License " * 30, "BSD 3-Clause License; new BSD license; bsd", "KKapache license",
]


def test_against_brute_force(spark, sf):
    rows = [*ROWS, *((100 + i, t, None, None) for i, t in enumerate(TEXTS))]
    sample = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows += [(1000 + r["doc_id"], r["text"], None, None) for r in sample]
    found = sorted((r["doc_id"] or -1, tuple(r)[1:]) for r in S.scan_licenses(documents(spark, rows)).drop("spans").collect())
    assert found == sorted((i or -1, brute(t)) for i, t, _, _ in rows)


def test_hundreds_of_rules_whose_keywords_their_patterns_need():
    rules = R.rules()
    assert len(rules) >= 200 and {r.priority for r in rules} == {1, 2, 3, 4}
    bare = lambda p: re.sub(r"\[sc\]", "", p)
    for r in rules:
        for k in r.keywords:
            assert all(k in bare(r.pattern).lower() or k[:5] in bare(r.pattern).lower() for k in [k]), r
    assert all(any(x in k for k in r.keywords for x in S.stems(rules)) for r in rules)


def test_empty_table_and_native_plan(spark):
    assert S.scan_licenses(nothing(spark)).collect() == []
    plan = S.scan_licenses(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange", plan)


def test_many_hits_in_one_text(spark):
    """Whole blocks of hits, nested ones among them, and a text of nothing but hits within seconds."""
    import time

    text = "GNU General Public License v2.0, mit license " * 700 + "gpl " * 700
    found = S.scan_licenses(documents(spark, [(1, text, None, None)], extra=False)).drop("spans").collect()
    assert [tuple(r)[1:] for r in found] == [brute(text)]
    began = time.perf_counter()
    [row] = S.scan_licenses(documents(spark, [(1, "gpl " * 250_000, None, None)], extra=False)).select("n_words", F.size("spans").alias("n")).collect()
    assert tuple(row) == (250_000, 250_000) and time.perf_counter() - began < 60
