"""Licence scans with ordered signature rules, in DataFrame functions only."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.license_rules import BASE, WORD, Rule, rules, whole

#: How sure a detection of each priority is.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}

SPAN = "array<struct<begin:int,past:int,priority:int,place:int,label:string>>"


def _literal(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def stems(found: list[Rule]) -> list[str]:
    """Substrings of which every rule's keywords hold one: the first that is so, from those that serve most rules on."""
    uses = Counter(x for r in found for x in r.keywords)
    picked: list[str] = []
    for rule in sorted(found, key=lambda r: -max(uses[x] for x in r.keywords)):
        if not any(y in x for x in rule.keywords for y in picked):
            picked.append(max(rule.keywords, key=lambda x: (uses[x], len(x))))
    return picked


#: Items that a scan holds together: lists grow block by block, so that a long one isn't copied for each of its items.
BLOCK = 512


def scanned(items: str, state: str, then: str, when: str, span: str) -> str:
    """SQL that goes over an array in order: spans of the items ``x`` for which ``when`` holds, with a state ``one.st`` that ``then`` carries on."""
    return f"""
      aggregate(sequence(0, greatest(0, (size({items}) - 1) div {BLOCK})),
        struct({state} AS st, CAST(array() AS array<{SPAN}>) AS out),
        (acc, b) -> aggregate(slice({items}, b * {BLOCK} + 1, {BLOCK}),
          struct(acc.st AS st, CAST(array() AS {SPAN}) AS out),
          (one, x) -> struct({then} AS st, IF({when}, concat(one.out, array({span})), one.out) AS out),
          one -> struct(one.st AS st, concat(acc.out, array(one.out)) AS out)),
        acc -> flatten(acc.out))"""


def _spans() -> str:
    """SQL for all detections in ``_text``: of every rule whose keywords ``_low`` has, where its pattern matches.

    The pieces between the matches give their places: splitting and
    extracting by one pattern find the same matches.
    """
    found = scanned(
        "hits",
        "0",
        "one.st + coalesce(length(x.piece), 0) + coalesce(length(x.hit), 0)",
        "x.hit IS NOT NULL",
        "struct(one.st + length(x.piece) AS begin, one.st + length(x.piece) + length(x.hit) AS past, r.priority AS priority, r.place AS place, r.label AS label)",
    )
    # an array of one binds what is looked at block by block; the pieces are only made where there are hits
    return f"""
      flatten(transform(filter(_rules, r -> forall(r.keywords, k -> contains(_low, k))), r ->
        flatten(transform(filter(array(regexp_extract_all(_text, r.pattern, 0)), y -> size(y) > 0), y ->
          flatten(transform(array(zip_with(split(_text, r.pattern, -1), y, (piece, hit) -> struct(piece, hit))), hits -> {found}))))))"""


#: SQL that keeps, of ``_found``, what no detection of the same or a higher priority contains. In order of begin, then of
#: falling end, priority and place, whatever contains a span comes before it; ``one.st`` is how far the spans so far go, by priority.
KEEP = f"""
  flatten(transform(array(array_sort(transform(_found, x -> struct(x.begin AS begin, -x.past AS back, x.priority AS priority, x.place AS place, x.label AS label)))), ordered -> {
    scanned(
        "ordered",
        "array(-1, -1, -1, -1)",
        "transform(one.st, (m, i) -> IF(i + 1 >= x.priority, greatest(m, -x.back), m))",
        "one.st[x.priority - 1] < -x.back",
        "struct(x.begin AS begin, -x.back AS past, x.priority AS priority, x.place AS place, x.label AS label)",
    )
}))"""


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", found: list[Rule] | None = None) -> DataFrame:
    """Licence notices in every whole text.

    Words are runs of ASCII letters and digits and of all other characters
    beyond ASCII; only A-Z have a lower case. Gives the id, ``n_words``, ``n_base``
    (places of the base phrases), ``first_word`` and ``last_word`` (the first
    and the last such place, in words from 0), ``base_labels``, ``labels`` (also
    of the rules' detections), ``score`` (of the surest detection, else 0) and
    ``spans``: what the rules found, with begin and end in characters, priority,
    place in the list and label.

    A rule runs only on texts that hold its keywords. Of detections one of which contains
    the other, the higher priority or else the larger or earlier rule stands.
    A null text is empty; empty texts have no words, null places and empty
    labels. Every row gives one row, ids may be null or repeat, and other columns
    are ignored. Nothing is shuffled.
    """
    found = rules() if found is None else found
    table = F.array(
        *(F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(i).alias("place"), F.array(*map(F.lit, r.keywords)).alias("keywords"), F.lit(r.pattern).alias("pattern")) for i, r in enumerate(found))
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    gate = " OR ".join(f"contains(_low, {_literal(x)})" for x in stems(found))
    base = whole("|".join(BASE))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.lower(text).alias("_low"))
    # F.lower also maps characters beyond ASCII, so it finds every keyword that lower-casing A-Z would, and rarely one more
    rows = rows.select(id_col, "_text", F.expr(f"IF({gate}, _low, NULL)").alias("_low"), F.regexp_count("_text", F.lit(f"{WORD}+")).cast("long").alias("n_words"))
    gated = F.col("_low").isNotNull()

    def when(x: Column) -> Column:
        return F.when(gated, x)

    each = F.array(*(F.struct(F.lit(label).alias("label"), F.regexp_count("_text", F.lit(whole(words))).alias("n")) for words, label in BASE.items()))
    rows = rows.withColumn("_base", when(each)).withColumn("_rules", when(table))
    rows = rows.withColumn("_found", F.expr(f"IF(_low IS NULL, NULL, {_spans()})"))
    rows = rows.withColumn("spans", F.expr(f"IF(_low IS NULL, CAST(array() AS {SPAN}), {KEEP})"))
    rows = rows.withColumn("n_base", F.expr("coalesce(aggregate(_base, 0L, (sum, x) -> sum + x.n), 0L)"))
    has = F.col("n_base") > 0
    count = lambda x: F.regexp_count(x, F.lit(f"{WORD}+")).cast("long")
    first = F.element_at(F.split("_text", base, 2), 1)
    last = F.regexp_extract("_text", f"(?s)^(.*){base}", 1)
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    own = F.expr("coalesce(transform(filter(_base, x -> x.n > 0), x -> x.label), CAST(array() AS array<string>))")
    sure = F.expr("coalesce(array_max(transform(spans, x -> CASE " + " ".join(f"WHEN x.priority = {k} THEN {v}D" for k, v in CONFIDENCE.items()) + " END)), 0D)")
    return rows.select(
        id_col,
        "n_words",
        "n_base",
        F.when(has, count(first)).alias("first_word"),
        F.when(has, count(last)).alias("last_word"),
        joined(own).alias("base_labels"),
        joined(F.concat(own, F.expr("transform(spans, x -> x.label)"))).alias("labels"),
        sure.alias("score"),
        "spans",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
