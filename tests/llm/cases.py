"""Documents that every operator has to take: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

LONG = "Lorem ipsum dolor sit amet and so on, the words go round. " * 4000

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nAnd then it rests, as foxes do.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog.\nAnd then it rests, as foxes do.", "en", "a"),
    (3, None, "en", "b"),
    (4, "", "fr", None),
    (5, LONG, None, "b"),
    (6, "été où ça — ﬁn 😀 ünïcödé", "fr", "c"),
    (6, "été où ça — ﬁn 😀 ünïcödé", "fr", "c"),
    (None, "no id here but words", "en", "c"),
    (7, "   \n\t ", "de", "d"),
    (8, "Licensed under the Apache License, Version 2.0. GNU general\npublic LICENSE; mit license, cc-by 4.0 cc by", "en", "a"),
    (9, "one two", "en", "e"),
    (10, "One  TWO", "en", "e"),
]

#: Column names that operators use inside.
EXTRA = ["score", "size", "shard", "slot", "_low", "_text", "token", "component", "__text", "spans", "media", "row", "before", "taken", "position", "file", "length", "ids"]


def documents(spark, rows=ROWS, extra=True):
    frame = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        frame = frame.withColumns({c: F.lit("clash") for c in EXTRA})
    return frame


def nothing(spark):
    return documents(spark, [])
