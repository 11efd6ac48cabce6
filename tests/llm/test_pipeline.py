import random

import pytest
from cases import documents, nothing

import corpus_pipeline as P


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        made = P.stored(spark, stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_columns_and_clean_documents(outputs, spark, sf):
    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    for name, before, after in outputs[:-1]:
        assert after.columns == columns, name
    for name, before, after in outputs[:3]:
        assert after.join(before, columns, "left_anti").count() == 0, name
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    _, before, after = outputs[1]
    clean = before.join(labels.where("quality = 1"), "doc_id").select("doc_id")
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.03 * clean.count()


def test_one_document_of_each_group_stays(outputs):
    from palimpsest.llm.jaccard import jaccard_components

    _, before, after = outputs[2]
    groups = jaccard_components(before.sparkSession, before, size=P.SHINGLE, percent=P.SIMILAR).collect()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({r["component_id"] for r in groups})


def test_near_copies_link_from_four_fifths_of_five_word_shingles(spark, sf):
    from test_jaccard import brute

    def changed(words, places):
        return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))

    rng = random.Random(2)
    rows = []
    for n, places in ((100, (30, 70)), (150, (20, 75, 130)), (100, (20, 50, 80)), (48, (20,)), (49, (20,)), (60, (30,))):
        words = [f"n{n}p{len(places)}w{k}" for k in range(n)]
        rows += [" ".join(words), changed(words, places)]
    base = [f"w{k}" for k in range(120)]
    rows += [changed(base, rng.sample(range(120), rng.randrange(5))) for _ in range(30)]
    rows = list(enumerate(rows))
    kept = P.one_of_each_group(spark, documents(spark, [(i, t, "en", "a") for i, t in rows], extra=False), sf)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in brute(rows, 5, 80)})
    assert {c for _, _, c in brute(rows, 5, 80)} != {c for _, _, c in brute(rows, 3, 90)}


def test_packed_tokens_are_those_of_the_mix(outputs):
    _, mix, pack = outputs[4]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.packing.tokenizer_path("json"))
    want = sum(len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in mix.collect())
    assert pack.agg({"length": "sum"}).first()[0] == want


def test_run_gives_the_last_stage(spark, sf, outputs):
    assert P.run(spark, sf).agg({"length": "sum"}).first()[0] == outputs[4][2].agg({"length": "sum"}).first()[0]


#: Columns that a table may have beside those of documents, among them names that stages use inside.
CLASH = ["lang_pred", "sure", "score", "letter", "__lang", "__sure", "__letter", "__quality", "quality", "a.b", "component", "node", "row", "token", "spans", "passes", "_at", "source_size", "_id", "f1", "n", "text_"]


def odd(spark, rows):
    from pyspark.sql import functions as F

    frame = documents(spark, rows, extra=False)
    return frame.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.mark.parametrize("which", ["odd", "empty", "long"])
def test_stages_take_odd_rows_and_clashing_columns(spark, sf, which):
    """Each stage on its own rows: all but the last keep the columns, and what they keep they keep unchanged."""
    from cases import ROWS

    rows = {"odd": ROWS, "empty": [], "long": [*ROWS, (20, "\n" * 300_000, "en", "a"), (21, "word " * 100_000, "en", "a"), (20, "other text " * 9, None, None)]}[which]
    docs = odd(spark, rows)
    for name, stage in P.STAGES:
        made = stage(spark, docs, sf)
        kept = made.collect()
        if name == "pack":
            assert sum(r["length"] for r in kept) == sum(r["doc_tokens"] for r in kept if r["start"] == 0)
            continue
        assert made.columns == docs.columns, name
        assert {r["a.b"] for r in kept} <= {"clash"}
        if name != "mix":
            assert all((r["doc_id"], r["text"], r["lang"], r["source"]) in rows for r in kept), name
        if name == "near_duplicates":
            want = [r for r in rows if not (r[1] or "").strip()] + list({tuple((r[1] or "").lower().split()): r for r in reversed(rows) if (r[1] or "").strip()}.values())
            assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(((r[0], r[1]) for r in want), key=repr)
