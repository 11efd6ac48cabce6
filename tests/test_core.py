import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import alignment as A
from palimpsest.functions import columns as C
from palimpsest.functions import latin
from palimpsest.operators import edges, pareto, ranking, retrieval
from palimpsest.operators.chunking import chunk
from palimpsest.operators.components import connected_components
from palimpsest.operators.ordering import with_running_totals
from palimpsest.plans import checkpoints, config
from palimpsest.plans.experiment import run
from palimpsest.sources import corpora, segmenters, sinks


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_edit_distances():
    rng = random.Random(0)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(7))) for _ in range(80)]
    got = A.edit_distances(words, words, 2)
    assert all(got[i, j] == min(3, edit(x, y)) for i, x in enumerate(words) for j, y in enumerate(words))


def test_measures_by_hand():
    assert A.tesserae(["a", "b"], ["a", "c"], {"a": 1.0}) == 0.0
    assert abs(A.tesserae(["a", "b"], ["a", "b", "c", "d"], {"a": 1, "b": 2}) - 3 / 8**0.5) < 1e-12
    assert abs(A.term_similarity("domin", "domina", 2) - 5 / 6) < 1e-12 and A.term_similarity("ab", "xy", 2) == 0.0
    assert abs(A.soft_cosine(["domin", "x"], ["domin", "x"]) - 1) < 1e-12 and abs(A.soft_cosine(["domin"], ["domina"]) - 5 / 6) < 1e-12
    assert abs(A.hard_cosine(list("aab"), list("abb")) - 0.8) < 1e-12
    assert A.soft_cosine([f"t{k}" for k in range(300)], [f"u{k}" for k in range(300)]) == 0.0  # the hard one beyond 500 terms
    assert A.smith_waterman("a1x b1y c1z".split(), "a1x b1y c1z".split())[2] == 6.0
    assert A.smith_waterman(["i"], ["x"])[2] == 0.0 and A.smith_waterman([], ["x"]) == ([], [], 0.0)
    assert A.smith_waterman("pater filius mater".split(), "pater mater".split()) == (["pater", "filius", "mater"], ["pater", "-", "mater"], 3.0)


def test_alignment_against_a_plain_table():
    rng = random.Random(1)
    words = ["".join(rng.choice("aeirst") for _ in range(rng.randrange(1, 8))) for _ in range(25)]
    for _ in range(60):
        a, b = ([rng.choice(words) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        table = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                d = edit(x, y)
                pay = 2.0 if x == y else 2 * (1 - d / max(len(x), len(y))) if d <= 2 else -1.0
                table[i][j] = max(0.0, table[i - 1][j - 1] + pay, table[i - 1][j] - 1, table[i][j - 1] - 1)
        x, y, score = A.smith_waterman(a, b)
        assert abs(score - max(map(max, table))) < 1e-6 and len(x) == len(y)
        if x:
            total = sum(-1 if "-" in (p, q) else 2.0 if p == q else 2 * (1 - edit(p, q) / max(len(p), len(q))) if edit(p, q) <= 2 else -1 for p, q in zip(x, y, strict=True))
            assert abs(total - score) < 1e-6


def test_normaliser():
    assert latin.split_enclitics(latin.tokenize("Dominusque atque leue")) == ["dominus", "que", "atque", "le", "ue"]
    assert [latin.is_roman(x) for x in ("x", "uiii", "mi", "domus", "")] == [True, True, True, False, False]
    assert latin.clean("Æneas “x”\n— [12] fol. 3r a/b\n123 !!\nca­put") == "Aeneas “x” - a b caput"
    assert latin.keep_number("12", 2.0) is False and latin.keep_number("12", 1.0) and latin.keep_number("123", 9.0)
    assert latin.preprocess("   ")["final_tokens"] == [] and latin.preprocess(None)["mode"] == "unknown"
    found = latin.preprocess("Dominus noster iudicium fecit contra illos qui legibus debent obedire, quia omnis homo iustitiam quaerit.")
    assert found["mode"] == "latin" and "iudicium" in found["final_tokens"] and "quia" not in found["final_tokens"]
    assert latin.stem("possunt", "latin") == "poss" and latin.stem("petrus", "latin") == "petrus" and latin.stem("testamentum", "latin") == "testament"
    assert latin.mode_of(0, 0, 5) == "ocr_noise" and latin.mode_of(5, 1, 0) == "latin" and latin.mode_of(1, 5, 0) == "romance" and latin.mode_of(3, 3, 0) == "mixed"


def test_native_columns_agree_with_the_python_kernels(spark):
    words = "dominus que illi ms cod12 x xii bcdfg aaaab brvvv senyor dels usatge ciutat quibus contra tur q qx loquitur".split()
    frame = spark.createDataFrame([(w,) for w in words], "w string")
    rows = frame.select("w", C.latin_shape(F.col("w")).alias("la"), C.romance_points(F.col("w")).alias("ro"), C.noise_token(F.col("w")).alias("no"), C.apparatus_like(F.col("w")).alias("ap"), C.is_roman(F.col("w")).alias("rm")).collect()
    for r in rows:
        s = latin.shape(r["w"])
        assert (round(r["la"], 6), r["ro"], r["no"], r["ap"], r["rm"]) == (round(s.latin, 6), s.romance, s.noise, s.apparatus, s.roman), r


def test_windows(spark):
    def ids(n, **kw):
        frame = spark.createDataFrame([("c", "s", " ".join(f"w{k}" for k in range(n)))], "corpus string, seg_id string, text string")
        return [r["leaf_id"] for r in chunk(frame, True, **kw).orderBy("leaf_id").collect()]

    assert ids(10, window_words=4, overlap_words=1, min_words=2) == ["s__w0_W0-4", "s__w1_W3-7", "s__w2_W6-10"]
    assert ids(9, window_words=4, overlap_words=0, min_words=3) == ["s__w0_W0-4", "s__w1_W4-8"]
    assert ids(4, window_words=4, overlap_words=1, min_words=1) == ["s"]
    rng = random.Random(0)
    for _ in range(12):
        n, window, overlap, least = rng.randrange(0, 40), rng.randrange(1, 12), rng.randrange(-1, 14), rng.randrange(1, 8)
        want, at, k = [], 0, 0
        if n < least or n <= window:
            want = ["s"]
        else:
            for at in range(0, n, max(1, window - max(0, overlap))):
                end = min(n, at + window)
                if end - at >= least:
                    want.append(f"s__w{k}_W{at}-{end}")
                    k += 1
                    if end == n:
                        break
        assert ids(n, window_words=window, overlap_words=overlap, min_words=least) == sorted(want)
    with pytest.raises(ValueError):
        chunk(spark.range(1).selectExpr("'a' corpus", "'b' seg_id", "'c' text"), True, mode="other")


def test_pareto_layers(spark):
    assert pareto.layers_of(np.array([[1, 1, 1, 1], [1, 1, 1, 1], [0, 0, 0, 0], [2, 0, 0, 0]])).tolist() == [1, 1, 2, 1]
    rng = np.random.default_rng(0)
    for _ in range(20):
        p = rng.integers(0, 5, (rng.integers(1, 900), 3)).astype(float)
        left, want, layer = list(range(len(p))), np.zeros(len(p), int), 1
        while left:
            q = p[left]
            front = [i for i, x in zip(left, q, strict=True) if not ((q >= x).all(1) & (q > x).any(1)).any()]
            want[front] = layer
            left, layer = [i for i in left if want[i] == 0], layer + 1
        assert pareto.layers_of(p).tolist() == want.tolist()
    p = rng.integers(0, 30, (500, 4))
    frame = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "id int, cos_sim double, tesserae double, soft_cos double, sw_norm double").repartition(5)
    want = {i: k for i, k in enumerate(pareto.layers_of(p.astype(float), 3).tolist()) if k}
    assert {r["id"]: r["pareto_layer"] for r in pareto.pareto_layers(frame, 3).collect()} == want


def test_ranks_settle_ties_by_place(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([0.5, 0.9, 0.5])], "cand_pos int, v double")
    assert [r[1] for r in frame.select("cand_pos", ranking.rank_desc("v", ["cand_pos"])).orderBy("cand_pos").collect()] == [2, 1, 3]


def test_budgets(spark):
    def budgets(sizes, **kw):
        rows = [(s, c) for s, c, n in sizes for _ in range(n)]
        leaves = spark.createDataFrame(rows, "side string, corpus string")
        pairs = retrieval.pairs_frame(spark, [("a", "x"), ("b", "y"), ("c", "x")])
        return {(r["left_corpus"], r["right_corpus"]): r["budget"] for r in retrieval.pair_budgets(leaves, pairs, **kw).collect()}

    sizes = [("left", "a", 1), ("right", "x", 1), ("left", "b", 3), ("right", "y", 3)]
    assert budgets(sizes, budget=100, min_pair_budget=None) == {("a", "x"): 25, ("b", "y"): 75}
    assert budgets(sizes, budget=100, min_pair_budget=50) == {("a", "x"): 50, ("b", "y"): 75}
    assert budgets(sizes, budget=10, min_pair_budget=None) == {("a", "x"): 2, ("b", "y"): 8}  # halves go to the even side
    with pytest.raises(ValueError):
        budgets(sizes, budget=0)
    with pytest.raises(ValueError):
        budgets(sizes, budget=1, strategy="other")


def test_pairs_without_a_mapping():
    assert retrieval.allowed_pairs(["a", "b"], ["x"], []) == [("a", "x"), ("b", "x")]
    assert retrieval.allowed_pairs(["a", "b"], ["x", "y"], [(["a"], ["y"])]) == [("a", "y")]
    assert retrieval.allowed_by_left(["a", "b"], ["x", "y"], [(["a"], ["y"])]) == [("a", "y"), ("b", "x"), ("b", "y")]
    assert corpora.resolve(["@GRAMOTY", "@none", "z"]) == ["Acta911", "Acta12", "z"]


def test_right_caps_only_when_asked_for(spark):
    found = spark.createDataFrame([("a", "x", f"l{i}", "r", 1.0 - i / 10) for i in range(3)], "left_corpus string, right_corpus string, left_id string, right_id string, cos_sim double")
    assert retrieval.top_per_left(found, 1).count() == 3 and retrieval.top_per_right(found, 1).count() == 1 and retrieval.top_per_left(found, 0).count() == 0


def test_edges(spark):
    rows = [("p", "q", 1, 1.0), ("p", "q", 4, 0.25), ("p", "z", 2, 0.5)]
    base = spark.createDataFrame(rows, "left_node string, right_node string, rank_final_position int, rank_score double")
    extra = {c: F.col("rank_final_position").cast("string") for c in ("left_leaf_id", "right_leaf_id", "left_parent_id", "right_parent_id", "left_corpus", "right_corpus")}
    base = base.withColumns({**extra, **{c: F.lit(0.0) for c in ("tesserae", "soft_cos", "sw_norm", "cos_sim")}, "right_doc_no": F.lit(None).cast("int"), "pareto_layer": F.lit(1)})
    top, total = (edges.aggregate_edges(base, weight_mode=m).collect() for m in ("max", "sum"))
    assert (top[0]["weight"], top[0]["hit_count"], top[0]["best_rank"], top[0]["best_left_leaf_id"]) == (1.0, 2, 1, "1") and total[0]["weight"] == 1.25
    assert [r["right_node"] for r in edges.aggregate_edges(base, min_hits=2).collect()] == ["q"]
    with pytest.raises(ValueError):
        edges.aggregate_edges(base, weight_mode="other")
    links = spark.createDataFrame([("A", "B", "0.5"), ("B", "A", "0.25"), ("A", "A", "9"), ("A", "C", "no")], "u string, v string, weight string")
    assert sorted(map(tuple, edges.collapse_undirected(links).collect())) == [("A", "B", 0.75), ("A", "C", 1.0)]
    assert edges.corpus_pairs(["a", "b", "c"], ["a", "b", "c"]) == [("a", "b"), ("a", "c"), ("b", "c")] and edges.corpus_pairs(["a"], ["a", "b"]) == [("a", "b")]


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)]
    low = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in low:
        for a, b in links:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
        if all(low[a] == low[b] for a, b in links if a != b):
            break
    frame = spark.createDataFrame([*links, (None, 3)], "u long, v long")
    assert dict(map(tuple, connected_components(spark, frame).collect())) == low
    assert connected_components(spark, frame.where("u < 0")).collect() == []


@pytest.mark.parametrize("batch", ["2", "7", "10000"])
def test_running_totals(spark, batch):
    rng = random.Random(0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0, 1, 5, None])) for i in range(300)]
    found = with_running_totals(spark, spark.createDataFrame(rows, "g string, k int, v int"), "g", ["k"], "v").collect()
    want, place = {}, {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        assert (k, place.get(g, 0), want.get(g, 0)) in {(r["k"], r["position"], r["before"]) for r in found if r["g"] == g}
        want[g], place[g] = want.get(g, 0) + (v or 0), place.get(g, 0) + 1
    assert len(found) == 300
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segmenters_by_hand():
    S = segmenters
    body = "De rebus que ad ius pertinent et de aliis multis causis iudicandis."
    got = S.segment_text(f"front\nDig. 1.1.0.\nTitulus\nDig. 1.1.1pr.\n{body}\n12\nDig. 1.1.2.\nUlpianus libro primo\n{body}\nDig. 1.1.1pr.\nshort one here now ok\nINDEX\nx", "CorpusJuris")
    assert [k for k, _ in got] == ["CorpusJuris_1.1.1pr", "CorpusJuris_1.1.2"] and got[1][1].startswith("Ulpianus")
    got = S.segment_text(f"EVANGELIUM SECUNDUM MARCUM\n[1] 1 {body} 2 {body}\n[2] {body}", "Evangelium")
    assert [k for k, _ in got] == ["Evangelium_Mc.1", "Evangelium_Mc.2"] and " 2 " not in got[0][1]
    got = S.segment_text(f"Caput IV.\nDE LEGIBUS\n[1] {body}\nCaput V.\n{body}", "Etymologiae")
    assert [k for k, _ in got] == ["Etymologiae_4", "Etymologiae_5"] and got[0][1].startswith("DE LEGIBUS De rebus")
    got = S.segment_text(f"[I]\n[1] {body}\n[60 bis] {body}\n[1] again {body}\nExpliciunt consuetudines civitatis Ilerde.\nrest", "CostumsDeLleida")
    assert [k for k, _ in got] == ["CostumsDeLleida_1", "CostumsDeLleida_60bis"]
    got = S.segment_text(f"Liber primus\nI.1. De legibus\nI.1.1. ANTIQUA. {body}\nI.1.2(3). {body}\nI.9.9. {body}", "LexVisigothorum")
    assert [k for k, _ in got] == ["LexVisigothorum_1.1.1", "LexVisigothorum_1.1.2(3)", "LexVisigothorum_1.1.3"]
    got = S.segment_text(
        f"Liber primus\nI.1. De legibus\nI.1.1. ANTIQUA. {body}\n.1.2. {body} x\n(I.1.4) NOVELLA {body}\nLiber secundus\nII.1. Titulus\n11.1.5. FLAVIUS rex REX. De titulo breui. Si quis {body}\n\\|II.2.3. {body}\n12\nog x\nFragmenta Parisina\nII.1.7. {body}", "LexVisigothorum"
    )
    assert [k.split("_")[1] for k, _ in got] == ["1.1.1", "1.1.2", "1.1.4", "2.1.5", "2.1.7", "2.2.3"] and got[3][1].startswith("Si quis De rebus")
    got = S.segment_text(
        f"x\n1 (us. 1)\nVSATICVM {body}\nPHN om. x\n2 (us. 2)\nIudicium {body}\n3\n(us. 3-4)\nCum {body} uel- \naliud\n12 VSATICI\nmore [3] text\n(us. 9)\nABCD {body}\n(us. 10)\nlower {body}\n2 (us. 2)\nagain {body}\n" + "pad\n" * 60 + f"APENDIX A\nA1 (us. 77)\nItem {body}\nB2 (us. 2)\nItem {body}\nObservacions\nrest", "UsatgesBarcelona"
    )
    assert [k for k, _ in got] == ["Us_1", "Us_2", "Us_3-4", "Us_9", "Us_77"] and dict(got)["Us_3-4"].endswith("uelaliud more  text")
    got = S.segment_text(f"Titel: x\nLIBER PRIMVS\nDe aliqua re ca. II.\n{body}\nLIBER SECVNDVS\nDe x ca. IIII\n{body}\nDe x ca. IIII\nshort\nTRACTATVS DE ACTIONVM\nDe y ca. V\n{body}", "ExceptPetri")
    assert [k for k, _ in got] == ["ExceptPetri_1.2", "ExceptPetri_2.4"] and body in got[1][1]
    got = S.segment_text(f"x\n1 (us. 1)\nVSATICVM {body}\nPHN om. x\n2 (us. 2)\nIudicium {body}\n", "UsatgesBarcelona")
    assert [k for k, _ in got] == ["Us_1", "Us_2"]
    got = S.segment_text(f"LIBER PRIMVS\nDe aliqua re ca. II.\n{body}\nDe altera re\ncapitulum tertium\n{body}", "ExceptPetri")
    assert [k for k, _ in got] == ["ExceptPetri_1.2", "ExceptPetri_1.3"]
    got = S.segment_text(f"79 bis\n950, maig\nIn nomine domini {body}\n\n79\nSegle X\nEgo {body}", "Acta911")
    assert [k for k, _ in got] == ["Acta911_79", "Acta911_79 bis"]
    got = S.segment_text(f"###DOC 7###\nNotum sit {body}\n7\n1150\nEgo {body}", "Acta12")
    assert [k for k, _ in got] == ["Acta12_7", "Acta12_7"]
    assert len(S.paragraphs(f"{body} {body} {body}\n\n{body}\n\nTITVLVS SECVNDVS DE REBVS IVDICANDIS\n\n{body} {body} {body}", "s")) == 2
    assert all(S.segment_text(t, name) == [] for name in S.available() for t in ("", "nothing that any edition knows"))
    with pytest.raises(KeyError, match="Available"):
        S.segment_text("x", "nobody")
    with pytest.raises(TypeError):
        S.validate([("a", 1)], "s")
    assert S.validate([("a", " short ")], "s") == [] and S.roman_value("XCIV") == 94


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "data").mkdir()
    (tmp_path / "data/a b.txt").write_bytes("caf\xe9 text".encode("latin-1"))
    with zipfile.ZipFile(tmp_path / "data/d.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one &amp; two</w:t></w:r></w:p><w:p/></w:body></w:document>')
    got = {r["corpus"]: r["content"] for r in corpora.read_files(spark, {"x": f"{tmp_path}/data/a b.txt", "y": f"{tmp_path}/data/d.docx"}).collect()}
    assert got == {"x": "caf� text", "y": "one & two\n"}
    raw = (tmp_path / "data/d.docx").read_bytes()
    assert corpora.docx_text(raw, 0).strip() == "one & two"


def experiment():
    return config.Experiment("e", ["a", "b"], ["b", "c"], [(["a"], ["b", "c"]), (["b"], ["c"])], retrieval=config.Retrieval(budget=50, min_pair_budget=5, global_budget_after_merge=50), keep_layers=2, graph_top_n=10)


def segments(spark):
    rng = random.Random(0)
    words = "dominus iudicium legem hominem terram ciuitatem regem populum causam testem uxorem filium heredem pactum uinum domum agrum seruum".split()
    rows = [(c, i, f"{c}_{i}", " ".join(rng.choice(words) for _ in range(30))) for c in "abc" for i in range(12)]
    return spark.createDataFrame(rows, segmenters.SCHEMA)


def test_experiment_and_its_stages(spark, tmp_path):
    folder = checkpoints.local_folder(tmp_path / "stages")
    one = run(spark, experiment(), segments(spark), folder=folder)
    edges_one = sorted(map(tuple, one.edges.collect()), key=repr)
    detail = one.detail.collect()
    assert [r["rank_final_position"] for r in detail] == list(range(1, len(detail) + 1)) and {r["left_corpus"] + r["right_corpus"] for r in detail} <= {"ab", "ac", "bc"}
    assert all(r["rank_score"] == 1 / r["rank_final_position"] and r["pareto_layer"] <= 2 for r in detail)
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("*.parquet")}
    again = run(spark, experiment(), segments(spark), folder=folder)
    assert sorted(map(tuple, again.edges.collect()), key=repr) == edges_one
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "stages").rglob("*.parquet")} == written
    one = run(spark, experiment(), segments(spark), folder=folder, force_from=7)
    assert sorted(map(tuple, one.edges.collect()), key=repr) == edges_one
    assert {p for p in written if not p.exists()} == {p for p in written if "/edges/" in str(p)}
    nodes, rows = [r.asDict() for r in one.nodes.collect()], sinks.collected(one.edges)
    (tmp_path / "g.gexf").write_text(sinks.gexf(rows, nodes))
    _, graph = corpora.graph_from_gexf(spark, f"{tmp_path}/g.gexf")
    want = {}
    for r in rows:
        if r["left_node"] != r["right_node"]:
            key = tuple(sorted((r["left_node"], r["right_node"])))
            want[key] = want.get(key, 0) + r["weight"]
    assert {(r["u"], r["v"]): round(r["weight"], 9) for r in graph.collect()} == {k: round(v, 9) for k, v in want.items()}
    svg, n = sinks.bipartite_svg(rows, nodes)
    assert n == len(rows) and svg.count('stroke-width="4.0"') == min(3, n)
    sinks.write_csv(one.edges, folder + "/csv")
    table = corpora.read_edges_csv(spark, folder + "/csv")
    assert table.columns == sorted(one.edges.columns) and corpora.graph_from_table(table).count() == len(want)
    from palimpsest.plans import explain

    text = explain.explain(spark, experiment(), folder, {}, 2)
    assert text.count("### Scores") == 2 and "### Shared lemmas" in text
    with pytest.raises(ValueError):
        explain.explain(spark, config.replace(experiment(), keep_layers=1, chunking=config.Chunking(True)), folder, {})


def test_fingerprints_change_from_their_stage_on():
    base = checkpoints.fingerprints(experiment().as_dict(), {"f": "1"})
    other = checkpoints.fingerprints(config.replace(experiment(), retrieval=config.Retrieval(budget=7)).as_dict(), {"f": "1"})
    assert [base[s] == other[s] for s in checkpoints.STEPS] == [True] * 3 + [False] * 4
    assert not set(base.values()) & set(checkpoints.fingerprints(experiment().as_dict(), {"f": "2"}).values())


def test_experiments_are_valid():
    for exp in config.EXPERIMENTS.values():
        exp.resolved().validate()
    assert len(config.EXPERIMENTS["catalan_plus_usatges_upper_triangle"].resolved().mappings) == 10
    assert sum(len(b) for _, b in config.EXPERIMENTS["catalan_plus_usatges_upper_triangle"].mappings) == 55
    with pytest.raises(KeyError, match="Available"):
        config.experiment("none")
    with pytest.raises(ValueError):
        config.replace(experiment(), graph_top_n=0).validate()


def test_lab(spark):
    from palimpsest.plans import lab

    leaves = segments(spark).withColumnRenamed("seg_id", "leaf_id").withColumn("lemmas", C.words(F.col("text")))
    found = lab.run(leaves, "abc", "abc")
    rows = found["strategies"].collect()
    assert {(r["left_corpus"], r["right_corpus"]) for r in rows} == {("a", "b"), ("a", "c"), ("b", "c")} and max(r["rank_final_position"] for r in rows) <= 5
    assert found["correlations"].count() == 36 and "BEST BY soft-tess" in lab.report(found)


def test_layouts():
    e = [{"u": "a", "v": "b", "weight": 2.0}, {"u": "b", "v": "c", "weight": 1.0}]
    d = sinks.path_lengths(sinks._matrix(["a", "b", "c", "d"], e))
    assert d[0, 2] == 1.5 and np.isinf(d[0, 3])
    for kind in ("spring", "kamada_kawai", "mds", "spectral"):
        place = sinks.layout(["a", "b", "c", "d"], e, kind)
        assert len(place) == 4 and max(abs(v) for p in place.values() for v in p) <= 1.2500001
    line = sinks.classical_mds(np.abs(np.subtract.outer([0.0, 1, 3], [0.0, 1, 3])))
    assert abs(abs(line[0, 0] - line[2, 0]) / abs(line[0, 0] - line[1, 0]) - 3) < 1e-6
    with pytest.raises(ValueError):
        sinks.layout(["a", "b"], [], "round")
    assert sinks.rgb("#abc") == (170, 187, 204) and sinks.rgb("zz") == (153, 153, 153) and sinks.thickness(1, 1, 1) == 2.5


def test_stream(spark, tmp_path):
    from palimpsest.streaming.incremental import match_stream, weigh

    docs = spark.createDataFrame([("k", "1", "a b c d".split()), ("k", "2", "x y z".split())], "corpus string, leaf_id string, lemmas array<string>")
    vocabulary = docs.select(F.explode("lemmas").alias("term")).distinct().withColumn("idf", F.lit(1.0))
    known = weigh(docs, vocabulary, 1, 1)
    new = spark.createDataFrame([("n", "9", "a b c q".split())], docs.schema)
    new.write.parquet(f"{tmp_path}/in")
    seen = []
    q = match_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), known, vocabulary, 0.5, lambda frame, n: seen.extend(frame.collect()), 1, 1).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["left_id"], r["right_id"], round(r["cos_sim"], 6)) for r in seen] == [("9", "1", round(3 / (3**0.5 * 2), 6))]


def test_library_stands_without_the_corpus_subpackage(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"import sys, importlib.abc\nsys.path.insert(0, {str(root)!r})\nclass No(importlib.abc.MetaPathFinder):\n  def find_spec(self, name, path, target=None):\n    if name.startswith('palimpsest.llm') or name == 'corpus_pipeline':\n      raise ModuleNotFoundError(name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert len(q) > 60 and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q)\nassert e.oracle_sql().keys() <= q.keys()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_the_gates_bound_is_as_written(spark, tmp_path):
    import duckdb

    from palimpsest.plans.queries import scoring_gate
    from palimpsest.plans.registry import ORACLES

    parts = spark.createDataFrame([(10, 1000.0), (10, 1000.01), (22, 40.0), (None, 1000.0)], "p_size int, p_retailprice double")
    for k, rows in enumerate((parts, parts.where("p_size IS NULL"))):
        at = str(tmp_path / str(k))
        rows.coalesce(1).write.parquet(f"{at}/part.parquet")
        got = tuple(scoring_gate(spark, at).first())
        assert got == duckdb.sql(ORACLES["scoring_gate"].replace("FROM part", f"FROM '{at}/part.parquet/*.parquet'")).fetchall()[0]
        assert got == ((4, 1), (1, 0))[k]
