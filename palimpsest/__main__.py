"""Command line: run an experiment, draw it again, map it, explain it, look at segments and preprocessing, and the pair lab."""

from __future__ import annotations

import argparse
import csv
import importlib
import io
import json
import logging
from pathlib import Path

from palimpsest.plans import config
from palimpsest.sources import corpora, sinks


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _experiment(args) -> config.Experiment:
    own = importlib.import_module(args.config) if args.config else None
    table = getattr(own, "EXPERIMENTS", None)
    corpora.place(getattr(own, "FILES", {}))
    return config.experiment(args.experiment, table).resolved()


def _draw(edges: list[dict], nodes: list[dict], exp: config.Experiment, path: Path) -> int:
    d = exp.drawing
    svg, n = sinks.bipartite_svg(edges, nodes, d.top_n_edges, d.edge_color_by, d.straight_edges, d.label_left, d.label_right)
    sinks.write_text(path, svg)
    return n


def _marks(spark, exp, root):
    from palimpsest.sources import corpora as sources

    paths = {c: f"{root.rstrip('/')}/{sources.CORPORA[c]['path']}" for c in exp.corpora}
    return {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in sources.file_meta(spark, paths).collect()}


def run(args) -> None:
    from palimpsest.plans.checkpoints import local_folder
    from palimpsest.plans.experiment import run_files

    exp, out, spark = _experiment(args), Path(args.out or f"output/{args.experiment}"), _session()
    folder = None if args.no_checkpoints else local_folder(out / "checkpoints")
    found = run_files(spark, exp, args.root, folder, args.force_from_step)
    sinks.write_csv(found.detail, local_folder(out / "detail_pairs.csv"))
    sinks.write_csv(found.edges, local_folder(out / "graph_rows.csv"))
    edges, nodes = sinks.collected(found.edges), [r.asDict() for r in found.nodes.collect()]
    sinks.write_text(out / "graph.gexf", sinks.gexf(edges, nodes))
    n = _draw(edges, nodes, exp, out / "graph.svg") if exp.drawing.enabled else 0
    print(f"edges: {len(edges)}\ndrawn: {n}\nout: {out}")


def render(args) -> None:
    from palimpsest.sources.corpora import CORPORA, order_of

    exp = _experiment(args)
    path = Path(args.graph_csv or f"output/{args.experiment}/graph_rows.csv")
    rows = list(csv.DictReader(io.StringIO("".join(p.read_text("utf-8") for p in (sorted(path.glob("part-*.csv")) if path.is_dir() else [path])))))
    nodes: dict[tuple[str, str], dict] = {}
    for side, names, level in (("left", exp.left, exp.aggregation.left_node_level), ("right", exp.right, exp.aggregation.right_node_level)):
        order = order_of(names)
        for r in rows:
            key, corpus = r[f"{side}_node"], r[f"{side}_corpus"]
            own = CORPORA.get(corpus, {})
            legend = own.get("display", corpus)
            number = r.get("right_doc_no") if side == "right" else None
            nodes.setdefault((side, key), {
                "side": side, "node_id": key, "grp": corpus, "group_order": order.get(corpus, 10**9), "label": legend if level == "corpus" else key,
                "legend_label": legend, "color": own.get("color", "#999999"), "doc_no": int(number) if number else None,
            })
    print("edges:", _draw(rows, list(nodes.values()), exp, Path(args.out or path.parent / "graph.svg")))


def graph_map(args) -> None:
    from palimpsest.operators.edges import weighted_degree
    from palimpsest.sources.corpora import CORPORA, load_graph

    graph = load_graph(_session(), args.input)
    edges = [r.asDict() for r in graph.orderBy("u", "v").collect()]
    nodes = [r["node"] for r in weighted_degree(graph).orderBy("node").collect()]
    place = sinks.layout(nodes, edges, args.layout, args.seed, args.iterations, args.k)
    labels = {n: CORPORA[n]["display"].replace("\n", " ") for n in nodes if n in CORPORA}
    sinks.write_text(args.output, sinks.map_svg(edges, place, {n: CORPORA[n]["color"] for n in labels}, labels, args.title))
    if args.positions_csv:
        text = io.StringIO()
        w = csv.DictWriter(text, ["node", "label", "x", "y", "degree", "weighted_degree"])
        w.writeheader()
        w.writerows(sinks.map_positions(edges, place, labels))
        sinks.write_text(args.positions_csv, text.getvalue())


def explain(args) -> None:
    from palimpsest.plans import explain as X
    from palimpsest.plans.checkpoints import local_folder

    exp, spark = _experiment(args), _session()
    out = Path(args.out or f"output/{args.experiment}")
    text = X.explain(spark, exp, local_folder(out / "checkpoints"), _marks(spark, exp, args.root), args.top_k, args.top_terms)
    sinks.write_text(args.output or out / "explained.md", text)


def layers(args) -> None:
    from palimpsest.operators.pareto import front_curve, pareto_layers
    from palimpsest.plans.checkpoints import Stages, fingerprints, local_folder

    exp, spark = _experiment(args), _session()
    out = Path(args.out or f"output/{args.experiment}")
    metrics = Stages(spark, local_folder(out / "checkpoints"), fingerprints(exp.as_dict(), _marks(spark, exp, args.root))).strict("metrics")
    curve = front_curve(pareto_layers(metrics, args.max_layers, ("tesserae", "sw_norm")), "tesserae", "sw_norm")
    sinks.write_csv(curve, local_folder(f"{args.output_prefix or out / 'pareto_2d'}.csv"))
    sinks.write_text(f"{args.output_prefix or out / 'pareto_2d'}.svg", sinks.curves_svg([r.asDict() for r in curve.collect()], "tesserae", "sw_norm", args.line_width))


def look(args) -> None:
    from palimpsest.functions.latin import preprocess
    from palimpsest.sources import corpora as sources
    from palimpsest.sources.segmenters import available, segment_text

    if args.list_sources:
        print("\n".join(sorted(available())))
        return
    for name in args.only or sorted(available()):
        path = Path(args.root) / sources.CORPORA[name]["path"]
        if not path.exists():
            print(f"{name}: no file {path}")
            continue
        rows = segment_text(sources.docx_text(path.read_bytes()) if path.suffix == ".docx" else path.read_text("utf-8", "replace"), name)
        size = sorted(len(t.split()) for _, t in rows)
        print(f"{name}: {len(rows)} segments, words {size[0] if size else 0} / {size[len(size) // 2] if size else 0} / {size[-1] if size else 0}")
        k = args.per_zone
        middle = max(k, (len(rows) - k) // 2)
        for zone, part in (("first", rows[:k]), ("middle", rows[middle : middle + k] if len(rows) > 2 * k else []), ("last", rows[max(k, len(rows) - k) :])):
            for key, text in part:
                found = preprocess(text, min_length=args.min_length)
                print(json.dumps({"zone": zone, "id": key, "text": text[: args.raw_preview], "mode": found["mode"], "final": found["final_tokens"][:20]}, ensure_ascii=False))


def lab(args) -> None:
    from palimpsest.functions import latin
    from palimpsest.plans import lab as B
    from palimpsest.sources import corpora as sources
    from palimpsest.sources import segmenters

    spark = _session()
    left, right = sources.resolve(args.left), sources.resolve(args.right or args.left)
    paths = {c: f"{args.root.rstrip('/')}/{sources.CORPORA[c]['path']}" for c in {*left, *right}}
    leaves = latin.lemmatize_segments(segmenters.segments(sources.read_files(spark, paths)).withColumnRenamed("seg_id", "leaf_id"))
    sinks.write_text(args.out, B.report(B.run(leaves, left, right)))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    parser.add_argument("--quiet", action="store_true")
    sub = parser.add_subparsers(required=True)

    def add(name: str, f, *options, experiment: bool = False) -> None:
        p = sub.add_parser(name)
        p.set_defaults(f=f)
        if experiment:
            options += (("--config", {}), ("--experiment", {"required": True}), ("--out", {}), ("--root", {"default": "."}))
        for flag, extra in options:
            p.add_argument(flag, **extra)

    add("run", run, ("--no-checkpoints", {"action": "store_true"}), ("--force-from-step", {"type": int, "choices": range(1, 8)}), experiment=True)
    add("render", render, ("--graph-csv", {}), experiment=True)
    add("map", graph_map, ("--input", {"required": True}), ("--output", {"required": True}), ("--layout", {"default": "spring", "choices": ["spring", "kamada_kawai", "mds", "spectral"]}), ("--seed", {"type": int, "default": 42}), ("--iterations", {"type": int, "default": 300}), ("--k", {"type": float}), ("--title", {"default": ""}), ("--positions-csv", {}))
    add("explain", explain, ("--top-k", {"type": int, "default": 3}), ("--top-terms", {"type": int, "default": 15}), ("--output", {}), experiment=True)
    add("layers", layers, ("--max-layers", {"type": int, "default": 6}), ("--line-width", {"type": float, "default": 2.0}), ("--output-prefix", {}), experiment=True)
    add("segments", look, ("--root", {"default": "."}), ("--per-zone", {"type": int, "default": 2}), ("--min-length", {"type": int, "default": 3}), ("--raw-preview", {"type": int, "default": 200}), ("--only", {"nargs": "*"}), ("--list-sources", {"action": "store_true"}))
    add("lab", lab, ("--left", {"nargs": "+", "required": True}), ("--right", {"nargs": "+"}), ("--root", {"default": "."}), ("--out", {"default": "lab.txt"}))
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.WARNING if args.quiet else logging.INFO)
    args.f(args)


if __name__ == "__main__":
    main()
