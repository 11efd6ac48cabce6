"""The registered corpora, their groups, and files of them as tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corpus, kind, display name, colour.
TABLE = """
CorpusJuris | latin_source | Свод\\nЮстиниана | #d62728
Evangelium | latin_source | Евангелие\\n(Вульгата) | #1f77b4
LexVisigothorum | latin_source | Вестготская\\nправда | #9467bd
ExceptPetri | latin_source | Составленные Петром \\nизвлечения из римских законов | #ff7f0e
Etymologiae | latin_source | Этимологии\\nИсидора | #2ca02c
CostumsDeTortosa | catalan_source | Обычаи\\nТортосы | #8c564b
CostumsDeLleida | catalan_source | Обычаи\\nЛьейды | #e377c2
ConstitucionesBaiulieMirabeti | catalan_source | Обычаи\\nМиравета | #7f7f7f
CostumsDeOrta | catalan_source | Обычаи\\nОрты | #bcbd22
RecognovrentProceres | catalan_source | Recognovrent\\nProceres | #17becf
CostumresDeTarrega | catalan_source | Обычаи\\nТарреги | #aec7e8
CostumsDeValdAran | catalan_source | Обычаи\\nВаль-д’Арана | #98df8a
PragmaticaJaimeII1295 | catalan_source | Прагматика\\nЖауме II (1295) | #ff9896
PragmaticaJaimeII1301 | catalan_source | Прагматика\\nЖауме II (1301) | #c5b0d5
Acta911 | charters | Грамоты\\nIX–XI вв. | #2c7fb8
Acta12 | charters | Грамоты\\nXII в. | #f03b20
UsatgesBarcelona | usatges | Барселонские\\nОбычаи  | #17becf
CostumsDePerpinya | catalan_source | Обычаи\\nПерпиньяна | #6b1fb1
"""

CORPORA: dict[str, dict[str, str]] = {}
for _line in TABLE.strip().splitlines():
    _corpus, _kind, _display, _color = _line.split(" | ")
    CORPORA[_corpus] = {"path": f"data/{_corpus}.txt", "kind": _kind, "display": _display.replace("\\n", "\n"), "color": _color}

#: Groups, in order.
GROUPS: dict[str, list[str]] = {
    "LATIN_SOURCES": "Evangelium CorpusJuris Etymologiae LexVisigothorum ExceptPetri".split(),
    "CATALAN_SOURCES": """
        CostumsDeTortosa CostumsDeLleida ConstitucionesBaiulieMirabeti CostumsDeOrta RecognovrentProceres CostumresDeTarrega
        CostumsDeValdAran PragmaticaJaimeII1295 PragmaticaJaimeII1301 CostumsDePerpinya
    """.split(),
    "GRAMOTY": "Acta911 Acta12".split(),
}


def place(files: Mapping[str, str]) -> None:
    """Where corpora's files are, for those that aren't in data/ under the corpus' own name."""
    for corpus, path in files.items():
        CORPORA.setdefault(corpus, {"kind": "", "display": corpus, "color": "#999999"})["path"] = path


def resolve(items: Sequence[str], groups: Mapping[str, Sequence[str]] | None = None) -> list[str]:
    """Names with ``@GROUP`` as its members; a group that isn't known has none."""
    groups = GROUPS if groups is None else groups
    return [y for x in items for y in (groups.get(x[1:], []) if x.startswith("@") else [x])]


def order_of(items: Sequence[str]) -> dict[str, int]:
    """Each corpus' first place."""
    out: dict[str, int] = {}
    for i, x in enumerate(items):
        out.setdefault(x, i)
    return out


def corpora_frame(spark: SparkSession, corpora: Mapping[str, Mapping[str, str]] | None = None) -> DataFrame:
    rows = [(k, v.get("path"), v.get("kind"), v.get("display", k), v.get("color")) for k, v in (CORPORA if corpora is None else corpora).items()]
    return spark.createDataFrame(rows, "corpus string, path string, kind string, display string, color string")


def docx_text(raw: bytes, fast_above: int = 500_000) -> str:
    """Paragraphs of a .docx; a large one by stripping its tags."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    if len(raw) > fast_above:
        text = re.sub(r"<[^>]+>", "", re.sub(r"<w:p[^>]*>", "\n", xml))
        for name, sign in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            text = text.replace(name, sign)
        return re.sub(r"\n{3,}", "\n\n", text)
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    signs = {f"{w}tab": "\t", f"{w}br": "\n", f"{w}cr": "\n"}
    body = ElementTree.fromstring(xml).find(f"{w}body")
    paragraphs = [] if body is None else body.findall(f"{w}p")
    return "\n".join("".join(x.text or "" if x.tag == f"{w}t" else signs.get(x.tag, "") for x in p.iter()) for p in paragraphs)


def read_files(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``corpus, path, content`` of named files, .docx or UTF-8 with bad bytes replaced. A missing file is an error.

    Each file is one row, decoded where it is read.
    """
    raw = spark.read.format("binaryFile").load(list(paths.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [docx_text(bytes(x)) if p.endswith(".docx") else bytes(x).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for p, x in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "content": texts})

    names = spark.createDataFrame([(k, v.rsplit("/", 1)[-1]) for k, v in paths.items()], "corpus string, file string")
    found = raw.select("path", "content").mapInPandas(run, "path string, content string").withColumn("file", F.regexp_replace(F.url_decode(F.element_at(F.split("path", "/"), -1)), "^.*/", ""))
    return found.join(F.broadcast(names), "file").select("corpus", "path", "content")


def file_meta(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """``path, length, modificationTime`` and a hash of the content, without the content."""
    raw = spark.read.format("binaryFile").load(list(paths.values()))
    return raw.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def read_edges_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a CSV with a header, as strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


#: Names that a table's ends and weights may go by, the first that is there.
LEFT_NAMES = "left source src from left_node left_corpus node_u u".split()
RIGHT_NAMES = "right target dst to right_node right_corpus node_v v".split()
WEIGHT_NAMES = "weight edge_weight score value hits count".split()


def _first(names: Iterable[str], columns: Sequence[str]) -> str | None:
    return next((x for x in names if x in columns), None)


def graph_from_table(table: DataFrame) -> DataFrame:
    """``u, v, weight`` of a table of edges, undirected: of a directed edge that repeats the last row stands, then both directions are added up."""
    from palimpsest.operators.edges import collapse_undirected

    left, right, weight = _first(LEFT_NAMES, table.columns), _first(RIGHT_NAMES, table.columns), _first(WEIGHT_NAMES, table.columns)
    if left is None or right is None:
        raise ValueError(f"no columns for the ends of edges among {table.columns}")
    w = F.coalesce(F.col(weight).try_cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = table.select(F.trim(F.col(left).cast("string")).alias("u"), F.trim(F.col(right).cast("string")).alias("v"), w.alias("weight"), F.monotonically_increasing_id().alias("_row"))
    rows = rows.where("u <> '' AND v <> '' AND u <> 'nan' AND v <> 'nan'").groupBy("u", "v").agg(F.max_by("weight", "_row").alias("weight"))
    return collapse_undirected(rows)


def graph_from_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``node, label`` and undirected ``u, v, weight`` of a GEXF file."""
    from palimpsest.operators.edges import collapse_undirected

    raw = spark.read.text(path, wholetext=True).first()[0]
    root = ElementTree.fromstring(raw.encode())
    tag = lambda x: x.tag.rsplit("}", 1)[-1]
    titles = {x.get("id"): x.get("title") for x in root.iter() if tag(x) == "attribute"}
    nodes, edges = [], []
    for x in root.iter():
        if tag(x) == "node":
            nodes.append((x.get("id").strip(), x.get("label")))
        elif tag(x) == "edge":
            own = {titles.get(v.get("for")): v.get("value") for v in x.iter() if tag(v) == "attvalue"}
            edges.append((x.get("source").strip(), x.get("target").strip(), x.get("weight") or own.get("weight") or "1.0"))
    frame = spark.createDataFrame(edges, "u string, v string, weight string")
    return spark.createDataFrame(nodes, "node string, label string"), collapse_undirected(frame)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".gexf"):
        return graph_from_gexf(spark, path)[1]
    if path.lower().endswith(".csv"):
        return graph_from_table(read_edges_csv(spark, path))
    raise ValueError("only .gexf and .csv")
