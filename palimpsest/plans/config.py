"""Experiments: which corpora are held against which, and how."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from palimpsest.operators.chunking import MODE
from palimpsest.sources.corpora import GROUPS, resolve


@dataclass(frozen=True)
class Chunking:
    enabled: bool = False
    mode: str = MODE
    window_words: int = 180
    overlap_words: int = 60
    min_words: int = 20
    per_corpus: Mapping[str, Mapping] = field(default_factory=dict)


@dataclass(frozen=True)
class Retrieval:
    mode: str = "pair_quota"
    budget: int = 5000
    pair_budget_strategy: str = "weighted_sqrt"
    min_pair_budget: int | None = 100
    max_pair_budget: int | None = None
    per_left_leaf_cap: int = 10
    per_right_leaf_cap: int = 10
    global_budget_after_merge: int | None = 5000
    bidirectional: bool = False


@dataclass(frozen=True)
class Model:
    min_lemma_length: int = 3
    ngram_range: tuple[int, int] = (1, 3)
    max_df: float | int = 0.50
    min_df: int = 2
    soft_cosine_max_terms: int = 500
    sw_match: int = 2
    sw_mismatch: int = -1
    sw_gap: int = -1
    sw_lev_bonus_threshold: int = 2
    sw_max_seq_len: int = 300


@dataclass(frozen=True)
class Aggregation:
    left_node_level: str = "parent"
    right_node_level: str = "parent"
    weight_mode: str = "max"
    min_hits: int = 1


@dataclass(frozen=True)
class Drawing:
    enabled: bool = True
    straight_edges: bool = True
    edge_color_by: str = "left_corpus"
    label_left: bool = True
    label_right: bool = True
    top_n_edges: int | None = 50


@dataclass(frozen=True)
class Experiment:
    name: str
    left: Sequence[str]
    right: Sequence[str]
    mappings: Sequence[tuple[Sequence[str], Sequence[str]]] = ()
    description: str = ""
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    model: Model = Model()
    aggregation: Aggregation = Aggregation()
    drawing: Drawing = Drawing()
    keep_layers: int = 1
    graph_top_n: int = 30
    scoring_progress_every: int = 1000

    def resolved(self, groups: Mapping[str, Sequence[str]] | None = None) -> Experiment:
        """Groups as their members."""
        return replace(self, left=resolve(self.left, groups), right=resolve(self.right, groups), mappings=[(resolve(a, groups), resolve(b, groups)) for a, b in self.mappings])

    @property
    def corpora(self) -> list[str]:
        return sorted({*self.left, *self.right})

    def validate(self) -> None:
        if self.retrieval.budget <= 0:
            raise ValueError(f"{self.name}: retrieval.budget must be positive, got {self.retrieval.budget}")
        if self.graph_top_n <= 0:
            raise ValueError(f"{self.name}: graph_top_n must be positive, got {self.graph_top_n}")
        if self.keep_layers <= 0:
            raise ValueError(f"{self.name}: keep_layers must be positive, got {self.keep_layers}")

    def as_dict(self) -> dict:
        return asdict(self)


# --- fixed values: the five experiments ------------------------------------------

_OFF = {"enabled": False}


def _window(words: int, overlap: int, least: int = 40) -> dict:
    return {"window_words": words, "overlap_words": overlap, "min_words": least}


_LATIN = {
    "CorpusJuris": _OFF, "Evangelium": _window(140, 50), "LexVisigothorum": _window(170, 60), "ExceptPetri": _window(170, 50),
    "Etymologiae": _window(170, 60), "UsatgesBarcelona": _OFF,
}
_CODES = {
    "UsatgesBarcelona": _OFF, "CostumsDeTortosa": _window(180, 60), "CostumsDeValdAran": _window(170, 50),
    **dict.fromkeys([x for x in GROUPS["CATALAN_SOURCES"] if x not in ("CostumsDeTortosa", "CostumsDeValdAran")], _OFF),
}
_WIDE = Retrieval(budget=5000, min_pair_budget=300, per_left_leaf_cap=12, per_right_leaf_cap=12, global_budget_after_merge=5000)
_TRIANGLE = [*GROUPS["CATALAN_SOURCES"], "UsatgesBarcelona"]

EXPERIMENTS: dict[str, Experiment] = {
    x.name: x
    for x in (
        Experiment(
            "test", ["Evangelium"], ["UsatgesBarcelona"], [(["Evangelium"], ["UsatgesBarcelona"])], "Smoke test",
            retrieval=Retrieval(budget=20), keep_layers=1, graph_top_n=50, scoring_progress_every=100,
        ),
        Experiment(
            "latin_to_usatges", ["@LATIN_SOURCES"], ["UsatgesBarcelona"], [(["@LATIN_SOURCES"], ["UsatgesBarcelona"])], "Latin sources in the Usatges",
            chunking=Chunking(True, MODE, 180, 60, 40, _LATIN), retrieval=_WIDE, keep_layers=3, graph_top_n=50, scoring_progress_every=250,
            aggregation=Aggregation("corpus", "parent", "max", 1),
        ),
        Experiment(
            "usatges_to_other_codes", ["UsatgesBarcelona"], ["@CATALAN_SOURCES"], [(["UsatgesBarcelona"], ["@CATALAN_SOURCES"])], "The Usatges in other codes",
            chunking=Chunking(True, MODE, 180, 60, 40, _CODES), retrieval=_WIDE, keep_layers=7, graph_top_n=50, scoring_progress_every=250,
            drawing=Drawing(edge_color_by="right_corpus"),
        ),
        Experiment(
            "left_to_gramoty", ["@LATIN_SOURCES", "UsatgesBarcelona"], ["@GRAMOTY"], [(["@LATIN_SOURCES", "UsatgesBarcelona"], ["@GRAMOTY"])], "Latin sources and the Usatges in charters",
            chunking=Chunking(True, MODE, 180, 60, 30, {**_LATIN, "Acta911": _window(220, 80, 30), "Acta12": _window(220, 80, 30)}), retrieval=_WIDE,
            keep_layers=2, graph_top_n=50, scoring_progress_every=250, aggregation=Aggregation("corpus", "parent", "max", 2),
        ),
        Experiment(
            "catalan_plus_usatges_upper_triangle", ["@CATALAN_SOURCES", "UsatgesBarcelona"], ["@CATALAN_SOURCES", "UsatgesBarcelona"],
            [([a], _TRIANGLE[i + 1 :]) for i, a in enumerate(_TRIANGLE[:-1])], "Each code in those after it",
            chunking=Chunking(True, MODE, 180, 60, 40, _CODES), retrieval=replace(_WIDE, budget=16000, global_budget_after_merge=16000), keep_layers=11,
            graph_top_n=100, scoring_progress_every=250, aggregation=Aggregation("corpus", "corpus", "max", 1), drawing=Drawing(top_n_edges=100),
        ),
    )
}


def experiment(name: str, experiments: Mapping[str, Experiment] | None = None) -> Experiment:
    known = EXPERIMENTS if experiments is None else experiments
    if name not in known:
        raise KeyError(f"Unknown experiment {name!r}. Available: {sorted(known)}")
    return known[name]
