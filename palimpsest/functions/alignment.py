"""Vectorised kernels over two lists of tokens: edit distances, soft cosine, local alignment."""

from __future__ import annotations

from collections import Counter

import numpy as np

#: What two sums that should be equal may differ by.
NEAR = 1e-9


def _letters(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    out = np.zeros((len(tokens), int(sizes.max(initial=0))), np.uint32)
    for row, token in zip(out, tokens, strict=True):
        row[: len(token)] = np.frombuffer(token.encode("utf-32-le"), np.uint32)
    return out, sizes


def edit_distances(a: list[str], b: list[str], most: int) -> np.ndarray:
    """Levenshtein distances of all tokens of ``a`` to all of ``b``, ``most + 1`` for what is above ``most``.

    Pairs whose lengths or letters rule them out are left out; the others go through the table of the recurrence together, one cell of all pairs at a time.
    """
    out = np.full((len(a), len(b)), most + 1, np.int64)
    if not a or not b:
        return out
    (la, na), (lb, nb) = _letters(a), _letters(b)
    # an edit changes one or two of the letters that occur, so more than that many others rule a pair out
    xa, xb = (np.bitwise_or.reduce(np.where(x > 0, np.uint64(1) << (x.astype(np.uint64) & np.uint64(63)), np.uint64(0)), axis=1) for x in (la, lb))
    i, j = np.nonzero((np.abs(na[:, None] - nb[None, :]) <= most) & (np.bitwise_count(xa[:, None] ^ xb[None, :]) <= 2 * most))
    if not len(i):
        return out
    x, y, n, m = la[i], lb[j], na[i], nb[j]
    wide = y.shape[1]
    row = np.tile(np.arange(wide + 1, dtype=np.int16), (len(i), 1))
    found = np.where(n == 0, m, most + 1)
    for r in range(1, x.shape[1] + 1):
        above, row = row, np.empty_like(row)
        row[:, 0] = r
        for c in range(1, wide + 1):
            row[:, c] = np.minimum(np.minimum(above[:, c], row[:, c - 1]) + 1, above[:, c - 1] + (x[:, r - 1] != y[:, c - 1]))
        done = n == r
        found[done] = row[done, m[done]]
    out[i, j] = np.minimum(found, most + 1)
    return out


def _similar(a: list[str], b: list[str], most: int) -> np.ndarray:
    """1 for equal tokens, 1 - d / longer length up to ``most`` edits, else 0."""
    d = edit_distances(a, b, most)
    longer = np.maximum(np.array([len(x) for x in a])[:, None], np.array([len(x) for x in b])[None, :])
    return np.where(d > most, 0.0, 1.0 - d / np.maximum(longer, 1))


def term_similarity(a: str, b: str, most: int) -> float:
    return 1.0 if a == b else float(_similar([a], [b], most)[0, 0])


def hard_cosine(a: list[str], b: list[str]) -> float:
    x, y = Counter(a), Counter(b)
    norm = sum(v * v for v in x.values()) * sum(v * v for v in y.values())
    return sum(n * y[t] for t, n in x.items()) / norm**0.5 if norm else 0.0


def soft_cosine(a: list[str], b: list[str], most: int = 2, max_terms: int = 500) -> float:
    """Cosine in which near terms count by their similarity; the hard one where both have more than ``max_terms`` terms together."""
    if not a or not b:
        return 0.0
    x, y = Counter(a), Counter(b)
    terms = sorted(x.keys() | y.keys())
    if len(terms) > max_terms:
        return hard_cosine(a, b)
    near = _similar(terms, terms, most)
    u, v = np.array([x[t] for t in terms], float), np.array([y[t] for t in terms], float)
    own = (u @ near @ u) * (v @ near @ v)
    return float(u @ near @ v / own**0.5) if own > 0 else 0.0


def tesserae(a: list[str], b: list[str], idf: dict[str, float]) -> float:
    """Summed idf of the shared lemmas, two at least, by the root of the product of the sets' sizes."""
    x, y = set(a), set(b)
    shared = x & y
    return sum(idf.get(t, 0.0) for t in sorted(shared)) / (len(x) * len(y)) ** 0.5 if len(shared) >= 2 else 0.0


def smith_waterman(a: list[str], b: list[str], match: float = 2, mismatch: float = -1, gap: float = -1, near: int = 2, longest: int = 300) -> tuple[list[str], list[str], float]:
    """Best local alignment of the first ``longest`` tokens: both rows, with ``-`` for gaps, and its score.

    Equal tokens score ``match``, those within ``near`` edits their share of it, others ``mismatch``. Each row of the
    table is done at once: what a run of gaps to the left gives is a running maximum. Of equal scores
    the first cell by rows is the end, and going back a pairing is preferred to a gap in ``b``, and that to one in ``a``.
    """
    a, b = ([t for t in x if t][:longest] for x in (a, b))
    if not a or not b:
        return [], [], 0.0
    ta, ia = np.unique(np.array(a, object), return_inverse=True)
    tb, ib = np.unique(np.array(b, object), return_inverse=True)
    d = edit_distances(ta.tolist(), tb.tolist(), near)
    longer = np.maximum(np.array([len(t) for t in ta])[:, None], np.array([len(t) for t in tb])[None, :])
    pay = np.where(d == 0, float(match), np.where(d <= near, match * (1.0 - d / np.maximum(longer, 1)), float(mismatch)))[ia][:, ib]
    m, n = len(a), len(b)
    table, slope = np.zeros((m + 1, n + 1)), gap * np.arange(n + 1)
    for i in range(1, m + 1):
        free = np.maximum(table[i - 1] + gap, 0.0)
        free[1:] = np.maximum(free[1:], table[i - 1, :-1] + pay[i - 1])
        free[0] = 0.0
        table[i] = np.maximum.accumulate(free - slope) + slope
    rounded = np.round(table, 9)
    i, j = np.unravel_index(int(np.argmax(rounded)), table.shape)
    best, left, right = float(rounded[i, j]), [], []
    while i > 0 and j > 0 and rounded[i, j] > 0:
        here = table[i, j]
        if abs(table[i - 1, j - 1] + pay[i - 1, j - 1] - here) < NEAR:
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif abs(table[i - 1, j] + gap - here) < NEAR:
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    return left[::-1], right[::-1], best
