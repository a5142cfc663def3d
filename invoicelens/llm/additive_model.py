"""Quality classifier: a generalised additive model with pairwise interactions.

Text features are cut into bins at quantiles. Boosting goes round the features again and again; each step fits a shallow tree
on the bins of one feature to the gradient of the log loss and adds it, damped, to that feature's lookup table. Then the
pairs of features with the most left to explain get tables of their own in the same way. A score is a sum of table entries,
one addition per feature and pair over whole batches.

The model is fitted on at most ``train_rows`` labelled rows, taken in the order of a hash of their ids, so the sample is
bounded and the same at every run; every document is scored.

Cases: NULL and empty texts are scored as texts without words; repeated rows get equal scores; with no labels, or labels of
one kind only, every score is the share of label 1 (one half without labels); several labels of a document count as the
largest; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .batches import map_texts
from .quality_rules import Measured

TRAIN_ROWS = 6000
BINS = 24
PAIR_BINS = 8
ROUNDS = 150
RATE = 0.1
PAIRS = 6
MOST_LOGIT = 8.0

FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeated", "marks", "capitals", "stutters", "distinct", "digits",
            "stops", "line_words")


def features(text: str) -> tuple[float, ...]:
    m = Measured(text)
    n = max(1, m.n_words)
    raw = m.raw
    return (
        np.log1p(m.n_words), m.word_chars / n, m.n_symbols / n, m.n_dup_lines / max(1, len(m.lines)), m.n_repeat_words / n,
        m.n_marks / n, m.n_upper / n, m.n_stutters / n, len(set(m.words)) / n ** 0.7,
        (len(raw) - len(raw.translate(None, b"0123456789"))) / n, (raw.count(b".") + raw.count(b",")) / n,
        np.log1p(m.n_words / max(1, len(m.lines))),
    )


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = 3, ridge: float = 1.0) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves over ordered bins."""
    g, w = np.concatenate([[0.0], np.cumsum(gradient)]), np.concatenate([[0.0], np.cumsum(weight)])
    gain = lambda a, b: (g[b] - g[a]) ** 2 / (w[b] - w[a] + ridge)
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                gains = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                if gains.max() > best[0]:
                    best = (gains.max(), k, int(cuts[gains.argmax()]))
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    values = np.zeros(len(gradient))
    for a, b in parts:
        values[a:b] = (g[b] - g[a]) / (w[b] - w[a] + ridge)
    return values


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A tree of one cut along the first axis, then one along the second on each side; ties go to the first cut."""
    rows = _tree(gradient.sum(1), weight.sum(1), 2)
    sides = np.unique(rows)
    values = np.zeros_like(gradient)
    for side in sides:
        chosen = rows == side
        values[chosen] = _tree(gradient[chosen].sum(0), weight[chosen].sum(0), 2)
    return values


@dataclass
class AdditiveModel:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[i], coarse[j]]
        return np.clip(total, -MOST_LOGIT, MOST_LOGIT)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, so that equal values share a bin and a rare value can have its own."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    picked = np.unique(np.concatenate([np.quantile(column, np.linspace(0, 1, bins // 2 + 1)[1:-1]),
                                       np.quantile(values, np.linspace(0, 1, bins // 2 + 1)[1:-1])]))
    return picked


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS) -> AdditiveModel:
    if len(y) == 0:
        return AdditiveModel()
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = AdditiveModel(base=float(np.log(share / (1 - share))))
    if y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(n_features)]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(n_features)]
    binned = [np.searchsorted(model.edges[j], x[:, j], side="right") for j in range(n_features)]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="right") for j in range(n_features)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    logit = np.full(len(y), model.base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n_features):
            g, w = slope()
            size = len(model.tables[j])
            step = rate * _tree(np.bincount(binned[j], g, size), np.bincount(binned[j], w, size))
            model.tables[j] += step
            logit += step[binned[j]]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        shape = (len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)
        return np.bincount(coarse[i] * shape[1] + coarse[j], values, shape[0] * shape[1]).reshape(shape)

    g, w = slope()
    gain = {(i, j): float((grid(i, j, g) ** 2 / (grid(i, j, w) + 1.0)).sum()) for i, j in combinations(range(n_features), 2)}
    model.pairs = sorted(gain, key=lambda p: (-gain[p], p))[:pairs]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            g, w = slope()
            step = rate * _pair_tree(grid(i, j, g), grid(i, j, w))
            model.pair_tables[k] += step
            logit += step[coarse[i], coarse[j]]
    return model


def held_out(id_column: Column, modulus: int = 3, remainder: int = 1) -> Column:
    """Whether a row is kept from training, by the CRC of its id as text; a NULL id isn't."""
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          train_rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Fits the model on at most ``train_rows`` labelled documents outside the held-out part."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sample = (known.groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label_col).cast("int").alias("sample_label"))
              .orderBy(F.xxhash64("sample_id"), "sample_id").limit(train_rows))
    chosen = docs.select(docs[id_col].alias("sample_id"), docs[text_col].alias("text")).join(F.broadcast(sample), "sample_id")
    rows = map_texts(chosen.select(F.struct("sample_id", "sample_label").alias("key"), "text"), "key", "text", "x array<double>",
                     lambda texts: {"x": [list(map(float, features(t))) for t in texts]})
    rows = rows.select("key.sample_id", "key.sample_label", "x").limit(2 * train_rows).toPandas().sort_values("sample_id")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["sample_label"].to_numpy(dtype=float))


def score_documents(docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score) of every document."""
    def per_slice(texts: list[str]) -> dict[str, list]:
        return {"score": model.scores(np.array([features(t) for t in texts], dtype=float)).tolist()}

    return map_texts(docs, id_col, text_col, "score double", per_slice)
