"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioflow.llm.shared import prepare

FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "repeated_next", "top_word", "upper_letters", "digits", "stops",
    "symbols", "spaces", "lines", "exclamations", "bars", "not_letter_end", "short_lines", "repeated_lines", "beyond_ascii",
)
_LOWER, _UPPER, _DIGIT, _SPACE, _STOP, _SYMBOL = range(6)
_classes: list = []


def _class_table() -> np.ndarray:
    """Code point to its class; what is neither letter, digit, space nor stop counts as symbol."""
    if not _classes:
        table = np.full(0x110000, _SYMBOL, np.uint8)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                table[c] = _UPPER if s.isupper() else _LOWER
            elif s.isdigit():
                table[c] = _DIGIT
            elif s.isspace():
                table[c] = _SPACE
        table[[ord(c) for c in ".,;:?'\"()-"]] = _STOP
        _classes.append(table)
    return _classes[0]


def features(text: str) -> list[float]:
    """The figures of a whole text, in the order of FEATURES; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, w = len(text), len(words)
    counts = Counter(words)
    kinds = np.bincount(_class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")], minlength=6).tolist()
    letters = max(1, kinds[_LOWER] + kinds[_UPPER])
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(n), np.log1p(w), (n - kinds[_SPACE]) / w, len(counts) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        max(counts.values()) / w, kinds[_UPPER] / letters, kinds[_DIGIT] / n, kinds[_STOP] / n, kinds[_SYMBOL] / n, kinds[_SPACE] / n,
        len(lines) / w, text.count("!") / w, text.count("|") / w, sum(not x[-1].isalpha() for x in words) / w,
        sum(len(x) < 40 for x in lines) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), 1 - len(text.encode("ascii", "ignore")) / n,
    ]


@dataclass
class AdditiveModel:
    """Lookup tables: a score is the intercept plus one entry a feature and one a pair of features."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, by adding up bins of whole columns."""
        total = np.full(len(x), self.intercept)
        for j, (edges, added) in enumerate(zip(self.edges, self.tables)):
            total += added[np.searchsorted(edges, x[:, j], side="right")]
        bins = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (j, k), grid in zip(self.pairs, self.grids):
            total += grid[bins[j], bins[k]]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g, h, ridge):
    return g * g / (h + ridge)


def _shallow_tree(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Newton steps of a tree with at most ``leaves`` leaves on ordered bins, one step a bin."""
    cuts = [0, len(g)]
    gs, hs = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            left_g, left_h = gs[a + 1 : b] - gs[a], hs[a + 1 : b] - hs[a]
            all_g, all_h = gs[b] - gs[a], hs[b] - hs[a]
            gain = _gain(left_g, left_h, ridge) + _gain(all_g - left_g, all_h - left_h, ridge) - _gain(all_g, all_h, ridge)
            if gain.max() > best:
                best, where = gain.max(), a + 1 + int(gain.argmax())
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut on each of two axes: its gain, and the Newton step of each cell."""
    gs, hs = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)
    parts = []
    for s in (gs, hs):
        a = s[i, j]
        b, c = s[i, -1] - a, s[-1, j] - a
        parts.append((a, b, c, s[-1, -1] - a - b - c))
    gain = sum(_gain(p, q, ridge) for p, q in zip(*parts)) - _gain(gs[-1, -1], hs[-1, -1], ridge)
    at = np.unravel_index(gain.argmax(), gain.shape)
    steps = [p[at] / (q[at] + ridge) for p, q in zip(*parts)]
    out = np.empty_like(g)
    r, c = at[0] + 1, at[1] + 1
    out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:] = steps
    return float(gain[at]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 0.1, bins: int = 64, pairs: int = 6, pair_bins: int = 12, ridge: float = 1.0) -> AdditiveModel:
    """Cyclic boosting: in each round every feature gets one shallow tree, added to its table.

    Then the pairs of features that cut the remaining error best get grids, boosted
    the same way by trees with one cut on each axis. With one label only, or no
    rows, the score is constant.
    """
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        prior = (y.sum() + 0.5) / (len(y) + 1)
        return AdditiveModel(float(np.log(prior / (1 - prior))), [np.empty(0)] * width, [np.zeros(1)] * width)
    model = AdditiveModel(float(np.log(y.mean() / (1 - y.mean()))), [_edges(x[:, j], bins) for j in range(width)], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            size = len(model.tables[j])
            step = rate * _shallow_tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size), ridge)
            model.tables[j] += step
            total += step[at[j]]
    model.coarse = [_edges(x[:, j], pair_bins) for j in range(width)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.coarse)]

    def grid(values: np.ndarray, j: int, k: int) -> np.ndarray:
        shape = len(model.coarse[j]) + 1, len(model.coarse[k]) + 1
        return np.bincount(rough[j] * shape[1] + rough[k], values, shape[0] * shape[1]).reshape(shape)

    g, h = slopes()
    ranked = sorted(((_quadrants(grid(g, j, k), grid(h, j, k), ridge)[0], j, k) for j, k in combinations(range(width), 2)), reverse=True)
    model.pairs = [(j, k) for gain, j, k in ranked[:pairs] if gain > 0]
    model.grids = [np.zeros((len(model.coarse[j]) + 1, len(model.coarse[k]) + 1)) for j, k in model.pairs]
    for _ in range(rounds // 2):
        for n, (j, k) in enumerate(model.pairs):
            g, h = slopes()
            step = rate * _quadrants(grid(g, j, k), grid(h, j, k), ridge)[1]
            model.grids[n] += step
            total += step[rough[j], rough[k]]
    return model


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on at most ``most_rows`` labelled documents, picked by a hash of the id.

    The picked ids, bounded by that number, are broadcast to the documents; what
    comes back is a row of figures of each picked whole text, by the same order of
    hashes ``most_rows`` at most, however often an id stands. Labels other than
    0 and 1, null ids and null texts are left out; a repeated label counts each time.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    space, n = 1 << 30, known.count()
    cutoff = min(space, (3 * space * most_rows // 2 + 100 * space) // max(n, 1))  # half as many again, of which the least hashes are taken
    mark = F.pmod(F.xxhash64(F.col("k"), F.lit("quality")), F.lit(space))
    picked = known.withColumn("mark", mark).where(F.col("mark") < cutoff).orderBy("mark", "k", "y").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).where("k is not null and t is not null").join(F.broadcast(picked), "k")

    def figures(batches):
        for batch in batches:
            rows = [np.asarray(features(t), float).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(rows, pa.binary())], names=["k", "y", "mark", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    shown = texts.select("k", "t", "y", "mark").mapInArrow(figures, f"k {kind}, y int, mark long, f binary")
    got = sorted((r["k"], r["f"], r["y"]) for r in shown.orderBy("mark", "k", "f", "y").limit(most_rows).collect())
    x = np.frombuffer(b"".join(r[1] for r in got)).reshape(len(got), len(FEATURES)) if got else np.empty((0, len(FEATURES)))
    return fit(x, np.array([r[2] for r in got], float))


def scored(docs: DataFrame, model: AdditiveModel, text_col: str = "text") -> DataFrame:
    """``docs`` with a column score between 0 and 1, which replaces any of that name.

    A null text counts as empty; both get the score of a text whose figures are
    all zero. Nothing is shuffled; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    kept = docs.drop("score")
    names, at = kept.columns, kept.columns.index(text_col)

    def score(batches):
        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*names, "score"])

    return kept.mapInArrow(score, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
