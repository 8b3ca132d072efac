"""Document quality: a generalised additive model with pairwise interactions.

Each text becomes a row of surface features, each feature an ordinal bin.  Cyclic boosting visits the
features in turn and fits a shallow tree on the bins' gradients; the trees of a feature add up to one
lookup table.  Then the pairs of features that still explain most get two-way tables in the same way.
A score is the logistic of the intercept plus one table entry a feature and pair, added up for whole
Arrow batches at a time.

Learning reads a bounded sample (``SAMPLE`` labelled rows in expectation, chosen by a hash of the id) of
rows outside the held-out quarter; of ids that documents repeat, at most twice as many rows, by a hash).
Labels, language, source and id are no inputs.

Defined results: null and empty texts are scored like any text without characters; a very long text is scored
whole, in memory that grows with it; without any labels each score is 0.5, with one class it is that class'
smoothed share; labels repeated for an id count once (the smallest); values on the edge of a bin (ties) belong to
the upper bin; each input row gives one output row, so repeated rows repeat their score; an empty table gives an
empty result; other columns are kept (``score``) or not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import frugal, held_out
from shelfmark.llm.words import blocks, word_hashes

SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, DEPTH, RIDGE = 120, 40, 0.1, 2, 1.0
#: A score from here on predicts label 1.
ACCEPT = 0.7

#: Character groups, each counted as a share of the bytes.
GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\r",
    "newline": b"\n",
    "stop": b".,;:?",
    "shout": b"!",
    "bar": b"|<>{}[]\\/_=+",
    "symbol": b"#$%&*@^~",
    "wide": bytes(range(128, 256)),
}
FEATURES = [*GROUPS, "bytes", "words", "word_length", "distinct", "commonest", "echo", "line_words", "line_repeats", "upper_of_letters", "long_words"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(texts)
    out = np.zeros((n, len(FEATURES)))
    size = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    group_of = np.full(256, len(GROUPS), np.int64)
    for k, members in enumerate(GROUPS.values()):
        group_of[list(members)] = k
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * (len(GROUPS) + 1) + group_of[data], minlength=n * (len(GROUPS) + 1)).reshape(n, -1)
    least = np.maximum(size, 1)
    out[:, : len(GROUPS)] = counts[:, : len(GROUPS)] / least[:, None]
    at = {name: k for k, name in enumerate(FEATURES)}
    names = list(GROUPS)
    letters = counts[:, names.index("upper")] + counts[:, names.index("lower")] + counts[:, names.index("wide")]
    out[:, at["upper_of_letters"]] = counts[:, names.index("upper")] / np.maximum(letters, 1)
    out[:, at["bytes"]] = np.log1p(size)

    words, number = word_hashes(texts)
    owner = np.repeat(np.arange(n), number)
    many = np.maximum(number, 1)
    out[:, at["words"]] = np.log1p(number)
    out[:, at["word_length"]] = letters / many
    order = np.lexsort((words, owner))
    first = np.ones(words.size, bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    runs = np.flatnonzero(first)
    top = np.zeros(n)
    np.maximum.at(top, owner[order][runs], np.diff(np.append(runs, words.size)))
    out[:, at["distinct"]] = np.bincount(owner[order][runs], minlength=n) / many
    out[:, at["commonest"]] = top / many
    if words.size > 1:
        same = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
        out[:, at["echo"]] = np.bincount(owner[1:][same], minlength=n) / many
    out[:, at["long_words"]] = letters / np.maximum(number + counts[:, names.index("space")], 1)

    lines = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts])])
    out[:, at["line_words"]] = np.log1p(number / np.maximum(np.diff(lines), 1))
    repeats = [len(parts) - len(set(parts)) for parts in (t.split(b"\n") for t in texts)]
    out[:, at["line_repeats"]] = np.array(repeats) / np.maximum(np.diff(lines), 1) if n else 0
    return out


def _tree(gradient: np.ndarray, hessian: np.ndarray, depth: int) -> np.ndarray:
    """Values of a shallow regression tree over ordinal bins."""
    total_g, total_h = gradient.sum(), hessian.sum()
    value = np.full(gradient.size, -total_g / (total_h + RIDGE))
    if depth == 0 or gradient.size < 2:
        return value
    g, h = np.cumsum(gradient)[:-1], np.cumsum(hessian)[:-1]
    gain = g**2 / (h + RIDGE) + (total_g - g) ** 2 / (total_h - h + RIDGE) - total_g**2 / (total_h + RIDGE)
    at = int(gain.argmax()) + 1
    if gain[at - 1] <= 1e-9:
        return value
    return np.concatenate([_tree(gradient[:at], hessian[:at], depth - 1), _tree(gradient[at:], hessian[at:], depth - 1)])


def _grid_tree(gradient: np.ndarray, hessian: np.ndarray) -> tuple[np.ndarray, float]:
    """A four-leaf tree over two ordinal features (one cut in each), and its gain."""
    best, value = 0.0, np.zeros_like(gradient)
    cg, ch = gradient.cumsum(0).cumsum(1), hessian.cumsum(0).cumsum(1)
    base = cg[-1, -1] ** 2 / (ch[-1, -1] + RIDGE)
    for i in range(gradient.shape[0] - 1):
        for j in range(gradient.shape[1] - 1):
            parts = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j])]
            parts.append((cg[-1, -1] - sum(p[0] for p in parts), ch[-1, -1] - sum(p[1] for p in parts)))
            gain = sum(g * g / (h + RIDGE) for g, h in parts) - base
            if gain > best:
                leaf = [-g / (h + RIDGE) for g, h in parts]
                best = gain
                value = np.empty_like(gradient)
                value[: i + 1, : j + 1], value[: i + 1, j + 1 :], value[i + 1 :, : j + 1], value[i + 1 :, j + 1 :] = leaf
    return value, best


@dataclass
class Model:
    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[k], rows[:, k], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], rows[:, a], side="right"), np.searchsorted(self.pair_edges[b], rows[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Cyclic boosting of main effects, then of the pairs with the largest remaining gain."""
    width = rows.shape[1]
    cuts = lambda bins: [np.unique(np.quantile(rows[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if len(rows) else np.empty(0) for k in range(width)]
    edges, pair_edges = cuts(BINS), cuts(PAIR_BINS)
    tables = [np.zeros(e.size + 1) for e in edges]
    share = (labels.sum() + 1) / (len(labels) + 2)
    intercept = float(np.log(share / (1 - share)))
    model = Model(edges, pair_edges, intercept, tables, [])
    if len(set(labels.tolist())) < 2:
        return model
    bins = [np.searchsorted(edges[k], rows[:, k], side="right") for k in range(width)]
    grid = [np.searchsorted(pair_edges[k], rows[:, k], side="right") for k in range(width)]
    total = np.full(len(rows), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - labels, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            n = tables[k].size
            step = RATE * _tree(np.bincount(bins[k], g, n), np.bincount(bins[k], h, n), DEPTH)
            tables[k] += step
            total += step[bins[k]]
    g, h = slopes()

    def cells(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = (pair_edges[a].size + 1, pair_edges[b].size + 1)
        return np.bincount(grid[a] * shape[1] + grid[b], values, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((-_grid_tree(cells(a, b, g), cells(a, b, h))[1], a, b) for a, b in combinations(range(width), 2)))
    model.pairs = [(a, b, np.zeros((pair_edges[a].size + 1, pair_edges[b].size + 1))) for _, a, b in gains[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = RATE * _grid_tree(cells(a, b, g), cells(a, b, h))[0]
            table += step
            total += step[grid[a], grid[b]]
    return model


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    frugal()
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        for a, b in blocks(texts):
            rows = features(texts[a:b])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], flat], names=["order", "label", "row"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out quarter."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("l_id")).agg(F.min(label_col).cast("int").alias("label"))
    share = min(1.0, sample / max(known.count(), 1))
    known = known.where(F.pmod(F.xxhash64("l_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).join(known, F.col("id") == F.col("l_id"))
    rows = rows.select(F.xxhash64("id", "text").alias("order"), "label", "text").mapInArrow(_feature_batches, "order bigint, label int, row array<double>")
    # rows of repeated ids: the same ones each time, by a hash
    table = rows.orderBy("order", "label").limit(2 * sample).toArrow().sort_by("order")
    x = np.array(table["row"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    return fit(x, table["label"].to_numpy().astype(float))


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``df`` with the score of each row's whole text, in place of a column of that name."""
    df = df.drop(out_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            scores = np.concatenate([np.empty(0), *[model.score(features(texts[a:b])) for a, b in blocks(texts)]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, out_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{out_col}` double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document, as the query returns them."""
    model = learn(docs, labels)
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
