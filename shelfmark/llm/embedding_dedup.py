"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept row per group.

Equal vectors of a label collapse to one class first.  Cell centres are fitted on a bounded sample and
every class is assigned to its nearest centre.  A vector also visits each higher-numbered cell whose
bisector with its own cell lies within the chord of the threshold: any partner in that cell is on the
other side of the bisector, so no linked pair is missed.  Cells are cut into blocks of about ``BLOCK``
vectors and every pair of blocks is one matrix product in double precision.  A product reports, for each
class, how many vectors it links and the smallest class its links reach there, never the pairs.

Dense neighbourhoods would be compared with themselves in full.  So balls are learned around the fullest ones of the
sample: vectors of a label within half the angle of the threshold of a ball's centre all link with each other, which a
count and a minimum for each ball report without any product.  Products leave these pairs out, and blocks of one ball do
not meet.

Defined results: null ids keep their row (they link by their vectors, but have no component of their own
beyond the smallest non-null id); vectors that are null, empty, zero, or hold null or non-finite
components, and rows with a null label, have no links and are their own component; equal vectors link
with each other; vectors of different length never link; ids are expected to be unique (rows that share
an id are one node of the link graph); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import cut, frugal
from shelfmark.llm.graph import connected_components

#: Vectors the cell centres are fitted on, at most (taken in order of a hash of the id).
SAMPLE = 8192
CELLS_LEAST, CELLS_MOST, CELL_TARGET = 8, 1024, 2048
#: Vectors of a block, and of the rows of a product computed at a time.
BLOCK, CHUNK = 2048, 512
ROUNDS = 12
#: Balls whose vectors all link are learned for neighbourhoods of so many sampled vectors or more, the fullest first.
BALLS, BALL_LEAST = 64, 8


def _unit(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1))


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """``k`` unit centres (fewer if there are fewer rows) of unit rows."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return np.unique(centres, axis=0)


def usable(embedding: str):
    """True for non-empty finite vectors with a non-zero component."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0), F.lit(False))


def dense_balls(rows: np.ndarray, threshold: float) -> np.ndarray:
    """Unit centres of the neighbourhoods that hold the most of these unit rows, each around rows of its own."""
    count = np.concatenate([(rows[a : a + CHUNK] @ rows.T >= threshold).sum(axis=1) for a in range(0, len(rows), CHUNK)])
    taken, centres = np.zeros(len(rows), bool), []
    for i in np.argsort(-count, kind="stable"):
        if count[i] < BALL_LEAST or len(centres) == BALLS:
            break
        if not taken[i]:
            near = rows @ rows[i] >= threshold
            centres.append(rows[near].mean(axis=0))
            taken |= near
    return _unit(np.stack(centres)) if centres else np.empty((0, rows.shape[1]))


def _visits(centres: dict[int, np.ndarray], balls: dict[int, np.ndarray], threshold: float):
    """Rows -> their own cell (home) and the higher cells that may hold partners, and the ball that they lie in (or -1)."""
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    half = math.acos(max(min(threshold, 1.0), -1.0)) / 2 - 1e-6

    def inside(unit: np.ndarray, size: int) -> np.ndarray:
        found = np.full(len(unit), -1, np.int32)
        if half > 0 and len(balls.get(size, ())):
            scores = unit @ balls[size].T
            best = scores.argmax(axis=1)
            ok = scores[np.arange(len(unit)), best] >= math.cos(half)
            found[ok] = best[ok]
        return found

    def run(batches):
        frugal()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            sizes = np.asarray(pc.list_value_length(table["vec"]))
            for size in np.unique(sizes):
                part = table.filter(pa.array(sizes == size))
                unit = _matrix(part["vec"])
                part = part.append_column("ball", pa.array(inside(unit, int(size))))
                c = centres.get(int(size))
                if c is None or len(c) == 1:
                    yield from part.append_column("cell", pa.array([0] * len(part), pa.int32())).append_column("home", pa.array([True] * len(part))).to_batches()
                    continue
                scores = unit @ c.T
                home = scores.argmax(axis=1)
                gaps = np.linalg.norm(c[:, None] - c[None], axis=2)
                near = (scores[np.arange(len(unit)), home][:, None] - scores) <= reach * gaps[home]
                near &= np.arange(len(c)) > home[:, None]
                near[np.arange(len(unit)), home] = True
                row, cell = np.nonzero(near)
                out = part.take(pa.array(row)).append_column("cell", pa.array(cell.astype(np.int32)))
                yield from out.append_column("home", pa.array(home[row] == cell)).to_batches()

    return run


def _links(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """Which rows of one block link with which of another: (ids, vectors, home, ball) of both."""
    out = np.empty((len(x[0]), len(y[0])), bool)
    for a in range(0, len(out), CHUNK):
        ids, unit, home, ball = (part[a : a + CHUNK, None] if part.ndim == 1 else part[a : a + CHUNK] for part in x)
        out[a : a + CHUNK] = (unit @ y[1].T >= threshold) & (home | y[2]) & ((ball < 0) | (ball != y[3])) & (ids != y[0])
    return out


def _products(threshold: float):
    """One pair of blocks -> (rep, linked vectors, smallest class reached)."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        frugal()
        reps, copies, block = (table[c].to_numpy() for c in ("rep", "n", "block"))
        columns = (reps, _matrix(table["vec"]), table["home"].to_numpy(), table["ball"].to_numpy())
        low, high = key[3].as_py(), key[4].as_py()
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        link = _links(tuple(c[x] for c in columns), tuple(c[y] for c in columns), threshold)
        x, y, link = x[link.any(axis=1)], y[link.any(axis=0)], link[link.any(axis=1)][:, link.any(axis=0)]
        links, root = np.zeros(len(reps), np.int64), reps.copy()
        links[x] = link @ copies[y]
        if low != high:
            links[y] = copies[x] @ link
        most = np.iinfo(np.int64).max
        while len(x):
            before = root.copy()
            for a in range(0, len(x), CHUNK):
                part = x[a : a + CHUNK]
                root[part] = np.minimum(root[part], np.where(link[a : a + CHUNK], root[y], most).min(axis=1))
            for a in range(0, len(y), CHUNK):
                part = y[a : a + CHUNK]
                root[part] = np.minimum(root[part], np.where(link[:, a : a + CHUNK].T, root[x], most).min(axis=1))
            if (root == before).all():
                break
        found = links > 0
        return pa.table({"rep": reps[found], "links": links[found], "root": root[found]})

    return run


def _pairs_of_blocks(visits: DataFrame) -> DataFrame:
    """Each row of a cell once for each pair of blocks that it takes part in.  A ball that fills a block in a cell has blocks
    of its own, which do not meet each other; all other rows share blocks."""
    cell = ["label", "dim", "cell"]
    sizes = visits.groupBy(*cell, "ball").agg(F.count("*").alias("size"))
    sizes = sizes.withColumn("part", F.when((F.col("ball") >= 0) & (F.col("size") > BLOCK), F.col("ball") + 1).otherwise(0).cast("long"))
    parts = cut(sizes.groupBy(*cell, "part").agg(F.ceil(F.sum("size") / BLOCK).alias("blocks"), F.collect_list("ball").alias("balls")))
    # as many parts as balls, at most
    parts_of_cell = parts.groupBy(*cell).agg(F.collect_list(F.struct("part", "blocks")).alias("parts"))
    deal = parts.withColumn("ball", F.explode("balls")).drop("balls").join(parts_of_cell, cell)
    number = lambda part, i: part * F.lit(1 << 32) + i
    others = F.filter("parts", lambda p: (p["part"] == 0) | (p["part"] != F.col("part")))
    others = F.flatten(F.transform(others, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), p["blocks"] - 1), lambda i: number(p["part"], i))))
    own = number(F.col("part"), F.pmod(F.xxhash64("rep"), F.col("blocks")))
    tasks = visits.join(deal, [*cell, "ball"]).withColumn("block", own).withColumn("other", F.explode(others))
    return tasks.select(*cell, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "ball", "rep", "n", "home", "vec")


def near_duplicates(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", embedding_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id and kept (the component's smallest id)."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(embedding_col).alias("vec"), F.col(label_col).alias("label"))
    rows = rows.withColumn("ok", usable("vec") & F.col("label").isNotNull())
    good = rows.where("ok")
    classes = cut(good.groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    keyed = classes.where("rep is not null")
    shape = keyed.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
    sample = keyed.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("vec").toArrow()["vec"]
    sizes = np.asarray(pc.list_value_length(sample)) if len(sample) else np.empty(0, int)
    cells = int(np.clip(shape["n"] / (max(shape["labels"], 1) * CELL_TARGET), CELLS_LEAST, CELLS_MOST))
    learned = {int(s): _matrix(sample.filter(pa.array(sizes == s))) for s in np.unique(sizes)}
    centres = {s: spherical_kmeans(unit, cells) for s, unit in learned.items()}
    balls = {s: dense_balls(unit, threshold) for s, unit in learned.items()}

    label_type = classes.schema["label"].dataType.simpleString()
    vec_type = classes.schema["vec"].dataType.simpleString()
    kinds = f"label {label_type}, dim int, rep bigint, n bigint, vec {vec_type}, ball int, cell int, home boolean"
    visits = cut(keyed.select("label", F.size("vec").alias("dim"), "rep", "n", "vec").mapInArrow(_visits(centres, balls, threshold), kinds))
    compared = _pairs_of_blocks(visits).groupBy("label", "dim", "cell", "low", "high").applyInArrow(_products(threshold), "rep bigint, links bigint, root bigint")
    # all vectors of a ball link with each other
    ball = ["label", "dim", "ball"]
    members = visits.where("home and ball >= 0").select(*ball, "rep", "n")
    whole = members.groupBy(*ball).agg(F.sum("n").alias("total"), F.min("rep").alias("root"))
    in_balls = members.join(whole, ball).select("rep", (F.col("total") - F.col("n")).alias("links"), "root")
    linked = cut(compared.unionByName(in_balls.where("links > 0")))

    components = connected_components(linked, "rep", "root")
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (
        classes.join(counts, "rep", "left")
        .join(components, F.col("rep") == F.col("node"), "left")
        .select(F.col("label").alias("c_label"), F.col("vec").alias("c_vec"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    )
    joined = good.join(of_class, (F.col("label") == F.col("c_label")) & (F.col("vec") == F.col("c_vec"))).select("id", F.col("links").alias("n_links"), F.col("comp").alias("component_id"))
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return joined.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept.alias("kept"))


#: Brute force over all pairs of the registered table, for small tables only.
ORACLE_SQL = """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) e from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
r as (select vec_id a, vec_id b from embeddings union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) n_links, min(r.b) component_id, e.vec_id = min(r.b) kept
from embeddings e join r on r.a = e.vec_id group by e.vec_id
"""
