"""Exact nearest neighbours that read a part of the vectors: stored cells with radii, closed by the triangle inequality.

Each group of vectors (a space, or a notebook and a space) is cut into cells around centres fitted on a bounded sample of
the group.  A cell is a partition of the stored table and knows its centre, its radius and its size.  No vector of a cell is
nearer to a query than the distance of its centre less its radius.  A search reads the cells with the smallest such
bounds first, twice as many in each round, until the k-th best distance closes the rest; cells that tie with it are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import search

#: Vectors that centres are fitted on for each group (in the order of a hash of their ids), at most; the rest is only assigned.
SAMPLE = 4096
PER_CELL, MOST_CELLS, ROUNDS = 512, 1024, 10
#: Distances are compared after rounding to six places.
ROUNDING = 2e-6


def centres_of(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` distinct centres."""
    centres = np.unique(rows, axis=0)
    if len(centres) > k:
        centres = centres[np.random.default_rng(0).choice(len(centres), k, replace=False)]
        for _ in range(rounds):
            nearest = ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(axis=1)
            sums, n = np.zeros_like(centres), np.bincount(nearest, minlength=len(centres))
            np.add.at(sums, nearest, rows)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def build(vectors: DataFrame, folder: str, by: tuple[str, ...] = ("space",), id_col: str = "vec_id", per_cell: int = PER_CELL) -> None:
    """Stores ``vectors`` (with the columns ``by``, an id and ``embedding``, all of a group of one length) in cells.  Rows
    without a vector are left out."""
    spark = vectors.sparkSession
    vectors = vectors.where(F.size("embedding") > 0)
    fitted: dict[tuple, np.ndarray] = {}
    for group in vectors.groupBy(*by).agg(F.count("*").alias("n")).collect():  # as many rows as there are groups
        mine = vectors
        for column in by:
            mine = mine.where(F.col(column) == group[column])
        sample = mine.orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE).select("embedding").toPandas()["embedding"]
        rows = np.array([list(map(float, v)) for v in sample])
        fitted[tuple(group[c] for c in by)] = centres_of(rows, int(np.clip(group["n"] // per_cell, 1, MOST_CELLS)))

    def assign(batches):
        for pdf in batches:
            pdf["cell"], pdf["reach"] = 0, 0.0
            for group, part in pdf.groupby(list(by)):
                centres = fitted[group if isinstance(group, tuple) else (group,)]
                rows = np.array([np.asarray(v, np.float64) for v in part["embedding"]])
                nearest = ((centres**2).sum(1)[None] - 2 * rows @ centres.T).argmin(axis=1)
                pdf.loc[part.index, "cell"] = nearest
                pdf.loc[part.index, "reach"] = np.linalg.norm(rows - centres[nearest], axis=1)
            yield pdf

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    placed = vectors.mapInPandas(assign, f"{fields}, cell int, reach double")
    # a cell's rows come together, so that its folder has few files
    placed.repartition(*by, "cell").write.mode("overwrite").partitionBy(*by, "cell").parquet(f"{folder}/vectors")
    schema = spark.createDataFrame([], ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in by) + ", cell int, centre array<double>").schema
    centres = [(*group, i, c.tolist()) for group, found in fitted.items() for i, c in enumerate(found)]
    sizes = read(spark, folder, placed.schema).groupBy(*by, "cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius"))
    sizes.join(spark.createDataFrame(centres, schema), [*by, "cell"]).coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")


def read(spark: SparkSession, folder: str, schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/vectors")


class Search:
    """The nearest ``k`` vectors of each group for a query vector a group, with ``cells_read`` of ``cells_all`` cells afterwards.
    ``live`` leaves rows out before they are ranked."""

    def __init__(self, spark: SparkSession, folder: str, by: tuple[str, ...] = ("space",), id_col: str = "vec_id", live=None) -> None:
        self.spark, self.folder, self.by, self.id_col, self.live = spark, folder, by, id_col, live
        self.cells_read = self.cells_all = 0

    def nearest(self, query: DataFrame, k: int) -> DataFrame:
        """(``by`` columns, id, distance, rank); ``query`` has one row a group (``by`` columns, q), or q alone for all groups."""
        by, id_col = list(self.by), self.id_col
        cells = self.spark.read.parquet(f"{self.folder}/cells")
        asked = cells.crossJoin(F.broadcast(query)) if query.columns == ["q"] else cells.join(F.broadcast(query), by)
        # at most MOST_CELLS rows a group
        order = asked.select(*by, "cell", "radius", search.l2(F.col("centre"), F.col("q")).alias("apart")).toPandas()
        order["bound"] = (order["apart"] * (1 - 1e-9) - order["radius"]).clip(lower=0) - ROUNDING
        order = order.sort_values(["bound", "apart", "cell"])
        self.cells_all = len(order)
        left = {g if isinstance(g, tuple) else (g,): part[["cell", "bound"]].values.tolist() for g, part in order.groupby(by)}
        best: dict[tuple, list[tuple[float, object]]] = {g: [] for g in left}
        types = read(self.spark, self.folder).schema
        take = 1
        while any(left.values()):
            some, now = F.lit(False), 0
            for group, cells_left in left.items():
                of_group = F.lit(True)
                for column, value in zip(by, group, strict=True):
                    of_group = of_group & (F.col(column) == F.lit(value))
                if cells_left:
                    some = some | (of_group & F.col("cell").isin([int(c) for c, _ in cells_left[:take]]))
                    now += len(cells_left[:take])
                    left[group] = cells_left[take:]
            self.cells_read += now
            rows = read(self.spark, self.folder).where(some)
            rows = self.live(rows) if self.live else rows
            pairs = rows.crossJoin(F.broadcast(query)) if query.columns == ["q"] else rows.join(F.broadcast(query), by)
            near = pairs.select(*by, id_col, F.round(search.l2(F.col("embedding"), F.col("q")), 6).alias("distance"))
            for row in search.ranked(near, by, k, id_col).collect():  # k rows a group
                best[tuple(row[c] for c in by)].append((row["distance"], row[id_col]))
            for group, found in best.items():
                found.sort()
                del found[k:]
                if len(found) == k:
                    left[group] = [c for c in left[group] if c[1] <= found[-1][0]]
            take *= 2
        rows = [(*group, i, d, r) for group, found in best.items() for r, (d, i) in enumerate(found, 1)]
        fields = [f"`{c}` {types[c].dataType.simpleString()}" for c in (*by, id_col)]
        return self.spark.createDataFrame(pd.DataFrame(rows, columns=[*by, id_col, "distance", "rank"]) if rows else [], ", ".join([*fields, "distance double", "rank int"]))
