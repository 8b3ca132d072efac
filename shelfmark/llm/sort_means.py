"""Exact k-means over quantised vectors by sort-means.

A vector's components become integers ``floor(scale * x)``, so that distances, sums and means are exact and the result
does not depend on the order of rows.  The first centroids are the ``k`` vectors whose salted ids have the smallest hashes.
In each round the other centroids are ordered by their distance from each centroid.  A vector scans them from the centroid
it was assigned to, in that order, and stops strictly beyond twice its distance: a centroid further away than that is
further from the vector, one at exactly twice the distance may tie, and of tied centroids the smallest number wins.
Then every centroid that has vectors becomes the floor of their mean; an empty one stays.

A round reads the table of vectors with their last assignment and writes the next one to the shared folder, so a lost executor
costs its tasks.  Only the k sums and counts reach the driver, pre-aggregated in each task: no row is shuffled by its
cluster, so a cluster of any size is no hot group.

Defined results: vectors that are null, of another length, or hold null or non-finite components are left out; components
beyond +-2**27 after scaling are set to that bound, so that distances fit longs (a sum of distances that does not is null);
rows that share an id are clustered one by one, and tie in the order of the first centroids by their components; rows with a
null id are clustered too, and start a centroid only after all others; with fewer vectors than ``k``, each is a centroid; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import Scratch, frugal

CLUSTERS, ROUNDS, DIM, SCALE, SALT = 40, 5, 64, 256, 2
#: Components have at most this size after scaling.
MOST = 1 << 27
#: Vectors that scan together: each scans as far as the one with the longest reach.
SCAN = 64


def quantised(embedding: str, dim: int = DIM, scale: int = SCALE):
    """The vector in integers, or null where it is left out."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    bounded = F.transform(e, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST)))), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return F.when(F.size(e) != dim, None).when(bad, None).otherwise(bounded)


def _number(rows: np.ndarray) -> np.ndarray:
    """The rows as doubles where products of them are exact, else as longs."""
    small = rows.size == 0 or int(np.abs(rows).max()) < 1 << 22
    return rows.astype(np.float64 if small and rows.shape[1] <= 256 else np.int64)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    x, y = _number(x), _number(y)
    if x.dtype == y.dtype == np.float64:
        return ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]).astype(np.int64)
    x, y = x.astype(np.int64), y.astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in y], axis=1)


def centroid_orders(centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each centroid: all centroids by their distance from it, itself first, and those squared distances."""
    apart = distances(centroids, centroids)
    np.fill_diagonal(apart, -1)
    order = np.argsort(apart, axis=1, kind="stable")
    return order, np.take_along_axis(apart, order, axis=1)


def scan(rows: np.ndarray, last: np.ndarray, centroids: np.ndarray, order: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of each row, scanning from the centroid ``last``."""
    cluster, best = np.empty(len(rows), np.int32), np.empty(len(rows), np.int64)
    for c in np.unique(last):
        mine = np.flatnonzero(last == c)
        now = distances(rows[mine], centroids[c : c + 1])[:, 0]
        by_reach = np.argsort(-now, kind="stable")
        for a in range(0, len(mine), SCAN):
            part = by_reach[a : a + SCAN]
            # squared, twice the distance is four times; the first of the part reaches furthest
            seen = np.sort(order[c, : np.searchsorted(apart[c], 4 * now[part[0]], side="right")])
            found = distances(rows[mine[part]], centroids[seen])
            least = found.argmin(axis=1)  # the smallest number of those that tie
            cluster[mine[part]], best[mine[part]] = seen[least], found[np.arange(len(part)), least]
    return cluster, best


def _assign(centroids: np.ndarray):
    order, apart = centroid_orders(centroids)

    def run(batches):
        frugal()
        for batch in batches:
            rows = batch.column("cells").flatten().to_numpy().reshape(batch.num_rows, -1)
            cluster, distance = scan(rows, batch.column("cluster").to_numpy(), centroids, order, apart)
            yield pa.record_batch([batch.column("id"), batch.column("cells"), pa.array(cluster), pa.array(distance)], names=["id", "cells", "cluster", "distance"])

    return run


def _means(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floors of means, from at most k rows of sums."""
    sums = [F.sum(F.col("cells")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in rows.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, salt: int = SALT, id_col: str = "vec_id", embedding_col: str = "embedding") -> DataFrame:
    """One row per vector: id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of its final centroid."""
    scratch = Scratch(df.sparkSession)
    cells = df.select(F.col(id_col).cast("long").alias("id"), quantised(embedding_col, dim, scale).alias("cells")).where("cells is not null")
    rows = scratch.keep(cells.withColumn("cluster", F.lit(0)))
    first = rows.orderBy(F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)), "cells").limit(k).select("cells").collect()
    schema = "id bigint, cells array<int>, cluster int, distance bigint"
    if not first:
        return rows.select(F.col("id").alias(id_col), "cluster", *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["cells"] for r in first], np.int64)
    for turn in range(rounds + 1):
        before, rows = rows, scratch.keep(rows.select("id", "cells", "cluster").mapInArrow(_assign(centroids), schema))
        scratch.drop(before)
        if turn < rounds:
            centroids = _means(rows, centroids)

    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = lambda d: F.sum(F.col(d).cast("decimal(38,0)"))
    inertia = {r["cluster"]: int(r["d"]) for r in rows.groupBy("cluster").agg(total("distance").alias("d")).collect()}  # at most k rows
    fits = lambda n: n if n < 1 << 63 else None
    of_cluster = [(c, fits(d), fits(sum(inertia.values())), names[c]) for c, d in inertia.items()]
    found = df.sparkSession.createDataFrame(of_cluster, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(found), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Plain k-means over all pairs of vectors and centroids."""
    parts = [
        f"""v as materialized (select row_number() over () r, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) e from embeddings
  where len(embedding) = {DIM} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"c0 as materialized (select row_number() over (order by sha256('{SALT}:' || vec_id), e) - 1 c, e m from v qualify c < {CLUSTERS})",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"d{t} as (select r, c, list_sum(list_transform(list_zip(e, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) d from v cross join c{t})")
        parts.append(f"a{t} as materialized (select r, arg_min(c, d * {CLUSTERS} + c) c, cast(min(d) as bigint) d from d{t} group by r)")
        if t < ROUNDS:
            parts.append(f"u{t} as (select c, i, sum(x) s, count(*) n from (select a.c, unnest(range(1, {DIM + 1})) i, unnest(e) x from a{t} a join v using (r)) group by c, i)")
            parts.append(f"n{t} as (select c, list((s - (((s % n) + n) % n)) // n order by i) m from u{t} group by c)")
            parts.append(f"c{t + 1} as materialized (select c, list_transform(coalesce(n.m, o.m), lambda x: cast(x as bigint)) m from c{t} o left join n{t} n using (c))")
    return f"""with {", ".join(parts)}
select vec_id, cast(c as int) as cluster, d distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(m, ',')) centroid_sha256
from a{ROUNDS} join v using (r) join c{ROUNDS} using (c)"""


ORACLE_SQL = _oracle()
