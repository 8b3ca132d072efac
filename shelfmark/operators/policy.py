"""Privacy routing: which space a source belongs to, which spaces a query may search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REMOTE, LOCAL = "remote-a", "local-b"
REMOTE_PREFIX, LOCAL_PREFIX = "remote", "local"
WINDOW_TOKENS = 30_000


class PrivacyError(ValueError):
    """Private data would leave for a remote model."""


def effective_private(flag: Column, default: bool = True) -> Column:
    return F.coalesce(flag, F.lit(default))


def space_of(private: Column) -> Column:
    return F.when(private, LOCAL).otherwise(REMOTE)


def is_remote(space: Column, remote: str = REMOTE) -> Column:
    return (space == remote) | space.startswith(REMOTE_PREFIX)


def search_plan(spaces: DataFrame, query_private: Column) -> DataFrame:
    """``spaces`` with ``searched``: a private query leaves remote spaces out."""
    return spaces.withColumn("searched", ~(is_remote(F.col("space")) & query_private))


def guard_remote(private: bool, space: str) -> None:
    if private and (space == REMOTE or space.startswith(REMOTE_PREFIX)):
        raise PrivacyError(f"private content may not be sent to {space}")


def rerank_route(any_private: Column, query_private: Column) -> Column:
    return F.when(any_private | query_private, "local").otherwise("remote")


def privacy_audit(rows: DataFrame) -> DataFrame:
    """Rows whose private content sits in a remote space."""
    return rows.where(F.col("private") & is_remote(F.col("space")))


def vector_table(space: Column) -> Column:
    return F.concat(F.lit("vec_"), F.regexp_replace(space, "[^a-zA-Z0-9]", "_"))


def dim_guard(vectors: DataFrame) -> DataFrame:
    """Dimensions of each space; ``ok`` if there is only one."""
    dims = vectors.groupBy("space").agg(F.min(F.size("embedding")).alias("least_dim"), F.max(F.size("embedding")).alias("dim"), F.count("*").alias("n_vectors"))
    return dims.withColumn("ok", F.col("least_dim") == F.col("dim"))


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
