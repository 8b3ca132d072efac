"""The notebook query: vectors by space and BM25, fused, hydrated, and reranked on demand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators import policy, search
from shelfmark.session import cut

MODES = ("hybrid", "dense", "lexical")


def ranked_lists(docs: DataFrame, vectors: DataFrame, query_vector: DataFrame, phrases: list[search.Phrase], notebook: str, private: bool, top_k: int, mode: str, index: tuple[DataFrame, DataFrame] | None = None, near: DataFrame | None = None) -> DataFrame:
    """(list_no, rank, doc_id): one list for each searched space, then the lexical list, from ``index`` (stored postings and
    their totals) if there is one.  ``near`` are the neighbours (space, vec_id, rank) if they are known already."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    parts = []
    if mode != "lexical":
        if near is None:
            plan = policy.search_plan(vectors.where(F.col("notebook") == notebook), F.lit(private)).where("searched")
            near = search.knn_by_space(plan, query_vector, top_k)
        parts.append(near.select(F.when(F.col("space") == policy.REMOTE, 0).otherwise(1).alias("list_no"), "rank", F.col("vec_id").alias("doc_id")))
    if mode != "dense" and phrases:
        scope = F.col("notebook") == notebook
        scored = search.bm25_indexed(*index, phrases, scope=scope) if index else search.bm25(docs, phrases, scope=scope)
        hits = search.top_k(scored, 2 * top_k, F.desc("score"), F.asc("doc_id"))
        parts.append(hits.select(F.lit(2).alias("list_no"), "rank", "doc_id"))
    if not parts:
        return docs.select(F.lit(0).alias("list_no"), F.lit(0).alias("rank"), "doc_id").where(F.lit(False))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def notebook_query(
    docs: DataFrame, vectors: DataFrame, query_vector: DataFrame, phrases: list[search.Phrase], notebook: str, private: bool = False, top_k: int = 10, mode: str = "hybrid", query: str | None = None,
    more: tuple[str, ...] = (), scorers: dict | None = None, index: tuple[DataFrame, DataFrame] | None = None, near: DataFrame | None = None, stage: Callable[[str, DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(doc_id, score, source, private, space, excerpt, text, ``more`` columns) best first; with ``query`` the pool of
    candidates is reranked (``rerank_score``): by ``scorers['local']`` if the query or any candidate is private, else by
    ``scorers['remote']``; by word overlap without scorers.  The fused list has at most a few hundred rows, so it is
    broadcast to the document scan.  ``stage(name, rows)`` may materialise the rows of each stage, to time it."""
    stage = stage or (lambda name, rows: rows)
    lists = None
    for name, part in (("knn", "dense"), ("fts", "lexical")):
        if mode in ("hybrid", part):
            rows = stage(name, ranked_lists(docs, vectors, query_vector, phrases, notebook, private, top_k, part, index, near))
            lists = rows if lists is None else lists.unionByName(rows)
    if lists is None:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")
    pool = max(search.RERANK_POOL, top_k) if query else top_k
    fused = stage("rrf", search.rrf(lists, "doc_id").orderBy(*search.fused_order("doc_id")).limit(pool))
    fused = cut(fused)  # at most the pool; its ids as a filter reach the scan, so that no other text is read or moved
    wanted = docs.where(F.col("doc_id").isin([r[0] for r in fused.select("doc_id").collect()]))
    rows = wanted.join(F.broadcast(fused), "doc_id").select("doc_id", "score", "source", "private", "space", F.substr("text", F.lit(1), F.lit(60)).alias("excerpt"), "first_seen", "text", *more)
    if not query:
        return stage("hydrate", rows).orderBy(*search.fused_order("doc_id")).drop("first_seen")
    if scorers:
        rows = cut(rows)  # at most the pool
        route = rows.agg(policy.rerank_route(F.coalesce(F.bool_or("private"), F.lit(False)), F.lit(private))).first()[0]
        context = search.rerank_text(F.col("contextualized"), F.col("text")) if "contextualized" in more else F.col("text")
        scored = search.model_rerank(rows.withColumn("asked", context), query, scorers[route], "asked").withColumn("rerank_score", F.round("rerank_score", 6)).drop("asked")
    else:
        scored = rows.withColumn("rerank_score", F.round(search.overlap_score(F.lit(query), F.col("text")), 6))
    return stage("rerank", scored).orderBy(F.desc("rerank_score"), *search.fused_order("doc_id")).limit(top_k).drop("first_seen")
