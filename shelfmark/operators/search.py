"""Lexical search, vector search, fusion and reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.functions.text import index_tokens, query_phrases
from shelfmark.session import cut

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
RERANK_POOL = 30


#: The tokens of one query term: all but the last are whole tokens, the last is a prefix.
Phrase = list[str]


def parse_query(spark: SparkSession, query: str) -> list[Phrase]:
    """The phrases of a query, folded as the index folds texts; a repeated term is another phrase."""
    return [list(p) for p in spark.createDataFrame([(query,)], "t string").select(query_phrases(F.col("t"))).first()[0]]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with ``tokens`` (last column) -> a row of each distinct token: the other columns, token, tf, dl, places."""
    for batch in batches:
        *others, lists = batch.columns
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        key = row * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")  # places of a token stay in order
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        edges, head = np.append(first, len(order)), order[first]
        places = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(place[order], pa.int32()))
        token = words.dictionary.take(words.indices.take(pa.array(head)))
        of_row = pa.array(row[head])
        columns = [*(c.take(of_row) for c in others), token, pa.array(np.diff(edges), pa.int64()), pa.array(sizes[row[head]], pa.int32()), places]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "token", "tf", "dl", "places"])


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``keep`` columns, token, tf, dl, places) of every document's distinct tokens, counted where the row is."""
    tokens = docs.select(id_col, *keep, index_tokens(F.col(text_col)).alias("tokens"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields[:-1])
    return tokens.mapInArrow(_counted, f"{fields}, token string, tf bigint, dl int, places array<int>")


def _matching(tokens: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs in an array of tokens."""
    *whole, prefix = phrase

    def here(x: Column, i: Column) -> Column:
        found = x.startswith(prefix)
        for back, token in enumerate(reversed(whole), 1):
            found = found & (F.get(tokens, i - back) == token)
        return F.coalesce(found, F.lit(False))

    return F.size(F.filter(tokens, here))


def phrase_counts(docs: DataFrame, phrases: list[Phrase], text_col: str, keep: list) -> DataFrame:
    """The columns ``keep``, dl, and f: how often each phrase occurs.  Counted inside the row, so the corpus is not
    shuffled; documents without a hit stay for the statistics."""
    counted = F.transform(F.array(index_tokens(F.col(text_col))), lambda t: F.struct(F.size(t).alias("dl"), F.array(*[_matching(t, p) for p in phrases]).alias("f")))
    return docs.select(*keep, F.explode(counted).alias("s")).select("*", "s.dl", "s.f").drop("s")


def bm25_stats(counts: DataFrame, n_phrases: int) -> DataFrame:
    """One row: n documents, avgdl, and df of each phrase."""
    return counts.agg(
        F.count("*").alias("n"),
        (F.sum("dl").cast("double") / F.count("*")).alias("avgdl"),
        F.array(*[F.count(F.when(F.col("f")[i] > 0, 1)) for i in range(n_phrases)]).alias("df"),
    )


def bm25(docs: DataFrame, phrases: list[Phrase], id_col: str = "doc_id", text_col: str = "text", scope: Column | None = None) -> DataFrame:
    """(id, score) of documents with a phrase of the query, higher is better.  Statistics cover all of
    ``docs``; ``scope`` then filters the hits.  The one-row statistics are broadcast."""
    if not phrases:
        return docs.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    tokens = phrase_counts(docs, phrases, text_col, [F.col(id_col), (F.lit(True) if scope is None else scope).alias("in_scope")])
    tokens = cut(tokens)  # small rows of counts, read for the statistics and again for the hits; texts are read once
    stats = bm25_stats(tokens, len(phrases))
    rows = tokens.where(F.col("in_scope") & F.exists("f", lambda x: x > 0)).crossJoin(F.broadcast(stats))
    return rows.select(id_col, _bm25_score(len(phrases)).alias("score"))


def _bm25_score(n_phrases: int) -> Column:
    """The score of a row with f, dl, and the statistics n, avgdl and df."""
    score = F.lit(0.0)
    for i in range(n_phrases):
        df, f = F.col("df")[i].cast("double"), F.col("f")[i].cast("double")
        idf = F.ln((F.col("n") - df + 0.5) / (df + 0.5))
        part = F.when(idf > 0, idf).otherwise(IDF_FLOOR) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        score = score + part
    return F.round(score, 6)


def _stored_count(phrase: Phrase) -> Column:
    """How often a phrase occurs in a document, over the rows of its postings."""
    *whole, prefix = phrase
    if not whole:
        return F.sum(F.when(F.col("token").startswith(prefix), F.col("tf")).otherwise(0))
    # places where the last token may stand, then those that the tokens before it allow
    places = F.flatten(F.collect_list(F.when(F.col("token").startswith(prefix), F.col("places"))))
    for back, token in enumerate(reversed(whole), 1):
        before = F.flatten(F.collect_list(F.when(F.col("token") == token, F.transform("places", lambda x: x + back))))
        places = F.array_intersect(places, before)
    return F.size(places).cast("bigint")


def bm25_indexed(index: DataFrame, totals: DataFrame, phrases: list[Phrase], id_col: str = "doc_id", scope: Column | None = None) -> DataFrame:
    """The rows of ``bm25`` from stored postings: only tokens of the phrases are read, and the places of tokens
    decide which stand next to each other.  ``totals`` is the one row (n, total) of documents and tokens that the postings
    are of."""
    if not phrases:
        return index.select(id_col, F.lit(0.0).alias("score")).where(F.lit(False))
    some = F.col("token").isin(sorted({t for p in phrases for t in p[:-1]}))
    for prefix in sorted({p[-1] for p in phrases}):
        some = some | F.col("token").startswith(prefix)
    hits = index.where(some).withColumn("in_scope", F.lit(True) if scope is None else scope)
    counts = [_stored_count(p).alias(f"f{i}") for i, p in enumerate(phrases)]
    rows = hits.groupBy(id_col, "dl", "in_scope").agg(*counts).select(id_col, "dl", "in_scope", F.array(*[f"f{i}" for i in range(len(phrases))]).alias("f"))
    rows = cut(rows.where(F.exists("f", lambda x: x > 0)))  # the documents with a hit, read for df and again for the scores
    df = rows.agg(F.array(*[F.count(F.when(F.col("f")[i] > 0, 1)) for i in range(len(phrases))]).alias("df"))
    stats = totals.select("n", F.try_divide(F.col("total").cast("double"), F.col("n")).alias("avgdl")).crossJoin(F.broadcast(df))
    return rows.where("in_scope").crossJoin(F.broadcast(stats)).select(id_col, _bm25_score(len(phrases)).alias("score"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows, with ``rank`` from 1.  The window runs over at most k rows."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def knn(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", distance=l2, descending: bool = False) -> DataFrame:
    """Exact nearest neighbours of a one-row query (column ``q``): filter ``vectors`` first, so the
    scope is applied before ranking."""
    near = vectors.crossJoin(F.broadcast(query)).select(id_col, F.round(distance(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return top_k(near, k, F.desc("distance") if descending else F.asc("distance"), F.asc(id_col))


def knn_by_space(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Neighbours ranked inside each space; distances of different spaces are never compared.  ``query`` is one row
    (q) or one row a space (space, q).  The pre-aggregated top k of each space keeps the window small."""
    # a query with a vector for each space meets only vectors of that space; both are as few rows as there are spaces
    pairs = vectors.join(F.broadcast(query), "space") if "space" in query.columns else vectors.crossJoin(F.broadcast(query))
    near = pairs.select("space", id_col, F.round(l2(F.col("embedding"), F.col("q")), 6).alias("distance"))
    return ranked(near, ["space"], k, id_col)


def ranked(near: DataFrame, by: list[str], k: int, id_col: str) -> DataFrame:
    """The ``k`` smallest distances of each group, ties by id, with ``rank`` from 1."""
    window = Window.partitionBy(*by).orderBy("distance", id_col)
    # rank <= k on a window becomes a per-partition top-k before the shuffle
    return near.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def rrf(lists: DataFrame, id_col: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (list_no, rank, id); ties keep list order, then rank."""
    return lists.groupBy(id_col).agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score"), F.min(F.struct("list_no", "rank")).alias("first_seen")
    )


def fused_order(id_col: str) -> list[Column]:
    return [F.desc("score"), F.asc("first_seen"), F.asc(id_col)]


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text holds (the deterministic stand-in for a cross-encoder)."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    q = words(query)
    return F.size(F.array_intersect(q, words(text))) / F.greatest(F.size(q), F.lit(1))


def rerank_text(context: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(context, F.lit("")), original)


def model_rerank(candidates: DataFrame, query: str, scorer, text_col: str = "text") -> DataFrame:
    """``candidates`` with ``rerank_score`` from ``scorer(query, list of texts) -> list of floats``."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(rerank_score=[float(s) for s in scorer(query, pdf[text_col].tolist())])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    return candidates.mapInPandas(run, f"{fields}, rerank_score double")
