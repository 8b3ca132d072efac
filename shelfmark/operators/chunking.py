"""Chunks: overlapping token pieces of segments, their texts, embedding windows and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators import tokens

PIECE, OVERLAP, WINDOW_CHUNKS, CONTEXT = 512, 100, 50, 4
STEP = PIECE - OVERLAP


def pieces(text: Column, size: int = PIECE, step: int = STEP) -> Column:
    """Array of (piece, n_tokens, text) of ``size`` tokens every ``step``, ending with the first piece that
    reaches the end.  A token is a word with the white space after it, so pieces are cut in the text itself."""
    words = F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0))
    last = lambda t: F.greatest(F.lit(0), F.ceil((F.size(t) - size) / step)).cast("int")
    piece = lambda t, i: F.struct(i.alias("piece"), F.size(F.slice(t, i * step + 1, size)).alias("n_tokens"), F.array_join(F.slice(t, i * step + 1, size), "").alias("text"))
    cut = F.transform(F.array(words), lambda t: F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), last(t)), lambda i: piece(t, i))))
    return F.get(cut, F.lit(0))


def chunk_rows(docs: DataFrame, segments: DataFrame, size: int = PIECE, step: int = STEP, tokenizer: tokens.Tokenizer | None = None) -> DataFrame:
    """(doc, chunk_index, breadcrumb, structural, pos_start, pos_end, n_tokens, text): pieces of each
    segment and of the text before the first; documents without segments are cut as a whole.  Pieces are of a
    tokenizer's tokens, or else of words."""
    first = segments.groupBy("doc").agg(F.min("start_off").alias("first_off"))
    rest = docs.join(first, "doc", "left")
    plain = rest.select("doc", F.lit(0).cast("bigint").alias("start_off"), F.coalesce("first_off", F.length("txt")).cast("bigint").alias("end_off"), F.lit(None).cast("string").alias("breadcrumb"), F.lit(False).alias("structural"))
    parts = segments.select("doc", "start_off", "end_off", "breadcrumb", F.lit(True).alias("structural")).unionByName(plain)
    texts = parts.join(docs, "doc").withColumn("part", F.substr("txt", F.col("start_off") + 1, F.col("end_off") - F.col("start_off")))
    columns = ("doc", "start_off", "end_off", "breadcrumb", "structural")
    if tokenizer:
        rows = tokens.token_pieces(texts.select(*columns, F.col("part").alias("text")), tokenizer, size, step)
        cut = rows.select(*columns, F.struct("piece", "n_tokens", "text").alias("p"))
    else:
        cut = texts.select(*columns, F.explode(pieces(F.col("part"), size, step)).alias("p"))
    order = Window.partitionBy("doc").orderBy("start_off", "structural", "p.piece")
    return cut.select(
        "doc", (F.row_number().over(order) - 1).cast("bigint").alias("chunk_index"), "breadcrumb", "structural", F.col("start_off").alias("pos_start"), F.col("end_off").alias("pos_end"), F.col("p.n_tokens").alias("n_tokens"), F.col("p.text").alias("text")
    )


def embed_text(breadcrumb: Column, structural: Column, text: Column) -> Column:
    return F.when(structural & (F.coalesce(breadcrumb, F.lit("")) != ""), F.concat(breadcrumb, F.lit("\n\n"), text)).otherwise(text)


def initial_status(structural: Column, private: Column) -> Column:
    return F.when(structural, "structural").when(private, "pending").otherwise("enriched")


def embed_windows(chunks: DataFrame, size: int = WINDOW_CHUNKS) -> DataFrame:
    """(doc, win, chunks, tokens, calls): what each embedding call carries."""
    return chunks.groupBy("doc", F.floor(F.col("chunk_index") / size).alias("win")).agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"), F.lit(1).alias("calls"))


def window_guard(windows: DataFrame, limit: int) -> DataFrame:
    return windows.withColumn("allowed", F.col("tokens") <= limit)


class WindowError(ValueError):
    """A window is larger than a model takes."""


def refuse_oversized(windows: DataFrame, limit: int) -> None:
    """Raises before any call if a window of :func:`embed_windows` holds more tokens than the limit."""
    worst = window_guard(windows, limit).where("not allowed").agg(F.count("*").alias("n"), F.max("tokens").alias("tokens")).first()
    if worst["n"]:
        raise WindowError(f"{worst['n']} windows hold more than {limit} tokens (the largest {worst['tokens']})")


def context_windows(chunks: DataFrame, around: int = CONTEXT) -> DataFrame:
    """Each chunk with its neighbours' texts joined by newlines."""
    window = Window.partitionBy("doc").orderBy("chunk_index").rowsBetween(-around, around)
    return chunks.withColumn("context", F.array_join(F.collect_list("text").over(window), "\n"))


def enrich_targets(chunks: DataFrame, space: Column, force: bool = False) -> DataFrame:
    """Chunks in local spaces whose context is still to be written."""
    return chunks.where(space.startswith("local") & (F.lit(force) | F.col("enrichment_status").isin("pending", "failed")))


def embed(chunks: DataFrame, embedder, text_col: str = "text", id_cols: tuple[str, ...] = ("doc", "chunk_index"), size: int = WINDOW_CHUNKS) -> DataFrame:
    """Vectors of chunks; ``embedder(list of texts) -> list of vectors`` sees one window of a document
    at a time, which is the unit of an embedding call."""
    fields = [chunks.schema[c] for c in id_cols]
    doc, index = id_cols

    def run(pdf):
        pdf = pdf.sort_values(index)
        out = pdf[list(id_cols)].copy()
        out["embedding"] = [[float(x) for x in v] for v in embedder(pdf[text_col].tolist())]
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", embedding array<float>"
    keyed = chunks.select(*id_cols, text_col, F.floor(F.col(index) / size).alias("win"))
    return keyed.groupBy(doc, "win").applyInPandas(run, schema)


def hash_embedder(dim: int = 16):
    """A deterministic stand-in for a model: signed counts of hashed words."""
    import zlib

    def embed_all(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dim
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dim] += 1.0 if h & 0x10000 else -1.0
            out.append(v)
        return out

    return embed_all
