"""Streaming ingest with visible progress, and the token rate over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators import chunking, structure

DOCS = "doc bigint, txt string"


def ingest_stream(spark: SparkSession, landing: str, target: str, checkpoint: str, embedder=None, files_per_batch: int = 1) -> StreamingQuery:
    """Chunk and embed documents (Parquet of doc, txt) as they land.  Each micro-batch is written under its
    own number, so a repeated batch replaces itself; the state row comes last, and rows of earlier batches
    stay readable whatever happens to a later one."""
    embed = embedder or chunking.hash_embedder()

    def write(docs: DataFrame, batch: int) -> None:
        docs = docs.dropDuplicates(["doc"])
        found, _, _ = structure.ladder(docs, structure.shipped_profiles(docs.sparkSession))
        chunks = chunking.chunk_rows(docs, found)
        vectors = chunking.embed(chunks, embed)
        chunks.join(vectors, ["doc", "chunk_index"]).write.mode("overwrite").parquet(f"{target}/chunks/batch={batch}")
        done = docs.sparkSession.read.parquet(f"{target}/chunks/batch={batch}").groupBy("doc").agg(F.count("*").alias("chunks"), F.sum("n_tokens").alias("tokens"))
        done.withColumn("ingest_state", F.lit("ready")).write.mode("overwrite").parquet(f"{target}/state/batch={batch}")

    stream = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_stream(events: DataFrame, seconds: int = 60, slide: int = 10, late: str = "10 minutes") -> DataFrame:
    """Tokens in sliding event-time windows of a stream of (ts, tokens), with late data bounded."""
    windows = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    return events.withWatermark("ts", late).groupBy(windows).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))
