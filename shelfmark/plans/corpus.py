"""How the driver's tables stand for a catalog: notebooks are languages, sources are documents."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import cells, policy, search
from shelfmark.operators.store import Files, PostingsRuns
from shelfmark.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, notebook, source, private, space, text): private if toxic or an id divisible by 3."""
    toxic = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    private = (F.coalesce("toxic", F.lit(0)) == 1) | (F.col("doc_id") % 3 == 0)
    rows = table(spark, sf_dir, "documents").join(toxic, "doc_id", "left").withColumn("private", private)
    return rows.select("doc_id", F.col("lang").alias("notebook"), "source", "private", policy.space_of(F.col("private")).alias("space"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, notebook, space, embedding) of the sources that have a vector."""
    return table(spark, sf_dir, "embeddings").join(sources(spark, sf_dir).drop("text"), F.col("vec_id") == F.col("doc_id")).select("vec_id", "notebook", "space", "embedding")


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, txt): ten conversations a document, with heading lines for conversations and turns."""
    head = F.when(F.col("turn") == 0, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string"), F.lit("\n"))).otherwise("")
    body = F.concat(head, F.initcap("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select((F.floor(F.col("conv_id") / 10)).alias("doc"), "conv_id", "turn", body.alias("body"))
    return rows.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("conv_id", "turn", "body")))["body"], "\n").alias("txt"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost ledger of events: the model is the event type, tokens are the value."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("source_id"), F.col("event_type").alias("model"), F.col("value").alias("tokens"))


def _state(df: DataFrame) -> tuple:
    """The session and the files that a table has now."""
    files = df.sparkSession.read.format("binaryFile").load(df.inputFiles()).select("path", "length", "modificationTime").orderBy("path").collect()
    return (df.sparkSession.sparkContext.applicationId, *map(tuple, files))


_indexes: dict[tuple, tuple[PostingsRuns, int]] = {}


def lexical_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored postings of the documents (doc_id, token, tf, dl, places, notebook) and their totals.  They are built once for the
    files of a table, in the shared folder, and used by all queries of a session."""
    docs = table(spark, sf_dir, "documents")
    key = _state(docs)
    if key not in _indexes:
        runs = PostingsRuns(Files(spark, f"{shared_dir(spark)}/index-{uuid4().hex}"), "postings", "doc_id bigint, notebook string")
        rows = docs.select("doc_id", F.col("lang").alias("notebook"), "text")
        # a table that is there as a whole is one batch, so no run is merged
        _indexes[key] = (runs, runs.add(search.postings(rows, keep=("notebook",))))
    runs, total = _indexes[key]
    return runs.rows(), docs.agg(F.count("*").alias("n"), F.lit(total).cast("bigint").alias("total"))


_cells: dict[tuple, str] = {}


def vector_cells(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the vectors of :func:`vectors` in cells, built once for the files of the table."""
    key = _state(table(spark, sf_dir, "embeddings"))
    if key not in _cells:
        folder = f"{shared_dir(spark)}/cells-{uuid4().hex}"
        cells.build(vectors(spark, sf_dir), folder, per_cell=32)
        _cells[key] = folder
    return _cells[key]
