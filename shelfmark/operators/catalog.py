"""Catalog rollups: lifecycle states, enrichment counts, costs, rates, and row-level changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: US dollars per million input and output tokens.
PRICES = [
    ("voyage-context-3", 0.18, 0.0),
    ("voyage-4-lite", 0.02, 0.0),
    ("voyage-3.5", 0.06, 0.0),
    ("voyage-law-2", 0.12, 0.0),
    ("deepseek-v4-flash", 0.27, 1.10),
    ("deepseek-chat", 0.27, 1.10),
]
ERROR_LIMIT = 500


def price_in(model: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for m, i, _ in PRICES for x in (m, i)])[model]
    return F.coalesce(exact, F.when(model.startswith("bge") | model.contains("gguf"), 0.0).when(model.startswith("voyage"), 0.10).when(model.startswith("deepseek"), 0.27).otherwise(0.0))


def price_out(model: Column) -> Column:
    exact = F.create_map(*[F.lit(x) for m, _, o in PRICES for x in (m, o)])[model]
    local = model.startswith("bge") | model.contains("gguf")
    return F.coalesce(exact, F.when(~local & model.startswith("deepseek"), 1.10).otherwise(0.0))


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    return tokens_in / 1e6 * price_in(model) + tokens_out / 1e6 * price_out(model)


def cost_by_model(ledger: DataFrame) -> DataFrame:
    """Sums of (model, api_calls, input_tokens, output_tokens, cache_hit_tokens, cost_usd) rows."""
    return ledger.groupBy("model").agg(
        F.sum("api_calls").alias("api_calls"),
        F.round(F.sum("input_tokens"), 4).alias("input_tokens"),
        F.round(F.sum("output_tokens"), 4).alias("output_tokens"),
        F.round(F.sum("cache_hit_tokens"), 4).alias("cache_hit_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


#: The trailing window is computed for stretches of so many windows at a time.
STRETCH = 10


def token_rate(ledger: DataFrame, seconds: int = 60, *keys: str) -> DataFrame:
    """``ledger`` (ts, tokens) with the tokens of the trailing window, both ends included, for each of the keys.

    Time is cut into stretches, each a task of its own; a stretch also sees the rows of the one before that its first
    windows reach back to.  Rows without a time are a stretch of their own."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    window_size, stretch_size = seconds * 1_000_000, STRETCH * max(seconds, 1) * 1_000_000
    stretch = F.floor(F.col("__at") / stretch_size)
    halo = F.col("__at") >= (stretch + 1) * stretch_size - window_size
    places = F.when(halo, F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("stretch"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(stretch.alias("stretch"), F.lit(True).alias("own"))))
    rows = ledger.withColumn("__at", micros).withColumn("__place", F.explode(places))
    window = Window.partitionBy(*keys, "__place.stretch").orderBy("__at").rangeBetween(-window_size, 0)
    summed = rows.withColumn("tokens_in_window", F.round(F.sum("tokens").over(window), 3))
    return summed.where("__place.own").drop("__at", "__place")


def is_rate_limit(message: Column) -> Column:
    return F.lower(message).rlike("ratelimit|429|rate limit|too many requests")


def rollup(sources: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """One row for each ``key``: chunk counts by enrichment status and the derived progress."""
    by_status = chunks.groupBy(key).agg(
        *[F.count(F.when(F.col("enrichment_status") == s, 1)).alias(f"chunks_{s}") for s in ("structural", "pending", "enriched", "failed")],
        F.count("*").alias("chunks_embedded"),
    )
    planned = sources.groupBy(key).agg(F.coalesce(F.sum("chunks_planned"), F.lit(0)).alias("chunks_planned"))
    rows = planned.join(by_status, key, "left").na.fill(0)
    return rows.withColumn("chunks_total", F.greatest("chunks_planned", "chunks_embedded")).withColumn("queryable", F.col("chunks_embedded") > 0)


def summary(state: Column, error: Column) -> Column:
    """The status sentence of a rollup row; ``state`` is null for a whole notebook."""
    n = lambda c: F.col(c).cast("string")
    failed = F.when(F.col("chunks_failed") > 0, F.concat(F.lit(", "), n("chunks_failed"), F.lit(" failed"))).otherwise("")
    broken = F.concat(F.lit("ingest FAILED after "), n("chunks_embedded"), F.lit(" chunks"), F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit(": "), error)).otherwise(""), F.when(F.col("queryable"), ", partial results queryable").otherwise(""))
    running = F.concat(F.lit("ingesting: embedded "), n("chunks_embedded"), F.when(F.col("chunks_planned") > 0, F.concat(F.lit("/"), n("chunks_planned"))).otherwise(""), F.when(F.col("queryable"), ", queryable now").otherwise(", not yet queryable"))
    enrichable = F.col("chunks_pending") + F.col("chunks_enriched") + F.col("chunks_failed")
    tail = (
        F.when(enrichable == 0, F.lit("all chunks contextual (structural/public)"))
        .when(F.col("chunks_pending") > 0, F.concat(F.lit("enrichment pending: "), n("chunks_enriched"), F.lit(" enriched, "), n("chunks_pending"), F.lit(" pending"), failed))
        .otherwise(F.concat(F.lit("enrichment complete: "), n("chunks_enriched"), F.lit(" enriched"), failed))
    )
    ready = F.concat(F.lit("embedded "), n("chunks_embedded"), F.lit(", queryable now, "), tail)
    return F.when(state == "failed", broken).when(state.isin("pending", "ingesting"), running).when(F.col("chunks_embedded") == 0, "no chunks yet").otherwise(ready)


def latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Upsert: ``new`` rows replace ``old`` rows of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def refresh_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change) of sources whose content hash is new, gone or changed."""
    rows = old.select(key, F.col("content_hash").alias("old_hash")).join(new.select(key, F.col("content_hash").alias("new_hash")), key, "full")
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed").otherwise("unchanged")
    return rows.select(key, change.alias("change"))


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Cascade: rows of deleted keys go."""
    return rows.join(gone.select(key), key, "left_anti")
