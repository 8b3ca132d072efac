"""The notebook API: a Parquet-backed catalog with ingest, status, refresh, deletion, enrichment and search.

Small tables (notebooks, sources, config, ledger) are logs of changes.  A source is embedded in groups of windows; each group
is a part under ``chunks/notebook_id=/source_id=/v=/part=``, with its postings, and counts once its row is in the log of
commits.  So the chunks of a new source can be searched while the rest is embedded, and a failure keeps what
was committed.  The source row names the version that counts: a refresh writes a new one and swaps at the end.
Postings are kept in runs sorted by token that are merged as they grow in number; lexical search reads only these.
"""

from __future__ import annotations

import inspect
import re
import threading
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import catalog, cells, chunking, dispatch, policy, search, structure
from shelfmark.operators.store import Files, Log, PostingsRuns
from shelfmark.plans import hybrid
from shelfmark.session import cut
from shelfmark.sources import readers

#: The columns of each table; the first one is its key, but for the ledger and the commits, which only grow.
SCHEMAS = {
    "notebooks": "id bigint, name string, created_at timestamp",
    "sources": "id bigint, notebook_id bigint, url string, display_name string, content_hash string, private boolean, space string, ingest_state string, ingest_error string, chunks_planned bigint, ingested_at timestamp, v bigint",
    "config": "key string, value string",
    "ledger": "source_id bigint, model string, api_calls bigint, input_tokens double, output_tokens double, cache_hit_tokens double, cost_usd double, recorded_at timestamp",
    "commits": "source_id bigint, v bigint, part bigint, space string, chunks bigint, index_tokens bigint, least_dim int, dim int, committed_at timestamp",
    "cells": "notebook_id bigint, folder string, made_at timestamp",
}
GROWING = ("ledger", "commits")
CHUNKS = "doc_id bigint, chunk_index bigint, breadcrumb string, structural boolean, pos_start bigint, pos_end bigint, n_tokens int, text string, contextualized string, enrichment_status string, embedding array<float>, notebook_id bigint, source_id bigint, v bigint, part bigint"
#: What postings know of their chunk.
POSTING_KEYS = "notebook_id bigint, source_id bigint, v bigint, part bigint, chunk_index bigint"
LIVE = ["source_id", "v", "part"]


#: What reading a source and calling its models may raise; any other error is a fault of the program.
READ_ERRORS = (ValueError, OSError, PySparkException)


class EngineError(ValueError):
    pass


def _message(error: BaseException) -> str:
    """What went wrong, without the trace of a worker around it."""
    text = str(error)
    if "Traceback (most recent call last)" not in text:
        return text
    lines = [x for x in text.split("\n\tat ")[0].split("\n") if x.strip()]
    return next((x for x in reversed(lines) if re.match(r"[A-Za-z_][\w.]*(Error|Exception)\b", x)), text)


class Engine:
    """``embedder`` serves private sources and searches of their space; public ones go to ``remote_embedder`` (the same
    one if there is none); an embedder with a method ``embed_query`` embeds questions by it.  ``scorers`` are the rerankers ``local`` and ``remote``.  ``fetcher(url)`` returns the html of
    a web page and ``pdf_pages(bytes)`` the texts of a PDF's pages; without them such sources need their ``text``.  Chunks are
    cut by the tokens of ``tokenizer`` (``tokens.byte_pairs``), by words without one.  ``profile_folders`` hold profile
    files, the later folder first."""

    def __init__(self, spark: SparkSession, root: str, embedder: Callable | None = None, contextualizer: Callable | None = None, default_private: bool = True, remote_model: str = "voyage-context-3", remote_embedder: Callable | None = None, scorers: dict | None = None, source_root: str | None = None, size_cap: int = readers.DEFAULT_CAP, fetcher: Callable | None = None, pdf_pages: Callable | None = None, window_tokens: int = policy.WINDOW_TOKENS, concurrency: int | None = None, tokenizer: Callable | None = None, profile_folders: tuple[str, ...] = ()) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        local = embedder or chunking.hash_embedder()
        remote = remote_embedder or local
        self.embedders = {policy.LOCAL: dispatch.retried(local), policy.REMOTE: dispatch.retried(remote)}
        # a model may embed questions in another way than documents
        self.query_embedders = {space: dispatch.retried(getattr(model, "embed_query", model)) for space, model in ((policy.LOCAL, local), (policy.REMOTE, remote))}
        self.contextualizer, self.default_private, self.remote_model = contextualizer and dispatch.retried(contextualizer), default_private, remote_model
        self.scorers, self.source_root, self.size_cap, self.fetcher, self.pdf_pages = scorers, source_root, size_cap, fetcher, pdf_pages
        self.window_tokens, self.concurrency, self.tokenizer, self.profile_folders = window_tokens, concurrency, tokenizer, profile_folders
        self._writes = threading.RLock()
        self.files = Files(spark, self.root)
        self.logs = {name: Log(self.files, name, schema, None if name in GROWING else schema.split()[0]) for name, schema in SCHEMAS.items()}
        self.index = PostingsRuns(self.files, "postings", POSTING_KEYS)

    # --- storage ---

    def table(self, name: str) -> DataFrame:
        rows = self.logs[name].rows()
        if name == "ledger":  # costs go with their source
            return rows.join(self.table("sources").select(F.col("id").alias("source_id")), "source_id", "left_semi")
        return rows

    def _append(self, name: str, row: tuple) -> None:
        self.logs[name].append([row])

    def _update(self, source: int, **values) -> None:
        with self._writes:
            row = self._one("sources", id=source)
            if row:  # it may have been deleted meanwhile
                self._append("sources", tuple((row.asDict() | values).values()))

    def _drop(self, name: str, rows: DataFrame) -> None:
        self.logs[name].append(rows, gone=True)

    def profiles(self) -> DataFrame:
        """Cached profiles: those that came with the package, those of the user's files, and those kept of accepted
        documents; of one variant, the later kind counts."""
        kinds = [structure.shipped_profiles(self.spark)]
        if self.profile_folders:
            kinds.append(structure.profile_files(self.spark, *self.profile_folders))
        if self.files.exists("profiles"):
            kinds.append(self.spark.read.schema(structure.PROFILE).json(f"{self.root}/profiles"))
        rows = None
        for kind, found in enumerate(kinds):
            found = found.withColumn("kind", F.lit(kind))
            rows = found if rows is None else rows.unionByName(found)
        return rows.groupBy("fingerprint", "variant").agg(F.max_by("levels", F.struct("kind", F.to_json("levels"))).alias("levels"))

    def _keep_profile(self, docs: DataFrame, levels: DataFrame) -> None:
        """Appends the mined or refined profile of an accepted document as one JSON line."""
        keys = structure.fingerprints(docs, structure.signatures(docs)).where("fingerprint != 'none'")
        structure.variants(keys, levels).select("fingerprint", "variant", "levels").coalesce(1).write.mode("append").json(f"{self.root}/profiles")

    def commits(self) -> DataFrame:
        """The commits of the current version of every source."""
        now = self.table("sources").select(F.col("id").alias("source_id"), "v")
        return self.table("commits").join(now, ["source_id", "v"], "left_semi")

    def chunks(self) -> DataFrame:
        """The committed chunk rows of the current version of every source."""
        if not self.files.exists("chunks"):
            return self.spark.createDataFrame([], CHUNKS)
        rows = self.spark.read.schema(CHUNKS).parquet(f"{self.root}/chunks")
        now = self.table("sources").select(F.col("id").alias("source_id"), "private", "space", F.col("url").alias("source"))
        return rows.join(self.commits().select(*LIVE), LIVE, "left_semi").join(now, "source_id")

    def progress_stream(self) -> DataFrame:
        """A stream of (source_id, chunks, committed_at) that grows as windows are committed, with the sources' names."""
        log = self.logs["commits"]
        commits = self.spark.readStream.schema(f"{log.schema}, at_ns bigint, gone boolean").option("recursiveFileLookup", "true").parquet(f"{self.root}/commits")
        names = self.table("sources").select(F.col("id").alias("source_id"), "display_name", "chunks_planned")
        return commits.select("source_id", "v", "part", "chunks", "committed_at").join(names, "source_id")

    def postings(self) -> tuple[DataFrame, DataFrame]:
        """(doc_id, token, tf, dl, places, notebook) of all committed chunks, and the row of totals (n, total)."""
        live = self.commits()
        totals = live.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"), F.coalesce(F.sum("index_tokens"), F.lit(0)).alias("total"))
        rows = self.index.rows().join(live.select(*LIVE), LIVE, "left_semi")
        chunk = F.xxhash64("source_id", "chunk_index").alias("doc_id")
        return rows.select(chunk, "token", "tf", "dl", "places", F.col("notebook_id").cast("string").alias("notebook")), totals

    def _one(self, name: str, /, **keys) -> Row | None:
        rows = self.table(name)
        for k, v in keys.items():
            rows = rows.where(F.col(k) == v)
        return rows.first()

    def _next_id(self, name: str) -> int:
        """Numbers are not given twice, even if the highest one was deleted."""
        return (self.logs[name].changes().agg(F.max("id")).first()[0] or 0) + 1

    # --- notebooks ---

    def notebook_create(self, name: str) -> dict:
        with self._writes:
            if self._one("notebooks", name=name):
                raise EngineError(f"notebook {name!r} exists")
            row = (self._next_id("notebooks"), name, datetime.now(timezone.utc))
            self._append("notebooks", row)
        return {"id": row[0], "name": name, "created_at": row[2]}

    def notebook_list(self) -> DataFrame:
        counts = self.table("sources").select(F.col("notebook_id").alias("id"), F.lit(1).alias("s"))
        return self.table("notebooks").join(counts, "id", "left").groupBy("id", "name", "created_at").agg(F.count("s").alias("source_count")).orderBy("created_at", "id")

    def notebook_delete(self, notebook: int) -> None:
        if not self._one("notebooks", id=notebook):
            raise EngineError(f"no notebook {notebook}")
        with self._writes:
            self._drop("notebooks", self.table("notebooks").where(F.col("id") == notebook))
            self._drop("sources", self.table("sources").where(F.col("notebook_id") == notebook))
        # postings of what is gone go with the next merge
        self.files.delete(f"chunks/notebook_id={notebook}")
        self.files.delete(f"cells/notebook_id={notebook}")

    # --- sources ---

    def source_add(self, notebook: int, url: str, text: str | None = None, display_name: str | None = None, private: bool | None = None, enrich: bool = False, wait: bool = True) -> dict:
        """Register a source and ingest it; ``text`` stands for the fetched content.  Without ``wait`` the ingest goes on
        in the background, and ``source_status`` shows how far it is."""
        hidden = self.default_private if private is None else private
        space = policy.LOCAL if hidden else policy.REMOTE
        with self._writes:  # of two threads that add the same, one is refused
            if not self._one("notebooks", id=notebook):
                raise EngineError(f"no notebook {notebook}")
            if self._one("sources", notebook_id=notebook, url=url):
                raise EngineError(f"source {url!r} exists")
            source = self._next_id("sources")
            self._append("sources", (source, notebook, url, display_name or url, None, hidden, space, "pending", None, 0, None, 0))

        def work() -> None:
            self.ingest(source, text)
            if enrich and hidden:
                self.source_enrich(source)

        if wait:
            work()
        else:
            threading.Thread(target=work, daemon=True).start()
        return {"source_id": source, "notebook_id": notebook, "url": url, "private": hidden, "ingest_state": self._one("sources", id=source)["ingest_state"]}

    def _fetch(self, source: int, url: str, text: str | None) -> DataFrame:
        """(doc, txt) of a source, under the policy for its kind."""
        kind, problem = self.spark.createDataFrame([(url,)], "u string").select(readers.source_kind(F.col("u")), readers.url_problem(F.col("u"))).first()
        if kind == "web" and problem:
            raise EngineError(f"{url} may not be fetched: {problem}")
        if text is None and kind == "web":
            if self.fetcher is None:
                raise EngineError("no fetcher is configured")
            readers.check_url(url)
            # a fetcher that follows redirects takes the check for them
            takes = len(inspect.signature(self.fetcher).parameters)
            page = self.spark.createDataFrame([(source, self.fetcher(url, readers.check_url) if takes > 1 else self.fetcher(url))], "doc bigint, html string")
            return self._capped(page.select("doc", readers.page_text(F.col("html")).alias("txt"), "html"), "html").select("doc", "txt")
        if text is not None:
            return self._capped(self.spark.createDataFrame([(source, text)], "doc bigint, txt string"), "txt")
        if kind == "pdf" and self.pdf_pages is None:
            raise EngineError("no PDF reader is configured")
        if kind == "unsupported":
            raise EngineError(f"{url} is no kind of source that can be read")
        rows = readers.read_pdfs(self.spark, url, self.pdf_pages, self.source_root, self.size_cap) if kind == "pdf" else readers.read_texts(self.spark, url, self.source_root, self.size_cap)
        body = F.array_join(F.array_sort(F.collect_list(F.struct("path", "text")))["text"], "\n")
        return rows.agg(F.count("*").alias("n"), body.alias("txt")).where("n > 0").select(F.lit(source).cast("bigint").alias("doc"), "txt")

    def _capped(self, rows: DataFrame, column: str) -> DataFrame:
        if rows.where(readers.over_cap(F.col(column), self.size_cap)).count():
            raise EngineError(f"the text exceeds the cap of {self.size_cap} bytes")
        return rows

    def _guard_dimension(self, space: str, least: int, most: int) -> None:
        known = self.commits().where(F.col("space") == space).agg(F.min("least_dim"), F.max("dim")).first()
        dims = {d for d in (least, most, *known) if d is not None}
        if len(dims) > 1:
            raise EngineError(f"space {space} has vectors of {min(dims)} and {max(dims)} dimensions")

    def _commit(self, row: Row, version: int, part: int, chunks: DataFrame) -> Row:
        """Writes a part of a version and its postings; it counts with its row in the log of commits."""
        folder = f"chunks/notebook_id={row['notebook_id']}/source_id={row['id']}/v={version}/part={part}"
        chunks.write.mode("overwrite").parquet(f"{self.root}/{folder}")
        written = self.spark.read.parquet(f"{self.root}/{folder}")
        size = F.size("embedding")
        found = written.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.min(size).alias("least"), F.max(size).alias("most")).first()
        try:
            self._guard_dimension(row["space"], found["least"], found["most"])
        except EngineError:
            self.files.delete(folder)
            raise
        of_part = [F.lit(x).cast("bigint").alias(c) for c, x in (("notebook_id", row["notebook_id"]), ("source_id", row["id"]), ("v", version), ("part", part))]
        keyed = written.select("chunk_index", "text", *of_part)
        tokens = self.index.add(search.postings(keyed, "chunk_index", keep=("notebook_id", "source_id", "v", "part")), self.commits().select(*LIVE).unionByName(keyed.select(*LIVE).distinct()))
        self._append("commits", (row["id"], version, part, row["space"], found["n"], tokens, found["least"], found["most"], datetime.now(timezone.utc)))
        return found

    def ingest(self, source: int, text: str | None = None) -> None:
        """Fetch, induce, chunk, and embed a source by groups of windows: one window, then two, then four, so that it can be
        searched soon and takes few jobs.  A first ingest that fails keeps the groups it has committed; a refresh that
        fails keeps the version before."""
        row = self._one("sources", id=source)
        self._update(source, ingest_state="ingesting", ingest_error=None)
        try:
            self._ingest(row, text)
        except BaseException as error:
            self._update(source, ingest_state="failed", ingest_error=_message(error)[: catalog.ERROR_LIMIT])
            if not isinstance(error, READ_ERRORS):
                raise  # a fault of the program

    def _ingest(self, row: Row, text: str | None) -> None:
        policy.guard_remote(row["private"], row["space"])
        source = row["id"]
        docs = cut(self._fetch(source, row["url"], text))
        digest = docs.select(readers.content_hash(F.col("txt"))).first()
        if digest is None:
            raise EngineError(f"nothing to read at {row['url']}")
        found, _, levels = structure.ladder(docs, self.profiles())
        for profile in levels:
            if not profile.isEmpty():
                self._keep_profile(docs, profile)
        chunks = cut(chunking.chunk_rows(docs, found, tokenizer=self.tokenizer).withColumn("embed", chunking.embed_text(F.col("breadcrumb"), F.col("structural"), F.col("text"))))
        windows = cut(chunking.embed_windows(chunks))
        chunking.refuse_oversized(windows, self.window_tokens)
        planned = windows.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n"), F.count("*").alias("windows")).first()
        used = self.table("commits").where(F.col("source_id") == source).agg(F.max("v")).first()[0]
        version = max(row["v"], used or 0) + 1
        # a source without an earlier version is visible from its first commit on
        self._update(source, chunks_planned=planned["n"], **({"v": version} if row["content_hash"] is None else {}))
        status = chunking.initial_status(F.col("structural"), F.lit(row["private"]))
        context = F.when(F.col("structural"), F.col("embed"))
        model = "bge-local" if row["private"] else self.remote_model
        done, group = 0, 1
        while done < planned["windows"]:
            some = chunks.where(F.col("chunk_index").between(done * chunking.WINDOW_CHUNKS, (done + group) * chunking.WINDOW_CHUNKS - 1))
            vectors = dispatch.bounded(chunking.embed(some, self.embedders[row["space"]], "embed"), self.concurrency)
            rows = some.join(vectors, ["doc", "chunk_index"]).select(F.col("doc").alias("doc_id"), "chunk_index", "breadcrumb", "structural", "pos_start", "pos_end", "n_tokens", "text", context.alias("contextualized"), status.alias("enrichment_status"), "embedding")
            written = self._commit(row, version, done, rows)
            calls = -(-written["n"] // chunking.WINDOW_CHUNKS)
            usd = self.spark.range(1).select(catalog.cost(F.lit(model), F.lit(float(written["t"])), F.lit(0.0))).first()[0]
            self._append("ledger", (source, model, calls, float(written["t"]), 0.0, 0.0, usd, datetime.now(timezone.utc)))
            done, group = done + group, 2 * group
        self._update(source, ingest_state="ready", content_hash=digest[0], chunks_planned=planned["n"], ingested_at=datetime.now(timezone.utc), v=version)

    def source_refresh(self, notebook: int, source: int, text: str | None = None, enrich: bool = False) -> dict:
        row = self._one("sources", id=source, notebook_id=notebook)
        if not row:
            raise EngineError(f"no source {source} in notebook {notebook}")
        digest = self._fetch(source, row["url"], text).select(readers.content_hash(F.col("txt"))).first()
        if digest and digest[0] == row["content_hash"]:
            return {"refreshed": False, "reason": "unchanged"}
        self.ingest(source, text)
        if enrich and row["private"]:
            self.source_enrich(source)
        return {"refreshed": True}

    def source_delete(self, notebook: int, source: int) -> None:
        if not self._one("sources", id=source, notebook_id=notebook):
            raise EngineError(f"no source {source} in notebook {notebook}")
        self._drop("sources", self.table("sources").where(F.col("id") == source))
        self.files.delete(f"chunks/notebook_id={notebook}/source_id={source}")

    def source_enrich(self, source: int, force: bool = False) -> dict:
        """Write contexts for the pending chunks of a private source with the injected contextualizer
        (window text, chunk text) -> context; chunks it fails on are marked and keep their vectors."""
        row = self._one("sources", id=source)
        if not row or not row["space"].startswith(policy.LOCAL_PREFIX):
            return {"enriched": 0, "failed": 0, "reason": "only private sources are enriched"}
        if self.contextualizer is None:
            raise EngineError("no contextualizer is configured")
        chunks = self.chunks().where(F.col("source_id") == source)
        wanted = chunking.enrich_targets(chunks, F.col("space"), force)
        if wanted.isEmpty():
            return {"enriched": 0, "failed": 0, "reason": "nothing pending"}
        around = chunking.context_windows(chunks.withColumn("doc", F.col("doc_id"))).drop("doc")
        contextualize, embed = self.contextualizer, self.embedders[policy.LOCAL]
        columns = [c for c in self.spark.createDataFrame([], CHUNKS).columns if c not in ("notebook_id", *LIVE)]
        target = F.lit(force) | F.col("enrichment_status").isin("pending", "failed")

        def run(batches):
            for pdf in batches:
                for i in pdf.index[pdf["target"]]:
                    try:
                        text = contextualize(pdf.at[i, "context"], pdf.at[i, "text"]) + "\n\n" + pdf.at[i, "text"]
                        pdf.at[i, "embedding"] = [float(x) for x in embed([text])[0]]
                        pdf.at[i, "contextualized"], pdf.at[i, "enrichment_status"] = text, "enriched"
                    except Exception:
                        pdf.at[i, "enrichment_status"] = "failed"
                yield pdf[columns]

        schema = ", ".join(x for x in CHUNKS.split(", ") if x.split()[0] in columns)
        rows = around.withColumn("target", target).select(*columns, "context", "target").mapInPandas(run, schema)
        version = row["v"] + 1
        self._commit(row, version, 0, rows)
        self._update(source, v=version)
        done = self.chunks().where(F.col("source_id") == source).agg(F.count(F.when(F.col("enrichment_status") == "enriched", 1)).alias("e"), F.count(F.when(F.col("enrichment_status") == "failed", 1)).alias("f")).first()
        return {"enriched": done["e"], "failed": done["f"]}

    # --- status ---

    def source_list(self, notebook: int) -> DataFrame:
        sources = self.table("sources").where(F.col("notebook_id") == notebook).withColumnRenamed("id", "source_id")
        rolled = catalog.rollup(sources, self.chunks(), "source_id")
        by_model = self.table("ledger").groupBy("source_id", "model").agg(*[F.sum(c).alias(c) for c in ("api_calls", "input_tokens", "output_tokens", "cache_hit_tokens")], F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
        models = F.array_sort(F.collect_list(F.struct("model", "api_calls", "input_tokens", "output_tokens", "cache_hit_tokens", "cost_usd")), lambda a, b: F.when(a["cost_usd"] > b["cost_usd"], -1).when(a["cost_usd"] < b["cost_usd"], 1).when(a["model"] < b["model"], -1).otherwise(1))
        costs = by_model.groupBy("source_id").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"), models.alias("costs"))
        return sources.select("source_id", "url", "display_name", "private", "ingest_state", "ingested_at").join(rolled, "source_id").join(costs, "source_id", "left").orderBy("ingested_at", "source_id")

    def source_status(self, source: int) -> dict:
        rows = self.table("sources").where(F.col("id") == source).withColumnRenamed("id", "source_id")
        rolled = rows.drop("chunks_planned").join(catalog.rollup(rows, self.chunks(), "source_id"), "source_id")
        found = rolled.withColumn("summary", catalog.summary(F.col("ingest_state"), F.col("ingest_error"))).first()
        if not found:
            raise EngineError(f"no source {source}")
        return found.asDict()

    def notebook_status(self, notebook: int) -> dict:
        if not self._one("notebooks", id=notebook):
            raise EngineError(f"no notebook {notebook}")
        rows = self.table("sources").where(F.col("notebook_id") == notebook)
        states = {r["ingest_state"]: r["count"] for r in rows.groupBy("ingest_state").count().collect()}
        none = F.lit(None).cast("string")
        found = catalog.rollup(rows, self.chunks(), "notebook_id").withColumn("summary", catalog.summary(none, none)).first()
        return {"notebook_id": notebook, "source_count": sum(states.values()), "source_states": states} | (found.asDict() if found else {})

    def config_set(self, key: str, value: str) -> None:
        self._append("config", (key, value))

    def config_get(self, key: str) -> str | None:
        row = self._one("config", key=key)
        return row["value"] if row else None

    # --- search ---

    def index_vectors(self, notebook: int) -> None:
        """Stores the notebook's vectors in cells.  Queries then read a part of them, and all of those committed since."""
        if not self._one("notebooks", id=notebook):
            raise EngineError(f"no notebook {notebook}")
        rows = self.chunks().where(F.col("notebook_id") == notebook).select(F.xxhash64("source_id", "chunk_index").alias("vec_id"), "space", "embedding", *LIVE)
        folder = f"cells/notebook_id={notebook}/{time.time_ns()}"
        rows = cut(rows)
        cells.build(rows, f"{self.root}/{folder}")
        rows.select(*LIVE).distinct().write.parquet(f"{self.root}/{folder}/commits")
        before = self._one("cells", notebook_id=notebook)
        self._append("cells", (notebook, folder, datetime.now(timezone.utc)))
        for old in self.files.names(f"cells/notebook_id={notebook}"):
            # a query may still read the ones that were in use
            if before and old not in (before["folder"].rsplit("/", 1)[1], folder.rsplit("/", 1)[1]):
                self.files.delete(f"cells/notebook_id={notebook}/{old}")

    def _near(self, notebook: int, vector: DataFrame, k: int) -> DataFrame | None:
        """Neighbours by the notebook's cells, and of what was committed since; None without cells."""
        stored = self._one("cells", notebook_id=notebook)
        if not stored:
            return None
        folder, live = f"{self.root}/{stored['folder']}", self.commits().select(*LIVE)
        found = cells.Search(self.spark, folder, live=lambda rows: rows.join(live, LIVE, "left_semi")).nearest(vector, k)
        since = self.chunks().where(F.col("notebook_id") == notebook).join(self.spark.read.parquet(f"{folder}/commits"), LIVE, "left_anti")
        late = search.knn_by_space(since.select(F.xxhash64("source_id", "chunk_index").alias("vec_id"), "space", "embedding"), vector, k)
        return search.ranked(found.unionByName(late).drop("rank"), ["space"], k, "vec_id")

    def notebook_query(self, notebook: int, query: str, top_k: int = 10, private: bool | None = None, mode: str = "hybrid", rerank: bool = False) -> dict:
        """Ranked chunks of one notebook.  The scope is applied before ranking; BM25 statistics cover all
        notebooks.  Remote spaces are left out for a private query."""
        if mode not in hybrid.MODES:
            raise ValueError(f"unknown mode {mode!r}; one of {', '.join(hybrid.MODES)}")
        hidden = self.default_private if private is None else private
        began, spent = time.perf_counter(), {}

        def took(name: str, since: float) -> None:
            spent[name] = round((time.perf_counter() - since) * 1000, 2)

        names = self.table("sources").select(F.col("id").alias("source_id"), "display_name")
        rows = self.chunks().join(names, "source_id").withColumn("chunk", F.xxhash64("source_id", "chunk_index")).withColumn("notebook", F.col("notebook_id").cast("string"))
        scoped = rows.where(F.col("notebook_id") == notebook)
        spaces = sorted(r["space"] for r in scoped.select("space").distinct().collect())
        if not spaces:
            return {"results": self.spark.createDataFrame([], "doc_id bigint, score double"), "searched": [], "excluded": [], "reranked": False, "mode": mode, "latency_ms": {}, "note": "the notebook has no chunks"}
        excluded = [s for s in spaces if hidden and s.startswith(policy.REMOTE_PREFIX)]
        searched = [s for s in spaces if s not in excluded]
        phrases = search.parse_query(self.spark, query)
        possible = self.index.possible(phrases) if mode != "dense" else []
        # a phrase that no run has counts nothing
        phrases = [p for p, some in zip(phrases, possible, strict=False) if some]
        since = time.perf_counter()
        asked = []
        for space in searched if mode != "lexical" else []:
            policy.guard_remote(hidden, space)
            asked.append((space, [float(x) for x in self.query_embedders[space]([query])[0]]))
        vector = self.spark.createDataFrame(asked, "space string, q array<float>")
        took("query_embed_ms", since)
        extra = ("source_id", "chunk_index", "display_name", "contextualized", "enrichment_status")
        docs = rows.select(F.col("chunk").alias("doc_id"), "notebook", "source", "private", "space", "text", *extra)
        vectors = rows.select(F.col("chunk").alias("vec_id"), "notebook", "space", "embedding")

        def stage(name: str, made: DataFrame) -> DataFrame:
            since = time.perf_counter()
            made = cut(made)  # lists of a few hundred rows
            took(f"{name}_ms", since)
            return made

        since = time.perf_counter()
        near = self._near(notebook, vector, top_k) if mode != "lexical" else None
        near = cut(near) if near is not None else None
        took("cells_ms", since)
        results = hybrid.notebook_query(docs, vectors, vector, phrases, str(notebook), hidden, top_k, mode, query if rerank else None, extra, self.scorers, self.postings(), near, stage)
        results = self.spark.createDataFrame(results.collect(), results.schema)  # top_k rows
        took("total_ms", began)
        note = f"{mode} search" + (", reranked" if rerank else "")
        return {"results": results, "searched": searched, "excluded": excluded, "reranked": rerank, "mode": mode, "latency_ms": spent, "note": note}
