"""Small tables as logs of changes, and stored postings as merged runs.

A change is one appended file; reading takes the last state of each key.  When a log has many files, its state becomes the
beginning of a new version.  One driver writes a store at a time; its threads share a lock.
"""

from __future__ import annotations

import threading
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import search

#: A log of more files than this is rewritten.
MOST_FILES = 32
#: So many runs of one level are merged into one of the next.
FAN = 4


class Files:
    """Folders below a root, on whatever file system Spark has there."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/{name}"))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)


class Log:
    """A table of the columns ``schema``, the last state of each ``key`` (all rows, if there is none)."""

    def __init__(self, files: Files, name: str, schema: str, key: str | None = None) -> None:
        self.files, self.name, self.schema, self.key = files, name, schema, key
        self.columns = [c.split()[0] for c in schema.split(", ")]
        self._lock, self._last = threading.RLock(), 0

    def _version(self) -> int:
        done = [int(n[1:]) for n in self.files.names(self.name) if self.files.exists(f"{self.name}/{n}/_SUCCESS")]
        return max(done, default=0)

    def changes(self) -> DataFrame:
        """All changes: the columns, when each was made (``at_ns``) and whether it deletes the key (``gone``)."""
        schema, folder = f"{self.schema}, at_ns bigint, gone boolean", f"{self.name}/v{self._version()}"
        return self.files.spark.read.schema(schema).parquet(f"{self.files.root}/{folder}") if self.files.exists(folder) else self.files.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        if self.key is None:
            return self.changes().select(*self.columns)
        return self._states().where("not gone").select(*self.columns)

    def _states(self) -> DataFrame:
        last = self.changes().groupBy(self.key).agg(F.max_by(F.struct(*[c for c in self.columns if c != self.key], "gone", "at_ns"), "at_ns").alias("s"))
        return last.select(self.key, "s.*")

    def append(self, rows: DataFrame | list[tuple], gone: bool = False) -> None:
        with self._lock:
            if not isinstance(rows, DataFrame):
                rows = self.files.spark.createDataFrame(rows, self.schema)
            self._last = max(self._last + 1, time.time_ns())
            folder = f"{self.name}/v{self._version()}"
            stamped = rows.select(*self.columns, F.lit(self._last).alias("at_ns"), F.lit(gone).alias("gone"))
            stamped.coalesce(1).write.mode("append").parquet(f"{self.files.root}/{folder}")
            if len([n for n in self.files.names(folder) if n.endswith(".parquet")]) > MOST_FILES:
                self.rewrite()

    def rewrite(self, keep=None) -> None:
        """A new version of the last states (of the rows that ``keep`` is true of).  Of deleted keys only the highest one
        stays, so that no number is given twice."""
        with self._lock:
            now = self._version()
            rows = self.changes()
            if self.key is not None:
                rows = self._states()
                rows = rows.where(~F.col("gone") | (F.col(self.key) == F.lit(rows.agg(F.max(self.key)).first()[0])))
            if keep is not None:
                rows = rows.where(keep)
            # no coalesce: a log of many rows is written by many tasks, a small one by one
            rows.select(*self.columns, "at_ns", "gone").write.mode("overwrite").parquet(f"{self.files.root}/{self.name}/v{now + 1}")
            self.files.delete(f"{self.name}/v{now - 1}")  # a reader may still have the version before


class PostingsRuns:
    """Postings (token, tf, dl, places and the columns ``keys`` of their document) in runs sorted by token.

    A batch of documents is a run of level 0; ``FAN`` runs of a level become one of the next, without the documents that
    ``live`` no longer has.  A query opens the files of at most ``FAN - 1`` runs of each level, whose number grows with the
    logarithm of the batches.  Each run has a dictionary of its tokens, by which a query finds out which of its phrases
    can occur before any posting is read."""

    COLUMNS = "token string, tf bigint, dl int, places array<int>"

    def __init__(self, files: Files, name: str, keys: str, fan: int = FAN) -> None:
        self.files, self.name, self.fan = files, name, fan
        self.schema, self.key_columns = f"{keys}, {self.COLUMNS}", [c.split()[0] for c in keys.split(", ")]
        self.manifest = Log(files, f"{name}/manifest", "run bigint, level int, n_rows bigint", "run")
        self._lock = threading.RLock()

    def _folder(self, run: int, kind: str = "postings") -> str:
        return f"{self.files.root}/{self.name}/{kind}/run-{run}"

    def runs(self) -> list[tuple[int, int, int]]:
        """(run, level, n_rows): a handful of rows."""
        return sorted(tuple(r) for r in self.manifest.rows().collect())

    def _next(self) -> int:
        return (self.manifest.changes().agg(F.max("run")).first()[0] or 0) + 1

    def _write(self, rows: DataFrame, level: int) -> int:
        run = self._next()
        columns = [c.split()[0] for c in self.schema.split(", ")]
        # the borders of the ranges come from a look at all rows, so rows are made once, not twice
        rows.select(columns).write.mode("overwrite").parquet(self._folder(run, "unsorted"))
        rows = self.files.spark.read.schema(self.schema).parquet(self._folder(run, "unsorted"))
        rows.repartitionByRange("token").sortWithinPartitions("token", *self.key_columns).write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(self._folder(run))
        self.files.delete(f"{self.name}/unsorted")
        stored = self._read(run)
        stored.groupBy("token").agg(F.count("*").alias("df")).repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(self._folder(run, "tokens"))
        self.manifest.append([(run, level, stored.count())])
        return run

    def _read(self, *runs: int) -> DataFrame:
        return self.files.spark.read.schema(self.schema).parquet(*[self._folder(r) for r in runs])

    def add(self, rows: DataFrame, live: DataFrame | None = None) -> int:
        """Stores the postings of new documents as a run, merges, and returns the number of tokens."""
        with self._lock:
            run = self._write(rows, 0)
            total = self._read(run).agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
            self.compact(live)
        return total

    def compact(self, live: DataFrame | None = None) -> None:
        """Merges until no level has ``fan`` runs.  ``live`` has the keys of documents that still count."""
        with self._lock:
            while True:
                by_level: dict[int, list[int]] = {}
                for run, level, _ in self.runs():
                    by_level.setdefault(level, []).append(run)
                full = [(level, runs) for level, runs in sorted(by_level.items()) if len(runs) >= self.fan]
                if not full:
                    return
                level, runs = full[0]
                rows = self._read(*runs)
                if live is not None:
                    rows = rows.join(live, live.columns, "left_semi")
                self._write(rows, level + 1)
                self.manifest.append([(r, 0, 0) for r in runs], gone=True)
                self._sweep(runs)

    def _sweep(self, merged: list[int]) -> None:
        """Removes the runs that left the manifest before this merge; a reader may still have those that leave now."""
        kept = {r for r, _, _ in self.runs()} | set(merged)
        for kind in ("postings", "tokens"):
            for name in self.files.names(f"{self.name}/{kind}"):
                if int(name.removeprefix("run-")) not in kept:
                    self.files.delete(f"{self.name}/{kind}/{name}")

    def rows(self) -> DataFrame:
        runs = [r for r, _, _ in self.runs()]
        return self._read(*runs) if runs else self.files.spark.createDataFrame([], self.schema)

    def possible(self, phrases: list[search.Phrase]) -> list[bool]:
        """Which phrases can occur, from the dictionaries alone."""
        runs = [r for r, _, _ in self.runs()]
        if not runs or not phrases:
            return [False] * len(phrases)
        tokens = self.files.spark.read.schema("token string, df bigint").parquet(*[self._folder(r, "tokens") for r in runs])
        parts = [[F.col("token") == t for t in p[:-1]] + [F.col("token").startswith(p[-1])] for p in phrases]
        some = F.lit(False)
        for part in parts:
            for condition in part:
                some = some | condition
        flags = [F.array(*[F.coalesce(F.bool_or(c), F.lit(False)) for c in part]).alias(f"p{i}") for i, part in enumerate(parts)]
        found = tokens.where(some).agg(*flags).first()
        return [all(f) for f in found]
