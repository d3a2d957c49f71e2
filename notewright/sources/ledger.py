"""Work done once per key, in batches that count only when they are complete.

A ledger folder holds, for each batch, the keys that it took on, the rows made of them, and last of all a commit: one row in one file. What has
no commit does not exist: readers skip it, and the next attempt at the batch writes over it. So a batch that fails half-way adds nothing, a
batch that is tried again after its commit adds nothing, and keys whose rows came out empty are not taken on again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.sources.files import table_exists

COMMIT = "batch string, nth long, n_keys long, n_rows long"


class Ledger:
    """The ledger in folder ``path``, over the values of column ``key``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key

    def commits(self) -> DataFrame:
        """``batch, nth, n_keys, n_rows``: one row for each complete batch."""
        path = f"{self.path}/commits"
        if not table_exists(self.spark, path):
            return self.spark.createDataFrame([], COMMIT)
        return self.spark.read.parquet(path).select("batch", "nth", "n_keys", "n_rows")

    def _committed(self, part: str) -> DataFrame | None:
        # Batches are few and their names a partition column, so whole folders are skipped.
        names = [r["batch"] for r in self.commits().select("batch").collect()]
        if not names:
            return None
        return self.spark.read.option("basePath", f"{self.path}/{part}").parquet(*(f"{self.path}/{part}/batch={n}" for n in names))

    def done(self) -> DataFrame | None:
        """The keys of all complete batches; None before the first."""
        keys = self._committed("keys")
        return None if keys is None else keys.select(self.key)

    def rows(self) -> DataFrame | None:
        """The rows of all complete batches, with their ``batch``; None before the first."""
        return self._committed("rows")

    def process(self, source: DataFrame, transform: Callable[[DataFrame], DataFrame], batch: str | None = None) -> bool:
        """Transform the rows of ``source`` whose key is not done and commit them as one batch; False where ``batch`` is committed already.

        ``transform`` may make any number of rows of a key, also none. Without ``batch`` the run is named by its number. Rows with a null key are left out.
        """
        known = {r["batch"] for r in self.commits().select("batch").collect()}
        if batch in known:
            return False
        nth = len(known)
        batch = batch or f"run-{nth}"
        todo, done = source.filter(F.col(self.key).isNotNull()), self.done()
        if done is not None:
            todo = todo.join(done, self.key, "left_anti")
        keys, rows = f"{self.path}/keys/batch={batch}", f"{self.path}/rows/batch={batch}"
        # Keys first: the rows are made of exactly these, even if the source grows meanwhile.
        todo.select(self.key).distinct().write.mode("overwrite").parquet(keys)
        taken = self.spark.read.parquet(keys)
        transform(source.join(taken, self.key, "left_semi")).write.mode("overwrite").parquet(rows)
        n_keys, n_rows = (self.spark.read.parquet(p).count() for p in (keys, rows))
        commit = self.spark.createDataFrame([(batch, nth, n_keys, n_rows)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/commit={batch}")
        return True


def stream_once(
    arriving: DataFrame, path: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "id", trigger: dict | None = None
):
    """A stream into a ledger: each micro-batch is one batch of it, named after the checkpoint and its number.

    A batch that Spark runs again after a failure is written over, or skipped where its commit was made; a key that arrives twice is taken on once.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def run(batch: DataFrame, number: int) -> None:
        Ledger(batch.sparkSession, path, key).process(batch, transform, f"{stream}-{number}")

    return (
        arriving.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
