"""Micro-batches of query entities against a static index of targets, with the owners of targets kept between batches."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.blocking import candidates
from ..operators.prepare import prepare
from ..operators.resolve import gate, owners
from ..operators.scoring import score_pairs
from ..plans.profiles import Profile


class OwnerTable:
    """The best claim on every target so far, as a table in a folder; merging a batch again changes nothing.

    Each batch writes a version of its own: a folder without _SUCCESS is no version, and a batch that is delivered again
    is merged into the last version of the others, so a failure halfway leaves that one in force. Versions older than
    the one before the last are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, order: tuple[str, ...]):
        self.spark, self.folder, self.order = spark, folder.rstrip("/"), order

    def _versions(self) -> list[int]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(fs_path)]
        done = [int(n[8:]) for n in names if n.startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(done)

    def read(self) -> DataFrame | None:
        v = self._versions()
        return self.spark.read.parquet(f"{self.folder}/version={v[-1]}") if v else None

    def merge(self, claims: DataFrame, version: int) -> None:
        done = [v for v in self._versions() if v < version]
        have = self.spark.read.parquet(f"{self.folder}/version={done[-1]}") if done else None
        both = claims if have is None else have.unionByName(claims)
        owners(both, self.order).write.mode("overwrite").parquet(f"{self.folder}/version={version}")
        for v in done[:-1]:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/version={v}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def start_resolution(queries: DataFrame, targets: DataFrame, profile: Profile, table: OwnerTable, checkpoint: str, available_now: bool = True):
    """A streaming query that scores each micro-batch of entities and merges its claims.

    targets: a static table of entities; caps count what the batch needs, as they do in batch runs, so a key's first
    rows are the same in every batch.
    """
    index = prepare(targets, profile.text).persist()

    def step(batch: DataFrame, number: int) -> None:
        q = prepare(batch, profile.text).persist()
        scored = score_pairs(candidates(q, index, profile), q, index, profile)
        table.merge(scored, number)
        q.unpersist()

    writer = queries.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def matches(table: OwnerTable, profile: Profile) -> DataFrame | None:
    """Matches as of now: the owners behind the profile's gate."""
    owned = table.read()
    return None if owned is None else gate(owned, profile.gate, profile.gate_score, profile.gate_address)
