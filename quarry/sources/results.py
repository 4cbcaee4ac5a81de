"""A table of results that grows by groups of rows, each of which is there as a whole or not at all.

A group's rows are written to a folder of their own; then a commit names that folder. The commit is created once: of two writers of one
group one wins, and a writer that starts again finds what is done. Readers see committed folders alone, so an interrupted group
is hidden until it is written again, and ``clean`` removes what it left.
"""

from __future__ import annotations

import json
import uuid
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Results:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        context = spark.sparkContext
        self._at = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._at(self.path).getFileSystem(context._jsc.hadoopConfiguration())

    @staticmethod
    def _name(group: dict) -> str:
        return sha256(json.dumps(group, sort_keys=True).encode()).hexdigest()[:32]

    def write(self, group: dict, rows: DataFrame) -> bool:
        """The rows of a group, unless it is there already."""
        if self.has(group):
            return False
        attempt = f"{self._name(group)}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/data/{attempt}")
        return self._commit(group, attempt)

    def _commit(self, group: dict, attempt: str) -> bool:
        target = self._at(f"{self.path}/commits/{self._name(group)}")
        if self._files.exists(target):
            return False
        text = json.dumps({"group": json.dumps(group, sort_keys=True), "attempt": attempt}).encode()
        draft = self._at(f"{self.path}/drafts/{attempt}")
        out = self._files.create(draft, False)
        out.write(bytearray(text))
        out.close()
        self._files.mkdirs(target.getParent())
        return bool(self._files.rename(draft, target)) and self._committed()[self._name(group)] == attempt

    def has(self, group: dict) -> bool:
        return bool(self._files.exists(self._at(f"{self.path}/commits/{self._name(group)}")))

    def commits(self) -> DataFrame:
        """(group, attempt) of all groups; the group as JSON."""
        schema = "group string, attempt string"
        try:
            return self.spark.read.schema(schema).json(f"{self.path}/commits")
        except AnalysisException:  # nothing yet
            return self.spark.createDataFrame([], schema)

    def _committed(self) -> dict[str, str]:
        return {r["attempt"].rsplit("-", 1)[0]: r["attempt"] for r in self.commits().collect()}  # one row a group

    def read(self) -> DataFrame:
        """The rows of all groups."""
        paths = sorted(f"{self.path}/data/{a}" for a in self._committed().values())
        if not paths:
            raise ValueError(f"{self.path} has no groups yet")
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def clean(self) -> int:
        """Remove folders that no commit names; for when nobody writes."""
        kept, top, gone = set(self._committed().values()), self._at(f"{self.path}/data"), 0
        for status in self._files.listStatus(top) if self._files.exists(top) else []:
            if status.getPath().getName() not in kept:
                gone += bool(self._files.delete(status.getPath(), True))
        return gone
