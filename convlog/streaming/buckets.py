"""Tables that a job rewrites bucket by bucket, with commits that take effect at once or not at all.

A bucket of a table is a folder that one commit writes and nobody changes. A commit is a small file that names, for all
tables, the version of each bucket; it is written aside and renamed into place, which fails if its number is taken. So a
reader sees one commit or the next, what a failed job wrote is never named, and a commit that runs again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convlog.store import exists


class Buckets:
    """Tables (name: schema, each with conv_id) in so many buckets of conv_id under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], buckets: int = 64):
        self.spark, self.folder, self.tables, self.buckets = spark, folder, tables, buckets
        self._java = spark._jvm.org.apache.hadoop.fs

    def bucket(self, conv_id: Column | str = "conv_id") -> Column:
        return F.pmod(F.xxhash64(conv_id), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of keys (conv_id): at most as many numbers as there are buckets."""
        return sorted(r.bucket for r in keys.select(self.bucket().alias("bucket")).distinct().collect())

    def _files(self, path: str):
        where = self._java.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def last(self) -> int:
        """The number of the last commit; -1 before the first."""
        if not exists(self.spark, f"{self.folder}/commits"):
            return -1
        where, files = self._files(f"{self.folder}/commits")
        return max((int(s.getPath().getName()) for s in files.listStatus(where) if s.getPath().getName().isdigit()), default=-1)

    def versions(self) -> dict[str, dict[str, int]]:
        """table: bucket: the commit that wrote it, as of the last commit."""
        if (number := self.last()) < 0:
            return {t: {} for t in self.tables}
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{number:020d}", wholetext=True).first().value)

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table as of the last commit; with buckets, of these alone: no other file is opened."""
        known = self.versions()[table]
        paths = [f"{self.folder}/{table}/{number}/bucket={b}" for b, number in known.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.tables[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.tables[table])

    def commit(self, number: int, rows: dict[str, DataFrame], buckets: list[int]) -> bool:
        """Replace the given buckets of tables by rows, as commit `number`. False, and nothing changed, if there is such a
        commit or a later one."""
        if number <= self.last():
            return False
        now = self.versions()
        for table, df in rows.items():
            path = f"{self.folder}/{table}/{number}"
            names = self.spark.createDataFrame([], self.tables[table]).columns
            placed = df.select(*names, self.bucket().alias("bucket"))
            placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
            for b in buckets:
                now[table].pop(str(b), None)
                if exists(self.spark, f"{path}/bucket={b}"):
                    now[table][str(b)] = number
        return self._named(number, json.dumps(now))

    def _named(self, number: int, text: str) -> bool:
        aside, target = f"{self.folder}/commits/.{uuid.uuid4().hex}", f"{self.folder}/commits/{number:020d}"
        where, files = self._files(aside)
        out = files.create(where, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._java.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(where, self._java.Path(target), self.spark._sc._gateway.new_array(self._java.Options.Rename, 0))
        except Exception:  # noqa: BLE001 - the number is taken
            if exists(self.spark, target):
                return False
            raise
        return True

    def cleaned(self) -> None:
        """Delete what the last commit doesn't name: earlier versions and what failed jobs left."""
        now, where = self.versions(), None
        for table in self.tables:
            if not exists(self.spark, f"{self.folder}/{table}"):
                continue
            where, files = self._files(f"{self.folder}/{table}")
            for version in files.listStatus(where):
                for part in files.listStatus(version.getPath()):
                    name = part.getPath().getName()
                    if name.startswith("bucket=") and str(now[table].get(name.removeprefix("bucket="))) != version.getPath().getName():
                        files.delete(part.getPath(), True)
