"""Tables that outlive a run: keysets and lookup tables in a folder, by name.

A table's versions stand side by side; the newest finished one counts, so a run
that fails or is run again leaves what was there, and readers of the version
before are not disturbed. The folder may be in any store that Spark writes to.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import enrich, keyset

KEYS = "id long, key string"


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _list(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def versions(self, name: str) -> list[int]:
        """Finished versions, the oldest first."""
        found = [int(v[2:]) for v in self._list(f"{self.path}/{name}") if re.fullmatch(r"v=\d+", v)]
        return sorted(v for v in found if "_SUCCESS" in self._list(f"{self.path}/{name}/v={v}"))

    def names(self) -> list[str]:
        return [n for n in self._list(self.path) if self.versions(n)]

    def read(self, name: str, schema: str) -> DataFrame:
        """The newest version; empty if there is none."""
        have = self.versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/v={have[-1]}") if have else self.spark.createDataFrame([], schema)

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """A new version, read back. The version before stays for those who read it; older ones go."""
        have = self.versions(name)
        path = f"{self.path}/{name}/v={have[-1] + 1 if have else 0}"
        df.write.mode("overwrite").parquet(path)
        for v in have[:-1]:
            fs, old = self._fs(f"{self.path}/{name}/v={v}")
            fs.delete(old, True)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        fs, at = self._fs(f"{self.path}/{name}")
        fs.delete(at, True)

    def keyset(self, name: str, df: DataFrame, key: str, order: str) -> DataFrame:
        """The stored keyset with the keys of df numbered on."""
        return self.write(name, keyset.extend(self.read(name, KEYS), df.withColumn("_key", F.col(key).cast("string")), "_key", order))

    def enrich(self, name: str, df: DataFrame, key: str, compute, **how) -> DataFrame:
        """df with `fields` and `state` of its key; what the stored lookup table lacks is computed and kept."""
        have = self.read(name, enrich.CACHE)
        _, entries = enrich.enrich(df, key, compute, have, **how)
        entries = self.write(name, entries)
        return enrich.joined(df, key, entries)
