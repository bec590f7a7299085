"""A table in folders by one column, of which a commit replaces the touched ones and leaves the others' files as they are.

``data/<version>/part=<value>`` holds what a version wrote, ``commits/<version>.json`` which folder each value has had
since then. A commit appears by one rename after its data is written, so a reader sees a version whole or not at all,
and one that began to read keeps its files until ``vacuum``. One writer at a time. The key's values should be few
(government bodies): their list is kept by the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Snapshot:
    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._Path(f"{self.path}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(at)) if self._files.exists(at) else []

    def last(self) -> dict:
        """The last commit: version, schema, folders (of each), writers (number of the last batch of each stream)."""
        names = [n for n in self._names("commits") if n.endswith(".json")]
        if not names:
            return {"version": -1, "schema": None, "folders": {}, "writers": {}}
        stream = self._files.open(self._Path(f"{self.path}/commits/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, values: list | None = None) -> DataFrame | None:
        """The table as last committed, or its rows of some values of the key alone: other folders aren't listed. None before the first commit."""
        last = self.last()
        if last["schema"] is None:
            return None
        schema = StructType.fromJson(json.loads(last["schema"]))
        paths = [f"{self.path}/data/{version}/{folder}" for folder, (version, value) in sorted(last["folders"].items()) if values is None or value in values]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def commit(self, rows: DataFrame, values: list, writer: str | None = None, number: int | None = None) -> None:
        """Makes ``rows`` all that the table has of ``values``, the key's values that are touched; None is one of them.

        ``writer`` and ``number`` are recorded, for ``has``.
        """
        last = self.last()
        version = last["version"] + 1
        name = f"{version:012d}"
        target = f"{self.path}/data/{name}"
        part = F.when(F.col(self.key).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(self.key).cast("string")))
        # A value with many rows is dealt to eight tasks; what an attempt without a commit has left is replaced.
        deal = F.pmod(F.xxhash64(*(c for c, kind in rows.dtypes if "map<" not in kind)), F.lit(8))
        rows.withColumn("part", part).repartition("part", deal).write.mode("overwrite").partitionBy("part").parquet(target)
        known = {"part=" + self._escaped("n" if v is None else f"v{v}"): v for v in values}
        folders = {f: at for f, at in last["folders"].items() if at[1] not in values}
        folders |= {f: (name, known[f]) for f in self._names(f"data/{name}") if f.startswith("part=")}
        writers = last["writers"] | ({writer: number} if writer else {})
        body = json.dumps({"version": version, "schema": rows.schema.json(), "folders": folders, "writers": writers})
        draft, place = self._Path(f"{self.path}/commits/.{name}"), self._Path(f"{self.path}/commits/{name}.json")
        out = self._files.create(draft, True)
        try:
            out.write(bytearray(body.encode()))
        finally:
            out.close()
        if self._files.exists(place) or not self._files.rename(draft, place):
            raise RuntimeError(f"version {version} was committed by another writer")

    def _escaped(self, value: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def has(self, writer: str, number: int) -> bool:
        """Whether that batch of that stream is in the table."""
        return self.last()["writers"].get(writer, -1) >= number

    def vacuum(self) -> int:
        """Deletes folders that the last version doesn't use, and commits before it. Returns how many folders went."""
        last, gone = self.last(), 0
        used = {(version, folder) for folder, (version, _) in last["folders"].items()}
        for version in self._names("data"):
            folders = [f for f in self._names(f"data/{version}") if f.startswith("part=")]
            for folder in folders:
                if (version, folder) not in used:
                    gone += self._files.delete(self._Path(f"{self.path}/data/{version}/{folder}"), True)
            if not any((version, f) in used for f in folders):
                self._files.delete(self._Path(f"{self.path}/data/{version}"), True)
        for name in self._names("commits"):
            if name != f"{last['version']:012d}.json":
                self._files.delete(self._Path(f"{self.path}/commits/{name}"), False)
        return gone
