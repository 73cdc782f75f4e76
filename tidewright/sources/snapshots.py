"""Tables in parts that are replaced together: new parts go to new folders, then one small file names the parts that count."""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshots:
    """A Parquet table under ``base``, in parts (days, hash buckets), with numbered versions.

    ``base``/versions/<n>.json maps each part to the folder that holds it in version n, and appears by
    a rename. A reader takes the last version when it plans, and the folders of a version never
    change, so it sees the old parts or the new ones and never a mixture; a writer that fails leaves
    no trace in a version. Versions name a part's folder and not its files, so a version of a
    thousand parts is some 100 KB.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.base}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def parts(self, version: int | None = None) -> dict[str, str]:
        """Part -> folder of a version, of the last one unless given; empty before the first."""
        known = self.versions()
        if not known:
            return {}
        source = self._fs.open(self._path(f"{self.base}/versions/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def publish(self, version: int, parts: dict[str, str]) -> None:
        """Make ``parts`` the version. A version that is there already stays as it is."""
        end = self._path(f"{self.base}/versions/{version}.json")
        temporary = self._path(f"{self.base}/versions/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary)
        out.write(json.dumps(parts, sort_keys=True).encode())
        out.close()
        if self._fs.exists(end) or not self._fs.rename(temporary, end):
            self._fs.delete(temporary, False)

    def write(self, df: DataFrame, part: str, name: str) -> dict[str, str]:
        """Write the parts of ``df`` to folders of their own under data/``name``; not published yet."""
        folder = f"{self.base}/data/{name}"
        # all rows of a part go to a few files; a part that is a good part of the rows is split
        df.hint("rebalance", part).write.mode("overwrite").partitionBy(part).parquet(folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        return {unquote(n.partition("=")[2]): f"{folder}/{n}" for n in names if n.startswith(f"{part}=")}

    def replace(self, df: DataFrame, part: str, version: int | None = None) -> int:
        """Replace the parts that ``df`` holds, all in one step; the others stay. Gives the version."""
        n = (self.versions() or [-1])[-1] + 1 if version is None else version
        new = self.write(df, part, f"{n}-{uuid.uuid4().hex[:8]}")
        self.publish(n, self.parts() | new)
        return n

    def read(self, schema: str, part: str | None = None, kind: str = "string", only: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table as of a version, the last unless given. ``part`` names a column for the parts, of
        type ``kind``; ``only`` reads these parts alone, and other folders are not listed."""
        here = {k: v for k, v in self.parts(version).items() if only is None or k in only}
        if not here:
            df = self.spark.createDataFrame([], schema)
            return df if part is None else df.withColumn(part, F.lit(None).cast(kind))
        df = self.spark.read.schema(schema).parquet(*here.values())
        if part is None:
            return df
        name = F.regexp_extract(F.col("_metadata.file_path"), f"/{part}=([^/]*)/[^/]*$", 1)
        return df.select("*", F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).cast(kind).alias(part))

    def clean(self, keep: int = 2) -> None:
        """Forget all but the last ``keep`` versions and remove the folders that only they name."""
        known = self.versions()
        stay = {p for v in known[-keep:] for p in self.parts(v).values()}
        for v in known[:-keep]:
            for p in self.parts(v).values():
                if p not in stay:
                    self._fs.delete(self._path(p), True)
            self._fs.delete(self._path(f"{self.base}/versions/{v}.json"), False)
