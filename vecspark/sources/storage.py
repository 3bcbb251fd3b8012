"""Where jobs may write, and tables in the shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vecspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/vecspark-{uuid.uuid4().hex}-{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Files:
    """Small files beside the tables, through the file system of their path."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        f = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
        finally:
            f.close()

    def put(self, path: str, text: str) -> None:
        """Write beside, then rename over: a reader sees the old file or the new one, never none."""
        fs, p = self._at(path)
        temp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        f = fs.create(temp, True)
        f.write(bytearray(text.encode()))
        f.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(fs.makeQualified(temp), fs.makeQualified(p), how)

    def folders(self, path: str) -> list[str]:
        """The names of the folders in ``path``; none if it isn't there."""
        fs, p = self._at(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Versions:
    """Numbered states of a folder: a version's data is written first, then its manifest, by one rename.

    The highest version that has a manifest counts, so there is no pointer that could be missing; readers see a whole
    version or the one before, whatever a writer that broke off has left. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.files = path.rstrip("/"), Files(spark)

    def folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def manifest(self, version: int) -> str:
        return f"{self.folder(version)}/manifest.json"

    def fresh(self, version: int) -> str:
        """The folder of a version to be written, without what an earlier attempt left."""
        if self.files.exists(self.manifest(version)):
            raise FileExistsError(f"version {version} of {self.path} is complete: another writer was faster")
        self.files.delete(self.folder(version))
        return self.folder(version)

    def current(self) -> dict | None:
        found = sorted((int(x[2:]) for x in self.files.folders(self.path) if x.startswith("v=") and x[2:].isdigit()), reverse=True)
        version = next((v for v in found if self.files.exists(self.manifest(v))), None)
        if version is None:
            return None
        state = json.loads(self.files.read(self.manifest(version)))
        if state["version"] != version:
            raise ValueError("the manifest is of another version than its folder")
        return state

    def commit(self, state: dict) -> None:
        self.files.put(self.manifest(state["version"]), json.dumps(state, sort_keys=True))


def digest(df: DataFrame) -> list[int]:
    """Count of the rows and the sum of their hashes (modulo 2 ** 64), which doesn't depend on their order; digests of
    parts add up, and equal rows count each."""
    r = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)"))).first()
    return [r[0], int(r[1]) % 2**64]


def joined_digest(a: list[int], b: list[int]) -> list[int]:
    return [a[0] + b[0], (a[1] + b[1]) % 2**64]
