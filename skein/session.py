"""Where scratch data lives, and joins whose broadcast is bounded.

Everything an operator has to keep between jobs goes to the folder in
``spark.checkpoint.dir``, which all executors of a cluster share. Only where
that setting is missing (tests on one machine) a local folder is used.
"""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows, bytes on disk, and bytes of its values in memory.
BROADCAST_ROWS = 400_000
BROADCAST_BYTES = 16 * 1024 * 1024
BROADCAST_WEIGHT = 96 * 1024 * 1024
#: Copies of the small side where it is too large to broadcast: a hot key's rows go to as many tasks.
SALTS = 8


def scratch_root(spark: SparkSession) -> str:
    """The shared scratch folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        made = tempfile.mkdtemp(prefix="skein-scratch-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        root = f"file://{made}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing else uses."""
    _made.append(f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote to the scratch folder. DataFrames that read it can't be evaluated any more."""
    while _made:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Folder:
    """Small JSON files in a folder that several writers share.

    ``create`` gives a file its name only when it is complete and only if the name is free, in one step: by a hard link on
    a mounted file system, else by a rename that does not overwrite (atomic on HDFS). A writer that dies before that step
    leaves a hidden file that nobody reads.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.at("").getFileSystem(self._conf)
        self._mounted = self._fs.getUri().getScheme() == "file"

    def at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return bool(self._fs.exists(self.at(name)))

    def names(self, name: str = "") -> list[str]:
        """The sorted visible names in a folder; none if it is missing."""
        if not self.exists(name):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(self.at(name))) if n[0] not in "._")

    def read(self, name: str) -> dict | None:
        """None if there is no such file, also if it is deleted while it is read."""
        if not self.exists(name):
            return None
        try:
            stream = self._fs.open(self.at(name))
        except Exception:
            if self.exists(name):
                raise
            return None
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, value: dict) -> bool:
        """False if the name is taken."""
        folder, _, last = name.rpartition("/")
        temp = f"{folder}/.{last}-{uuid.uuid4().hex}"
        self._write(temp, json.dumps(value))
        try:
            return self._publish(temp, name)
        finally:
            self._fs.delete(self.at(temp), False)

    def _write(self, name: str, text: str) -> None:
        self._fs.mkdirs(self.at(name).getParent())
        stream = self._fs.create(self.at(name), False)
        stream.write(bytearray(text.encode()))
        stream.close()

    def _publish(self, temp: str, name: str) -> bool:
        if self._mounted:
            try:
                os.link(self.at(temp).toUri().getPath(), self.at(name).toUri().getPath())
            except FileExistsError:
                return False
            return True
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.at(temp), self.at(name), none)
        except Exception:
            if self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str = "") -> None:
        self._fs.delete(self.at(name), True)

    def drop(self, path: str) -> None:
        """Delete a data folder by its whole path."""
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores; a scan of many files is left as it is.

    For rows that a Python stage is to read: a small file is one task otherwise.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back: the lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Stored:
    """A DataFrame written to the scratch folder: short lineage, safe from lost executors."""

    df: DataFrame
    path: str
    rows: int
    size: int
    weight: int = 0

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.size <= BROADCAST_BYTES and self.weight <= BROADCAST_WEIGHT


def _width(df: DataFrame):
    """The bytes of a row's values: strings by their length, arrays and maps by that of their text, others 8 each, and 16 for the row."""
    out = F.lit(16)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            out = out + 8 + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            out = out + 8 + F.coalesce(F.length(F.to_json(F.struct(f.name))), F.lit(0))
        else:
            out = out + 8
    return out


def store(df: DataFrame, name: str) -> Stored:
    """Write ``df`` to the scratch folder and read it back, with its rows and bytes (on disk, and if these are few in memory)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = int(fs.getContentSummary(at).getLength())
    if size > BROADCAST_BYTES:
        return Stored(back, path, back.count(), size)
    rows, weight = back.agg(F.count("*"), F.coalesce(F.sum(_width(back)), F.lit(0))).first()
    return Stored(back, path, rows, size, weight)


def bounded_join(big: DataFrame, small: Stored, on: list[str], how: str = "inner", spread: list[str] | None = None) -> DataFrame:
    """Join with a stored side: broadcast while its measured size allows it, salted beyond.

    ``spread`` names columns of ``big`` that tell the rows of one key apart. In
    the shuffled form each key of ``small`` is copied to ``SALTS`` salts, so a
    key that holds a large share of ``big`` goes to as many tasks.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if small.small:
        return big.join(F.broadcast(small.df), on, how)
    salt = "_salt"
    left = big.withColumn(salt, F.pmod(F.xxhash64(*(spread or big.columns)), F.lit(SALTS)).cast("int"))
    right = small.df.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*on, salt], how).drop(salt)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], salts: int = SALTS) -> DataFrame:
    """Inner join of two sides of any size on keys of which one may hold a large share of both.

    ``spread`` names columns of ``left`` that tell the rows of one key apart; a hot key's rows go to ``salts`` tasks, each with
    the key's rows of ``right``. For joins whose result holds all pairs of a key by definition.
    """
    salt = "_salt"
    a = left.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    b = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, salt]).drop(salt)


def content_hash(cols: list[str]) -> list:
    """Two 64-bit hashes of the columns in which null differs from every value."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in cols])
    return [F.xxhash64(nulls, *cols).alias("h1"), F.xxhash64(*reversed(cols), nulls).alias("h2")]


def instant_ms(col: str):
    """Epoch seconds or milliseconds as milliseconds: values from 1e11 on are milliseconds."""
    c = F.col(col)
    return F.when(F.abs(c) >= 100_000_000_000, c).otherwise(c * 1000)
