"""Small helpers over the Hadoop file system, so that paths may live on any storage Spark reads."""

from __future__ import annotations

import re
import time
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Beside the files of a staged index: the box of each.
FILE_BOXES = "_boxes"
#: Scheme and authority of a qualified path.
SCHEME = "^[a-z0-9]+:(//[^/]*)?"


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme and authority, as file listings give it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def bare_text(path: str) -> str:
    """A qualified path without scheme and authority."""
    return re.sub(SCHEME, "", path)


def unescaped(name: str) -> str:
    """The value that a partition folder's name stands for."""
    return unquote(name)


def escaped(name: str) -> str:
    """A plain name as a path pattern that means itself."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def bare(path: Column) -> Column:
    return F.regexp_replace(path, SCHEME, "")


def decoded(path: Column) -> Column:
    """A file's name as scans give it (an escaped address) as a plain path."""
    return F.url_decode(F.replace(bare(path), F.lit("+"), F.lit("%2B")))


def read_with_text_ids(spark: SparkSession, path: str, name: str = "collection_id") -> DataFrame:
    """A table partitioned by ``name``, whose folder names stay text: ids such as 007 or 2024-01-01 are no numbers or dates."""
    found = spark.read.parquet(path).schema
    if name not in found.names:
        return spark.read.parquet(path)
    typed = T.StructType([T.StructField(f.name, T.StringType() if f.name == name else f.dataType) for f in found])
    return spark.read.schema(typed).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``; empty when it does not exist."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p))


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small control file, or None."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small control file: write beside it, then rename over it."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = target.getFileSystem(conf)
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    move_over(spark, path + ".tmp", path)


def move_over(spark: SparkSession, source: str, target: str) -> None:
    """Rename one file over another."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = dst.getFileSystem(conf)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(src), fs.makeQualified(dst), options)


def copy_over(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file beside another, then rename it over that."""
    fs, src = _fs(spark, source)
    to, draft = _fs(spark, f"{target}.tmp")
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, to, draft, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"could not copy {source} to {target}")
    move_over(spark, f"{target}.tmp", target)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a file or folder to a free name."""
    fs, src = _fs(spark, source)
    if not fs.rename(src, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"could not move {source} to {target}")


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small control file unless there is one; False if there is."""
    fs, p = _fs(spark, path)
    try:
        stream = fs.create(p, False)
    except Exception as error:  # Py4JJavaError; its Java class tells what happened
        if "FileAlreadyExists" in str(error):
            return False
        raise
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    return True


class Lease:
    """Mutual exclusion by a file that only one process can create.

    A lease that has not been given back after ``seconds`` (its holder died) is moved aside, which again succeeds for
    one process only, and then taken anew.
    """

    def __init__(self, spark: SparkSession, path: str, seconds: float = 6 * 3600):
        self.spark, self.path, self.seconds, self.owner = spark, path, seconds, uuid.uuid4().hex

    def __enter__(self) -> Lease:
        for _ in range(2):
            if create_new(self.spark, self.path, f"{self.owner} {time.time()}"):
                return self
            held = (read_text(self.spark, self.path) or "").split()
            if len(held) == 2 and time.time() - float(held[1]) > self.seconds:
                aside = f"{self.path}.{self.owner}"
                try:
                    move(self.spark, self.path, aside)
                except Exception:
                    continue  # another process was faster
                remove(self.spark, aside)
        raise RuntimeError(f"another publication holds {self.path}")

    def __exit__(self, *_error) -> None:
        if (read_text(self.spark, self.path) or "").startswith(self.owner):
            remove(self.spark, self.path)
