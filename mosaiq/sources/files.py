"""Files as sources and sinks."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaiq.functions.quality import extension, mime

#: Extensions of image files that are scanned.
IMAGES = (
    "jpg jpeg jpe jfif png gif bmp dib webp tif tiff heic heif avif jp2 j2k raw dng cr2 cr3 nef arw orf rw2 raf pef srw ico svg psd tga jxl"
).split()
FILE = "path string, modificationTime timestamp, length bigint"


def scan_files(spark: SparkSession, root: str, extensions: list[str] | None = None, content: bool = False) -> DataFrame:
    """``path, size, modified_at, ext, mime`` (and ``content``) of all files under a folder with one of the extensions,
    in any case. Without ``content`` no file is read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    cols = [F.col("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), extension(F.col("path")).alias("ext"), mime(F.col("path")).alias("mime")]
    out = f.select(*cols, *([F.col("content")] if content else []))
    return out.where(F.col("ext").isin([e.lower() for e in (extensions or IMAGES)]))


def open_file(path: str) -> BinaryIO:
    """A file by the path that ``scan_files`` gives it, to be read from where the task runs."""
    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    scheme, rest = path.split("://", 1)
    host, _, name = rest.partition("/")
    where, root = fs.FileSystem.from_uri(f"{scheme}://{host}/")
    return where.open_input_file(f"{root.rstrip('/')}/{name}")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with a given schema: nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``id, path`` of tab-separated lines; blank lines are left out."""
    f = spark.read.text(path).where(F.trim("value") != "")
    p = F.split("value", "\t", 2)
    return f.select(p[0].cast("bigint").alias("id"), p[1].alias("path"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", False).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame) -> str:
    """A report as a Markdown table, all of its rows. The caller knows that it is small."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.toLocalIterator())])


def save_index(vectors: DataFrame, root: str) -> str:
    """A new version of an index under ``root``; older ones stay readable until they are removed."""
    path = f"{root}/index-{uuid.uuid4().hex}"
    vectors.write.parquet(path)
    return path


def newest_index(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version under ``root``, by the time of its success mark; None if there is none."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(f"{root}/index-*/_SUCCESS")
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marks = fs.globStatus(base) or []
    best = max(((m.getModificationTime(), m.getPath().getParent().toString()) for m in marks), default=None)
    return spark.read.parquet(best[1]) if best else None


def export_files(spark: SparkSession, files: DataFrame, target: str) -> DataFrame:
    """``source, target, ok, error``: copies of the files (path) into a folder, in parallel; a file that can't be copied
    gives a row with its error. Names get the path's hash, so equal names don't meet."""
    conf = "source string, target string, ok boolean, error string"
    rows = files.select("path").where("path is not null").distinct()

    def copy(batches):
        import os
        import shutil

        import pandas as pd

        for p in batches:
            out = []
            for src in p.path:
                local = src.removeprefix("file:")
                local = "/" + local.lstrip("/")
                stem, ext = os.path.splitext(os.path.basename(local))
                dst = os.path.join(target, f"{stem}-{uuid.uuid5(uuid.NAMESPACE_URL, src).hex[:8]}{ext}")
                try:
                    os.makedirs(target, exist_ok=True)
                    shutil.copyfile(local, dst)
                    out.append((src, dst, True, None))
                except OSError as e:
                    out.append((src, dst, False, type(e).__name__))
            yield pd.DataFrame(out, columns=["source", "target", "ok", "error"])

    return rows.mapInPandas(copy, conf)
