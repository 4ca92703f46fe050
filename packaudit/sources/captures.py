"""Image listings and inbox folders (S1, S2, T1). Pixels are never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp", "heic", "heif"]
FILE_COLS = ["path", "modificationTime", "length"]
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _wanted(path: Column, extensions: list[str]) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return ext.isin(*extensions) & name.contains(".") & ~name.startswith(".")


def _named(df: DataFrame, extensions: list[str]) -> DataFrame:
    return (df.select(*FILE_COLS).where(_wanted(F.col("path"), extensions))
            .withColumn("name", F.element_at(F.split("path", "/"), -1)))


def read_captures(spark: SparkSession, path: str, extensions: list[str] | None = None) -> DataFrame:
    """Image files of a folder by extension, without case (S1). File content is not selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    return _named(files, extensions or IMAGE_EXTENSIONS)


def stream_inbox(spark: SparkSession, path: str, archive: str, extensions: list[str] | None = None,
                 max_files: int = 10_000) -> DataFrame:
    """New files of a folder, each once; read files move to ``archive``.

    The archive must lie outside the folder. A file moves once the batch after its own
    has started; below the archive it keeps its source path, so names cannot collide.
    """
    files = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA)
             .option("cleanSource", "archive").option("sourceArchiveDir", archive)
             .option("maxFilesPerTrigger", max_files).load(path))
    return _named(files, extensions or IMAGE_EXTENSIONS)
