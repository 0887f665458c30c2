"""Small helpers shared by the operators: word patterns, tables written to the
shared folder, and file access from tasks."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.session import checkpoint_dir

#: A word is a maximal run of code points other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
BLANK_CHARS = " \t\n\x0b\f\r"


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return posixpath.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")


#: Spark deletes the shuffle files of a statement at its end.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: cuts
    the lineage, survives lost executors, keeps a used-twice frame from being
    computed twice. With ``release`` the shuffles of the write end with it."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    if release:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote, once what was made of it is written itself."""
    files = table.inputFiles()
    if files:
        fs, at = local_filesystem(posixpath.dirname(files[0]))
        fs.delete_dir(at)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nobody holds any more;
    it does so once the driver has collected its garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Array of the words of a text; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    """Number of words without building the array."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often
    ``body`` and the lambdas inside it refer to it."""
    return F.transform(F.array(value), body)[0]


def id_text(col: Column) -> Column:
    """The decimal text of an id, whose crc32 decides the folds."""
    return F.coalesce(col.cast("string"), F.lit(""))


def fold(col: Column, modulus: int) -> Column:
    """crc32(id as text) mod ``modulus``."""
    return F.crc32(id_text(col).cast("binary")) % F.lit(modulus)


def local_filesystem(uri: str):
    """A pyarrow filesystem and path for a folder every machine shares; tasks
    write and read their files through it (file, hdfs, s3, gs, ...)."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    elif uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, wherever they run: one zip in
    the shared folder, added once per application."""
    import io
    import os
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    folder = shared_path(spark, "package")
    fs, at = local_filesystem(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/eventfold.zip") as out:
        out.write(blob.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/eventfold.zip")
    _shipped.add(app)
