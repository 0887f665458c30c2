"""Session helpers: configuration that the operators rely on, and the shared
folder for lineage cuts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job here assumes; a cluster may override the sizes.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keep the Python state server of stateful streaming off TCP
    "spark.python.unix.domain.socket.enabled": "true",
    # checkpoints of frames that nobody holds any more are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "eventfold", shuffle_partitions: int | None = None,
                extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    """A session with the settings above. ``driver_memory`` matters in local
    mode only, where the driver JVM runs every task; it takes effect when this
    call starts the JVM."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only when the
    session names none and runs in local mode (one machine, no cluster) is a
    folder of this machine used; on a cluster an unset setting is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if fallback is None and spark.sparkContext.master.startswith("local"):
            import tempfile
            fallback = tempfile.mkdtemp(prefix="eventfold-ckpt-")
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder all executors share")
        d = fallback
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: For jobs that hand wide rows to Python and store them. Times are written as long integers (the default form, of twelve
#: bytes, takes half of a write's time). Spark sizes every column of a batch anew after each row to keep its bytes limited,
#: which takes most of the time of handing rows over: here a batch is limited by its rows alone, to a fifth of the usual number.
BULK_CONF = {"spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
             "spark.sql.execution.arrow.maxBytesPerBatch": str((1 << 31) - 1),
             "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def bulk(spark: SparkSession) -> Iterator[None]:
    """The session with ``BULK_CONF`` while a job runs; afterwards it is as before."""
    before = {k: spark.conf.get(k, None) for k in BULK_CONF}
    for k, v in BULK_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back: a lineage cut of which later
    readers take only the columns that they need."""
    import posixpath
    import uuid

    spark = df.sparkSession
    path = posixpath.join(checkpoint_dir(spark), f"{label}-{uuid.uuid4().hex}")
    with bulk(spark):
        df.write.option("compression", "lz4_raw").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


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
    import posixpath
    import uuid
    import zipfile

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    folder = posixpath.join(checkpoint_dir(spark), f"package-{uuid.uuid4().hex}")
    fs, at = local_filesystem(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/eventfold.zip") as out:
        out.write(blob.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/eventfold.zip")
    _shipped.add(app)
