"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers
    can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="symlattice-code-"), "symlattice.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("symlattice", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(to)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one is made and set on a single
    machine, and on a cluster, whose machines share no temporary folder, it is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="symlattice-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed at the end of the Scratch around it, if there is one,
    and in any case when the session's process ends."""
    path = f"{shared_folder(spark)}/symlattice/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    if open_ := _scratches.get():
        open_[-1].paths.append(path)
    return path


_scratches: ContextVar[tuple[Scratch, ...]] = ContextVar("scratches", default=())


class Scratch:
    """The tables that are cut within `with Scratch(spark) as s` are removed at its end, but for those that
    s.keep() names: an operator whose result rests on one written table leaves nothing else behind."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.token = spark, [], None

    def __enter__(self) -> Scratch:
        self.token = _scratches.set((*_scratches.get(), self))
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        """df, a cut() table, which now belongs to what is around this."""
        files = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        kept = [p for p in self.paths if p.rpartition("/")[2] in files]
        self.paths = [p for p in self.paths if p not in kept]
        if outer := _scratches.get()[:-1]:
            outer[-1].paths += kept
        return df

    def __exit__(self, *error) -> None:
        _scratches.reset(self.token)
        for p in self.paths:
            _remove(self.spark, p)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Plans made within send Python workers at most so many rows at a time (None: as the session says)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if rows is not None and (int(before) <= 0 or int(before) > rows):
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a file, where a bound on the rows of a table is known.
FILE_ROWS = 50_000


def cut(df: DataFrame, name: str = "stage", batch_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """df, written once as Parquet to the shared folder and read back. batch_rows bounds what Python workers
    get at a time where rows are long; rows is a bound on df's rows that is known, so that a small table
    is few files and not one for each shuffle partition.

    Unlike localCheckpoint() the rows outlive the executors that made them, and unlike
    cache() no later loss makes Spark compute them again.
    """
    ship(df.sparkSession)
    path = staged_path(df.sparkSession, name)
    df = df if rows is None else df.coalesce(rows // FILE_ROWS + 1)
    with batches_of(df.sparkSession, batch_rows):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows, and bytes of Parquet, of a table that is sent to every executor; larger ones are joined by a shuffle.
SENT_ROWS, SENT_BYTES = 1_000_000, 32 << 20


def sent(table: DataFrame) -> DataFrame:
    """A cut() table as the side of a join: broadcast if its files and rows are checked to be few, else as it is."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    size = 0
    for f in table.inputFiles():
        p = jvm.org.apache.hadoop.fs.Path(f)
        size += p.getFileSystem(conf).getFileStatus(p).getLen()
        if size > SENT_BYTES:
            return table
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def drop_staged(df: DataFrame) -> None:
    """Removes the files of a cut() table that nothing will read again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/symlattice/" in folder:
            _remove(df.sparkSession, folder)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone at exit
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
