"""Facts that arrive file by file: each micro-batch replaces what the files it names had before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symlattice.sources.facts import columns_of, replace_file


class FileIngest:
    """Keeps one fact table that has a file column, in a folder of its own; use apply as a foreachBatch function.

    A batch holds whole files: the rows of every file in it replace the stored ones. Each batch writes the
    table anew as folder/<epoch>, complete once its _SUCCESS is there; a batch that is delivered again, or
    a run that starts again from its checkpoint, goes on from the newest complete version. The version
    before stays for readers, older ones go.
    """

    def __init__(self, spark: SparkSession, table: str, folder: str, column: str = "file_id"):
        self.spark, self.table, self.folder, self.column = spark, table, folder.rstrip("/"), column
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    @property
    def current(self) -> DataFrame:
        have = self.versions()
        schema = columns_of(self.table)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{have[-1]}") if have else self.spark.createDataFrame([], schema)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        have = self.versions()
        if have and have[-1] >= epoch:
            return
        old = self.current
        rows = batch.select(old.columns)
        files = rows.select(rows[self.column].alias("id")).distinct()
        replace_file(old, rows, files, self.column).write.mode("overwrite").parquet(f"{self.folder}/{epoch}")
        for v in self.versions()[:-2]:
            self._fs.delete(self._path(f"{self.folder}/{v}"), True)

    def run(self, stream: DataFrame, checkpoint: str):
        """Starts the query over a stream of facts; it ends when all that is there has been read."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
