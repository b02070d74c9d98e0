"""The seen set as a bucketed table: a batch is joined to it where it lies, without moving the history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import insert_if_absent

SCHEMA = "unid string, ctime long, epoch long"


class SeenSet:
    """Keys seen so far (unid, ctime, epoch) in `buckets` buckets of unid, files below `path`, under a name in the catalog.

    A batch's firsts are dealt to the same buckets, so the join with the history needs no exchange on the history's side.
    Batches are numbered by an epoch: what an epoch has added counts as not yet seen when that epoch comes again, and
    is not added twice, so a replayed batch gives the same rows and changes nothing.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        if not spark.catalog.tableExists(name):
            self._write(spark.createDataFrame([], SCHEMA))

    def _write(self, rows: DataFrame) -> None:
        """One file for each bucket that has new keys."""
        dealt = rows.select("unid", F.col("ctime").cast("long").alias("ctime"), F.col("epoch").cast("long").alias("epoch")).repartition(self.buckets, "unid")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "unid").sortBy("unid").option("path", self.path).saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, keys: DataFrame, epoch: int = -1) -> None:
        """Adds (unid, ctime), a row for each unid that is not in the set."""
        self._write(keys.withColumn("epoch", F.lit(epoch)))

    def mark(self, batch: DataFrame, order: tuple[str, ...] = ("ctime",), epoch: int | None = None) -> DataFrame:
        """`batch` with (inserted, seen_ctime), as insert_if_absent; what `epoch` itself has added is not counted."""
        history = self.rows() if epoch is None else self.rows().where(F.col("epoch") != epoch)
        return insert_if_absent(batch, history.select("unid", "ctime"), order, buckets=self.buckets)

    def insert(self, batch: DataFrame, epoch: int, order: tuple[str, ...] = ("ctime",)) -> DataFrame:
        """Marks a batch and adds its new keys under its epoch, unless a run before has added them."""
        marked = self.mark(batch, order, epoch)
        if not self.rows().where(F.col("epoch") == epoch).limit(1).count():
            self.add(marked.where("inserted AND unid IS NOT NULL").select("unid", F.col("seen_ctime").alias("ctime")), epoch)
            self.spark.catalog.refreshTable(self.name)
            marked = self.mark(batch, order, epoch)
        return marked

    def sink(self, out: str, order: tuple[str, ...] = ("ctime",)):
        """A foreachBatch function that writes each batch's inserted rows to a folder of its epoch, the same after a replay."""
        def write(batch: DataFrame, epoch: int) -> None:
            self.insert(batch, epoch, order).where("inserted").drop("inserted").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

        return write

    def drop(self) -> None:
        """Takes the name out of the catalog; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
