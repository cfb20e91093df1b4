"""Tables in the folder that the whole cluster shares.

Stages that are read more than once are written to ``spark.checkpoint.dir``
and read again, which cuts their lineage and survives lost executors. Only
where that setting is unset, and then only on a local master, a temporary
folder of this machine takes its place.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafloom.session import spread, table

_KEY = "spark.checkpoint.dir"
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: On a local file system Hadoop starts a process to set the rights of every file and folder that it makes, and one more for its
#: checksum file. Parquet's pages have checksums of their own, which reading verifies, and nobody looks for a mark of success.
_RAW = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
_UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_VERIFIED = {"parquet.page.verify-checksum.enabled": "true"}


def root(spark: SparkSession) -> str:
    """The shared folder."""
    found = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="leafloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts of ``documents``, on all cores."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


class HotKeys:
    """Keys with more than one part in ``PARTS`` of all rows, fewer than ``PARTS`` therefore, and a join that deals them out.

    ``keyed`` has a row for each key and its number of rows in ``weight``. Of two tables
    joined by the key, the rows of the larger one are dealt to parts by ``by``, as many as
    the key has parts of the whole, and the other's one row is copied to each.

    ``look`` finds the keys at once, which takes a job; most tables have none, and then
    the joins are plain ones. The driver keeps threads and code for each broadcast, so
    loops of joins do better to look; where ``keyed`` is dear, it is not made twice.
    """

    PARTS = 1000

    def __init__(self, keyed: DataFrame, keys: list[str], weight: str, total: int | None = None, look: bool = False) -> None:
        self.keys = keys
        total = total or keyed.agg(F.sum(weight)).first()[0] or 1
        hot = keyed.filter(F.col(weight) * self.PARTS > total)
        found = hot.select(*keys, F.ceil(F.col(weight) * self.PARTS / total).cast("long").alias("_parts"))
        rows = found.collect() if look else None
        self.any = rows is None or bool(rows)
        self.table = F.broadcast(found.sparkSession.createDataFrame(rows, found.schema) if rows else found)

    def _with_parts(self, df: DataFrame) -> DataFrame:
        return df.join(self.table, self.keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1).cast("long")))

    def join(self, many: DataFrame, one: DataFrame, by: list[str], keys: list[str] | None = None, how: str = "inner") -> DataFrame:
        """``many`` with ``one``; ``keys``, if others than the hot ones, include those."""
        if not self.any:
            return many.join(one, keys or self.keys, how)
        dealt = self._with_parts(many).withColumn("_part", F.pmod(F.xxhash64(*by), F.col("_parts"))).drop("_parts")
        copied = self._with_parts(one).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
        return dealt.join(copied, [*(keys or self.keys), "_part"], how).drop("_part")


class Workspace:
    """A folder of one run's intermediate tables and files; removed at exit, or table by table."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{root(spark)}/leafloom-{name}-{uuid.uuid4().hex}"
        if "://" not in self.path and not self.path.startswith("file:"):
            self.path = f"file://{self.path}"
        atexit.register(self.remove)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended; what is left is only space
            return

    def at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def _writing(self) -> dict[str, str]:
        own = self.spark.sparkContext._jsc.hadoopConfiguration().get("fs.file.impl")
        return _UNMARKED if own else _UNMARKED | _RAW

    def written(self, df: DataFrame, table: str, tidy: bool = False, few: bool = False) -> DataFrame:
        """Writes the rows and returns them as read again.

        ``tidy`` removes the shuffle files of the write at once, so nothing else may share
        them. ``few`` is for rows without texts: a task writes those of several partitions to one
        file, four files a core, however many shuffle partitions there are.
        """
        if few:
            df = df.coalesce(max(24, 4 * self.spark.sparkContext.defaultParallelism))
        before = self.spark.conf.get(_TIDY, None)
        if tidy:
            self.spark.conf.set(_TIDY, "true")
        try:
            df.write.mode("overwrite").options(**self._writing()).parquet(self.at(table))
        finally:
            if tidy:
                self.spark.conf.unset(_TIDY) if before is None else self.spark.conf.set(_TIDY, before)
        return self.spark.read.schema(df.schema).options(**_VERIFIED).parquet(self.at(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(self.at(table))

    def remove(self) -> None:
        self._delete(self.path)
