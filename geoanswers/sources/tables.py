"""Tables written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where the session names none, a temporary folder on a single machine and an error on a
    cluster, whose executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        path = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """The tables that one caller has stored: ``with Scratch(spark) as own`` takes note of what is stored inside, by this
    thread and by the operators it calls, and of nothing else. What is not discarded goes over to the caller's caller."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.token = _OWNER.set(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNER.reset(self.token)
        outer = _OWNER.get()
        if outer is not None:
            outer.paths += self.paths

    def mark(self) -> int:
        """A place in this caller's list."""
        return len(self.paths)

    def discard(self, till: int | None = None) -> None:
        """Delete the tables stored up to a place (None: all); nothing that is still to be read may depend on them."""
        gone, self.paths = self.paths[:till], self.paths[len(self.paths) if till is None else till :]
        for path in gone:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


_OWNER: ContextVar[Scratch | None] = ContextVar("owner", default=None)


def stored(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Written and read back: the lineage ends here, and lost executors take nothing along."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    write = df.write.option("compression", codec) if codec else df.write
    write.parquet(path)
    owner = _OWNER.get()
    if owner is not None:
        owner.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
