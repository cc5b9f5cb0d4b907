"""The shared folder for intermediate tables."""

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"

# The folders of the blocks that each thread is in.
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir.

    Where that is unset, a folder below the session's warehouse, which a cluster
    shares as well; no machine's own temporary folder is ever used.
    """
    folder = spark.conf.get(_SETTING, None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts the lineage at a place that survives lost executors, makes later
    readers agree on one version, and gives the optimizer the table's true size,
    so that it broadcasts it only when it is small. Within ``intermediate`` the table is
    removed at the end of the block; otherwise it stays, since results may read it.
    """
    path = new_folder(df.sparkSession, name)
    for folders in getattr(_open, "blocks", [])[-1:]:
        folders.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A table without rows that the optimizer knows to be empty, so a join with it moves nothing."""
    nothing = spark.range(1).filter(F.lit(False))
    return nothing.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def at_once(*steps: Callable) -> list:
    """The results of steps that do not need each other, run side by side; all have ended when one's error goes on.

    Small tables cost the time to plan a job, not to run it, and that time passes for all at once.
    """
    blocks, results, errors = getattr(_open, "blocks", []), {}, []

    def run(place: int, step: Callable) -> None:
        _open.blocks = blocks
        try:
            results[place] = step()
        except BaseException as error:
            errors.append(error)

    threads = [InheritableThread(target=run, args=(place, step)) for place, step in enumerate(steps)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    if errors:
        raise errors[0]
    return [results[place] for place in range(len(steps))]


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """A block whose settled tables are deleted at its end; results have to be written within it."""
    if not hasattr(_open, "blocks"):
        _open.blocks = []
    _open.blocks.append(folders := [])
    try:
        yield
    finally:
        _open.blocks.pop()
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
