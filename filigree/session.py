"""Sessions, and tables that cut a lineage."""

from __future__ import annotations

import atexit
import logging
import re
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("filigree")
#: Tables that this process has made in the shared folder, and not removed.
_made: list[str] = []


def get_session(name: str = "filigree", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; ``conf`` has dots written as two underscores."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where none is set and all run in one process, a temporary one is.

    On a cluster a folder of the driver's machine would be another one on each executor's, so that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="filigree-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A place of its own in the shared folder; what is there goes when the driver ends."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


@atexit.register
def _clean() -> None:
    context, jvm = SparkContext._active_spark_context, SparkContext._jvm
    if jvm is None:
        return
    conf = context._jsc.hadoopConfiguration() if context is not None and context._jsc is not None else jvm.org.apache.hadoop.conf.Configuration()
    for path in _made:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:
            log.warning("%s is left", path)
            return


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and lost executors cost nothing.

    The shuffle files of the write are deleted at once, as what was written stands for them. Should a query of another thread have
    made some of these meanwhile, Spark makes them again when it misses them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    context = spark.sparkContext._jsc.sc()
    first = context.newShuffleId()
    df.write.parquet(path)
    for shuffle in range(first + 1, context.newShuffleId()):
        context.env().blockManager().master().removeShuffle(shuffle, False)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


#: Where the tables of `materialise` are.
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def remove(*tables: DataFrame) -> None:
    """Delete the files behind tables of `materialise` that nothing will read again; other tables stay."""
    for df in tables:
        path = _places.pop(df, None)
        if path is not None:
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
            _made.remove(path)
