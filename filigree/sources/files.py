"""Results out, results in, and tables kept under a hash of what made them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.config import Config
from filigree.session import shared_dir


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a row; infinities and NaN are null."""
    safe = [F.when((F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*safe).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None, whole: bool = False) -> DataFrame:
    """Lines of JSON, or ``whole`` documents."""
    reader = spark.read.option("multiLine", whole)
    return (reader.schema(schema) if schema else reader).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def state_of(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of all files under ``path``; of nothing if it isn't there."""
    found, p = [], spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if path and system.exists(p):
        files = system.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(found)).encode()).hexdigest()


def kept(spark: SparkSession, what: str, config: Config, made: Callable[[], DataFrame], of: str | None = None) -> DataFrame:
    """The table ``what`` of these settings, and of the files under ``of`` as they are now: read if it has been written whole, else made and written."""
    path = f"{shared_dir(spark)}/kept/{config.key()}{'-' + state_of(spark, of) if of else ''}/{what}"
    if not exists(spark, f"{path}/_SUCCESS"):
        made().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def projected(embs: DataFrame, k: int = 2, emb: str = "emb") -> DataFrame:
    """``embs`` with ``x0, x1, ...``: the first ``k`` principal components, to be drawn; their signs are arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = embs.withColumn("_v", array_to_vector(F.col(emb).cast("array<double>")))
    out = PCA(k=k, inputCol="_v", outputCol="_p").fit(d).transform(d).withColumn("_a", vector_to_array("_p"))
    return out.select(*embs.columns, *[F.col("_a")[i].alias(f"x{i}") for i in range(k)])
