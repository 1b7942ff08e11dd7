"""What several operators of this subpackage use: shared tables and Arrow helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of a text are the runs of anything but these bytes (space, tab, LF, VT, FF, CR).
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one is made on this machine if
    Spark runs in this one process, as in tests; on a cluster that is an error, since executors can't see such a folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="corvid-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/corvid-{label}-{uuid.uuid4().hex}"


#: Spark's setting that removes the shuffle files of a query when it ends, instead of at the driver's next collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, codec: str = "zstd", options: dict | None = None) -> DataFrame:
    """Write df to the shared folder and read it again: lineage is cut and lost executors cost nothing.

    The shuffle files of the write go with its end, so that a job of many steps holds those of one step at a time."""
    spark = df.sparkSession
    path, before = fresh_path(spark, label), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**(options or {})).option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by stored() that no later step reads."""
    spark = df.sparkSession
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/corvid-" not in root:
            continue
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value, body):
    """Column: body(value) with value computed once and bound, however the optimiser moves the expression. A lambda that
    names a computed column instead may have that column's definition put in its place, for each element again."""
    return F.transform(F.array(value), body)[0]


def words(text):
    """Column: the words of a text in order (null text: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), lambda w: w != "")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row bounds of an Arrow string array (null: empty), without copying the text."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multiplications) over an array of unsigned integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(bounds: np.ndarray, most: int):
    """Row ranges whose bytes together stay near `most`; a longer row stands alone."""
    start, rows = 0, len(bounds) - 1
    while start < rows:
        end = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
        end = min(rows, max(end, start + 1))
        yield start, end
        start = end
