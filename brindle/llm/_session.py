"""Reading tables, cutting lineage and size-checked joins."""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids broadcast at most: 2 million longs are 16 MB as rows, less than 100 MB hashed.
BROADCAST_IDS = 1_000_000
_written: dict[str, tuple[object, object]] = {}


_shipped: set[tuple[str, str]] = set()


@lru_cache(1)
def _folder() -> str:
    folder = tempfile.mkdtemp(prefix="brindle-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once for each application."""
    top = Path(__file__).resolve().parents[1]
    files = sorted(p for p in top.rglob("*.py"))
    mark = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    if (spark.sparkContext.applicationId, mark) in _shipped:
        return
    # the driver's own folder: it serves the file from there, and executors keep copies
    path = f"{_folder()}/{top.name}-{mark}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in files:
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add((spark.sparkContext.applicationId, mark))


def arrow(df: DataFrame, function: Callable, schema) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, one beside the warehouse, on one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-scratch"
    return named.rstrip("/")


#: Shuffle files of a finished write serve nobody: what it wrote is read from then on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs start from files
    that outlive executors.  The folder goes by ``free`` or when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = (where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where)
    out._brindle_path = path
    return out


def free(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote for these; nothing that is still to run may read them."""
    for df in cuts:
        fs, where = _written.pop(df._brindle_path)
        fs.delete(where, True)


def id_type(docs: DataFrame, id_col: str) -> str:
    return docs.schema[id_col].dataType.simpleString()


@atexit.register
def _clean() -> None:
    while _written:
        _, (fs, path) = _written.popitem()
        try:
            fs.delete(path, True)
        except Exception:  # the session has gone: nothing is left to ask
            return


def by_ids(docs: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of wide rows with narrow ids: ids are broadcast while their
    counted number is within BROADCAST_IDS, and shuffled beyond it."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, column, how)
