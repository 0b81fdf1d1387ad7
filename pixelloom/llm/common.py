"""Helpers that the operators of this subpackage share.

Intermediate results that are needed twice go to Parquet tables in the shared folder
that the cluster names in ``spark.checkpoint.dir``; executors may be lost at any time and
the tables stay readable.  Nothing here keeps data in a machine's own folder unless the
setting is missing (local tests).
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words, as a Java/Python character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_root: dict[int, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir``, else (local master only) one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    key = id(spark.sparkContext)
    if key not in _own_root:
        folder = tempfile.mkdtemp(prefix="pixelloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_root[key] = f"file://{folder}"
    return _own_root[key]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._pixelloom_path = path  # for drop_stored
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for t in tables:
        path = getattr(t, "_pixelloom_path", None)
        if path:
            delete_path(t.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have (names are compared without case)."""
    have = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in have:
        k += 1
        name = f"{base}_{k}"
    return name


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(df: DataFrame, name: str) -> Column:
    return df[q(name)]


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def tidied(run):
    """A map over Arrow batches whose worker gives freed memory back to the system when it ends.

    Workers live on between tasks, and both allocators otherwise keep what a task has freed.
    """

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
