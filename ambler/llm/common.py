"""Helpers shared by the operators: tables, shared storage, text batches, hashes.

Conventions that hold for every operator unless its docstring says otherwise:
a null text is the empty text, a null ``doc_id`` is a row like any other, rows
that repeat are separate rows, an empty table gives an empty result with the
same schema, and columns beyond those an operator needs are ignored.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows in one Arrow batch; bounds the memory of a Python worker when texts are long.
BATCH_ROWS = 512

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xBF58476D1CE4E5B9)
M3 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """What the operators rely on: the package on the executors, small Arrow batches."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only where the session names none and all
    tasks run on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ambler-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/ambler/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here and
    a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a table that ``materialise`` gave and nothing needs any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if "/ambler/" in f:
            delete(spark, f)


def tasks_for(df: DataFrame, each: int = 64 << 20) -> int:
    """Tasks for a shuffle of ``df`` by the planner's estimate of its bytes (of files, as they
    are stored), at least spark.sql.shuffle.partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(-(-size // each), 1 << 17)) if size < 1 << 60 else least  # no estimate


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, whatever its letters' case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """A broadcast hint only where the counted rows are within ``max_rows``;
    otherwise the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def smallest(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows whose ``doc_id`` has the smallest hash. Only rows below a bound that twice
    as many are expected under meet in one task."""
    n, hashed = rows.count(), F.xxhash64("doc_id")
    if n > 2 * most:
        rows = rows.filter(hashed < -(1 << 63) + (1 << 65) * most // n)
    return rows.orderBy(hashed, "doc_id").limit(most)


_caches: dict[str, list] = {}


def cache(owner: str, table: dict) -> dict:
    """Notes a table that an operator keeps in its Python workers between tasks."""
    _caches.setdefault(owner, []).append(table)
    return table


def only(owner: str) -> None:
    """Empties the tables of all other operators: workers are reused, and one that has run
    many operators would hold the tables of all."""
    others = [t for name, tables in _caches.items() if name != owner for t in tables if t]
    for t in others:
        t.clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # else what was freed stays with the worker
            libc.malloc_trim(0)


def groups(batches, most: int):
    """Batches put together to some ``most`` bytes each: the more words, the fewer new ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.nbytes
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def byte_texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection in which every input bit moves every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= M2
    h ^= h >> np.uint64(27)
    h *= M3
    h ^= h >> np.uint64(31)
    return h


def learn_fold(column: str = "doc_id"):
    """True for rows whose labels may be learned from: crc32 of the id as text, mod 3, is not 1."""
    return (F.crc32(F.col(column).cast("string").cast("binary")) % 3) != 1


def held_out(column: str = "doc_id"):
    return F.coalesce((F.crc32(F.col(column).cast("string").cast("binary")) % 3) == 1, F.lit(False))


def filter_rows(docs: DataFrame, owner: str, keep, *columns: str) -> DataFrame:
    """Rows of ``docs``, all columns as they are, for which ``keep`` says so: a function of
    the Arrow arrays of ``columns`` that gives one boolean a row; ``owner`` is its module. Nothing is shuffled."""
    places = [docs.columns.index(c) for c in columns]

    def run(batches):
        only(owner)
        for b in batches:
            yield b.filter(pa.array(keep(*(b.column(p) for p in places)), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
