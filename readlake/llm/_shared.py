"""Helpers that the text operators share: scratch tables, blocks of documents, and bucketed exchanges of packed keys.

Documents are packed into *blocks*: one row holds some megabytes of whole texts (compressed) and their ids.  Passes over the
corpus then exchange compact per-block arrays of 64-bit keys instead of one row per word: each block sends the sorted distinct
keys of a hash range (a *bucket*) as one binary value, so copies inside a block are combined before the shuffle, and a key that
occurs in every document arrives at most once per block.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id inside numpy arrays; null ids sort after all others.
NO_ID = np.iinfo(np.int64).max
BATCH_ROWS = 500
BLOCK_SCHEMA = "block bigint, ids array<bigint>, sizes array<int>, body binary"


class Scratch:
    """Intermediate tables in the shared folder named by spark.checkpoint.dir; where that is unset, an error, but for local masters.

    path, if given, is the folder of the tables instead.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        if path is not None:
            self.path = path
            return
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            root = spark.sparkContext.getCheckpointDir()
        if root is None and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            root = tempfile.mkdtemp(prefix="readlake-")  # one machine holds the driver and all tasks
            spark.sparkContext.setCheckpointDir(root)
        if root is None:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.path = f"{root.rstrip('/')}/readlake-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write df (in folders by a column, if named) and read it back, which cuts its lineage; the shuffle files of the finished job are removed.

        Rows reach Python in batches of BATCH_ROWS at most, since a row may hold the shingles of a document or a block of texts.
        """
        settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
        before = {key: self.spark.conf.get(key, None) for key in settings}
        for key, value in settings.items():
            self.spark.conf.set(key, value)
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(f"{self.path}/{name}")
        finally:
            for key, value in before.items():
                self.spark.conf.unset(key) if value is None else self.spark.conf.set(key, value)
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Names a row for as long as one table of keyed_rows is used; ids may be null or repeated.
ROW = "__row"
#: Tables of at most so many keys (some 16 MB) are broadcast, larger ones are joined by a shuffle.
FEW_KEYS = 1_000_000
#: Tables of more files get their row keys written instead.
MANY_FILES = 50_000


def keyed_rows(docs: DataFrame) -> DataFrame:
    """docs with a bigint column ROW that names each row, the same at every later read.

    Rows of a Parquet table are named by file and place in it, as they were written; any other DataFrame is written once with its keys.
    """
    spark = docs.sparkSession
    try:
        # above a join or an explode one row of a file may be several
        found = docs.select("_metadata.file_path", "_metadata.row_index") if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation" else None
    except AnalysisException:  # of these sources only Parquet numbers its rows
        found = None
    if found is None:
        return Scratch(spark).table(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    files = sorted(r.file_path for r in found.select("file_path").distinct().limit(MANY_FILES + 1).collect())
    if len(files) > MANY_FILES:
        return Scratch(spark).table(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    numbers = spark.createDataFrame(list(enumerate(files)), "__file bigint, __path string")
    rows = docs.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.row_index").alias("__at")).join(F.broadcast(numbers), "__path")
    return rows.select(*docs.columns, (F.shiftleft("__file", 40) + F.col("__at")).alias(ROW))


def keeping_names(f: Callable) -> Callable:
    """For functions of docs that use keyed_rows and return rows of docs: columns of docs that have a name used here are renamed meanwhile."""

    @wraps(f)
    def run(docs: DataFrame, *args, **how) -> DataFrame:
        taken = {c: f"{c}_{uuid.uuid4().hex}" for c in docs.columns if c.lower() in (ROW, "__file", "__path", "__at")}
        return f(docs.withColumnsRenamed(taken), *args, **how).withColumnsRenamed({b: a for a, b in taken.items()}) if taken else f(docs, *args, **how)

    return run


def without(rows: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """rows without those whose ROW is in gone, and without ROW; texts are shuffled only if gone is large."""
    gone = scratch.table(gone.select(ROW), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= FEW_KEYS else gone, ROW, "left_anti").drop(ROW)


def bucket_count(spark: SparkSession) -> int:
    """Hash ranges of an exchange: some for each shuffle partition, so that it scales with the cluster's own setting."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def pack(docs: DataFrame, id_col: str, text_col: str, target: int, sketch: Callable | None = None, fields: str = "") -> DataFrame:
    """Blocks of about target bytes of whole texts; null texts count as empty.

    sketch(body, sizes, ids) returns a dict of extra columns declared by fields (DDL).
    """
    schema = BLOCK_SCHEMA + (f", {fields}" if fields else "")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("text"))
    arrow = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:

        squeeze = zstandard.ZstdCompressor(level=3)
        first = TaskContext.get().partitionId() << 24
        count = 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def emit():
            nonlocal count, ids, texts, held
            body, sizes = b"".join(texts), np.fromiter(map(len, texts), np.int32, len(texts))
            extra = sketch(body, sizes, np.array([NO_ID if x is None else x for x in ids], np.int64)) if sketch else {}
            cols = {"block": [first + count], "ids": [ids], "sizes": [sizes], "body": [squeeze.compress(body)]} | {k: [v] for k, v in extra.items()}
            count, ids, texts, held = count + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow_schema], schema=arrow_schema)

        arrow_schema = pa.schema([pa.field(n, t) for n, t in arrow])
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and held + len(text) > target:
                    yield emit()
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield emit()
        release()

    from pyspark.sql.types import StructType

    arrow = [(f.name, _arrow_type(f.dataType)) for f in StructType.fromDDL(schema)]
    return rows.mapInArrow(run, schema)


def _arrow_type(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def unpack(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body)


def ids_of(values: list) -> np.ndarray:
    return np.array([NO_ID if x is None else x for x in values], np.int64)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A random 64-bit value for each byte.
BYTE_VALUES = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64)


def word_places(body: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+ of texts that follow each other in body."""
    data = np.frombuffer(body, np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a text starts here
    edge[0] = True
    edge[np.cumsum(sizes)] = True
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1] | edge[1:-1]
    last[:-1] &= space[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_hashes(body: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that follow each other in body, and the number of words of each."""
    start, end = word_places(body, sizes)
    hashes = mix(Ranges(BYTE_VALUES[np.frombuffer(body, np.uint8)]).of(start, end) + (end - start).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)])))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Ranges:
    """Hashes of any range of a sequence of 64-bit values: differences of a running polynomial sum modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Ranges._powers[0]) <= n:
            Ranges._powers = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n + n // 4 + 1, b, np.uint64))]) for b in (self.BASE, self.INVERSE))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Ranges._powers[0][:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * Ranges._powers[1][start]


def cut(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted keys: the buckets that occur, and the bounds of their slices."""
    of = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    starts = np.flatnonzero(np.diff(of, prepend=np.uint64(buckets)))
    return of[starts].astype(np.int64), np.append(starts, len(keys))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def release() -> None:
    """Give memory back to the machine at the end of a task: Python workers wait for the next one beside the executor's own memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def spans_to_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n places some half-open span covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0
