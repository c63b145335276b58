"""What the corpus operators share: reading tables, per-row Arrow maps, vectorised words and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once by the vectorised kernels; bounds the memory of a Python worker.
CHUNK = 1 << 20
#: Folders written in this process, for `clean`.
_written: list[str] = []


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bounds the Arrow batches of the session: rows hold whole texts, and a worker holds several batches' worth."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session (tests) may do without, and gets one of the machine's own."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "quillrank-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(where)
    return where


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors. It stays until `clean`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(df: DataFrame) -> DataFrame:
    """`written`, with the shuffle files of the write deleted as it ends instead of when the driver happens to collect its garbage. `drop` deletes the table."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        out = written(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
    out._written_at = _written[-1]
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of `lean` that nothing will read any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _written.remove(t._written_at)


def clean(spark: SparkSession) -> int:
    """Deletes every table that this process has written here; for the end of a job, when its results are written. How many there were."""
    n, jvm = 0, spark.sparkContext._jvm
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def annotate(df: DataFrame, inputs: list[str], fields: list[tuple[str, str]], start: Callable[[], Callable], slice_bytes: int | None = None) -> DataFrame:
    """df with the columns `fields` (name, DDL type) appended, in one narrow Arrow pass.

    start() is called once a task and returns f(*arrays) -> list of Arrow arrays. Names in
    `fields` that df has already come out with leading underscores (see fresh). With slice_bytes,
    batches are worked on and sent back in slices of so many bytes of the first input (a longer text alone).
    """
    names = df.columns
    out = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        out.add(fresh(out.fieldNames(), name), T.DataType.fromDDL(kind))
    at = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for whole in batches:
            cuts = chunks(utf8(whole.column(at[0]))[1], slice_bytes) if slice_bytes else [(0, whole.num_rows)]
            for i, j in cuts:
                batch = whole.slice(i, j - i) if slice_bytes else whole
                made = step(*[batch.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=out.fieldNames())
        del step
        trim()

    return df.mapInArrow(run, out)


def trim() -> None:
    """Gives freed memory back to the system: worker processes live on from task to task beside the executor's own heap."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def per_process(key: tuple, make: Callable):
    """make() once for each Python worker process, which Spark uses for many tasks."""
    import sys
    import types

    held = sys.modules.setdefault("_quillrank_worker", types.ModuleType("_quillrank_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an Arrow array in one uint8 array, and where each string starts and ends. Null: empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks() if arr.num_chunks != 1 else arr.chunk(0)
    if arr.null_count:
        arr = pc.fill_null(arr, pa.scalar("", arr.type) if not pa.types.is_null(arr.type) else "")
    if pa.types.is_null(arr.type):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, offs, data = arr.buffers()
    if offs is None or not len(arr):
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    ends = np.frombuffer(offs, np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, ends - ends[0]


def chunks(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of strings of at most `size` bytes together; a longer string stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> _S32)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S32)


def _word_table() -> np.ndarray:
    """Lower-cases A-Z; bytes that are in no word become 0. Words are runs of 0-9, a-z and every byte over 0x7F."""
    lut = np.zeros(256, np.uint8)
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        if 48 <= low <= 57 or 97 <= low <= 122 or low > 127:
            lut[b] = low
    return lut


WORD_TABLE = _word_table()
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def load8(padded: np.ndarray) -> np.ndarray:
    """View with element i the eight bytes from i on, first byte lowest; `padded` has eight bytes more than texts."""
    return np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))


def hash_spans(eight: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    h = mix(lens.astype(np.uint64) + np.uint64(seed))
    at, done = np.arange(len(starts)), 0
    if len(at) and lens.min() > 0:
        h, done = mix(h ^ (eight[starts] & _MASKS[np.minimum(lens, 8)])), 8
    while len(at):
        left = lens[at] - done
        more = left > 0
        if not more.all():
            at, left = at[more], left[more]
        if not len(at):
            break
        h[at] = mix(h[at] ^ (eight[starts[at] + done] & _MASKS[np.minimum(left, 8)]))
        done += 8
    return h


def words(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, its length, first word of each text and one more, lower-cased padded bytes)."""
    low = np.zeros(len(flat) + 8, np.uint8)
    np.take(WORD_TABLE, flat, out=low[: len(flat)])
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64), low
    inside = low[: n + 1] != 0
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    cut = offs[:-1][offs[:-1] < n]
    begin[cut] = inside[cut]
    end = inside[:n] & ~inside[1 : n + 1]
    cut = offs[1:][offs[1:] > 0] - 1
    end[cut] = inside[cut]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, offs)
    return hash_spans(load8(low), starts, ends - starts), starts, ends - starts, first, low


def shingles(word_hashes: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside each text, and where each text's begin. A text of fewer words, but not none, has one shingle of all."""
    count = np.diff(first)
    run = np.zeros(max(0, len(word_hashes) - n + 1), np.uint64)
    for k in range(n):
        run = mix(run ^ word_hashes[k : k + len(run)]) if len(run) else run
    keep = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(keep)])
    out = np.zeros(begin[-1], np.uint64)
    long = np.flatnonzero(count >= n)
    if len(long):
        take = ranges(first[long], keep[long])
        out[ranges(begin[long], keep[long])] = run[take]
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = np.uint64(count[d])
        for w in word_hashes[first[d] : first[d + 1]]:
            h = mix(np.array([h ^ w], np.uint64))[0]
        out[begin[d]] = h
    return out, begin


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each range, joined."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lens > 0
    starts, lens = np.asarray(starts, np.int64)[keep], lens[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    heads = np.cumsum(lens)[:-1]
    step[heads] = starts[1:] - (starts[:-1] + lens[:-1] - 1)
    return np.cumsum(step)


def n_batches(df: DataFrame, text_col: str, target: int, least: int) -> int:
    """How many batches of about `target` bytes of text df makes (one column is read; one row comes back)."""
    total = df.agg(F.sum(F.octet_length(text_col)).alias("b")).first()["b"] or 0
    return max(least, int(total // target) + 1)
