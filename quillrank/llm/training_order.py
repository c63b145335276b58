"""Token sequences in training order, in fixed-stride shards.

Token ids (16 bits) are cut into sequences of `length` ids. Every sequence has a dense index, and
a keyed Feistel permutation with cycle-walking turns it into a global slot: a permutation of
0..n-1 that needs no table. Slots are dealt by range: shard k holds the slots from k * slots on,
as one block of records of a fixed stride, so the record of a slot lies at a computed place, and
neighbouring shards are range partitions: a file holds consecutive shards in order, so a sequential
read from any slot (in_order) touches one file after another and resumes where it stopped. The
indices come from a written table, so they stay when an executor is lost and its work is done again.

Record: id of the document (8 bytes, signed), part (4), ids in use (2), 2 unused, then `length`
ids of 2 bytes, little-endian, zeros behind the last one.

Defined results: null and empty texts make no sequence; a null document id is stored as the
smallest 64-bit integer and read back as null; repeated rows make sequences of their own; an empty
table makes no shard. Texts are taken whole, in as many parts as they need.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import chunks, mix, shared_dir, table, trim, utf8, written
from quillrank.llm.sentencepiece_codec import SLICE, codec_starter, default_model

LENGTH, SLOTS, KEY, ROUNDS = 2048, 512, 20240601, 6
HEADER = 16
#: Bytes of records that a task collects before it sends them on.
FLUSH = 8 << 20
#: Bytes of records of one file, about.
FILE = 64 << 20
NO_ID = -(1 << 63)


def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Places of the indices in a keyed permutation of 0..n-1: a balanced Feistel network over the next power of four, walked until it lands inside."""
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out = np.asarray(index).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for r in range(rounds):
            left, right = right, left ^ (mix(right + np.uint64((key * 0x9E3779B1 + r * 0x85EBCA77) & (2**64 - 1))) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def byte_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, 16 bits each): the text's UTF-8 bytes plus 3, as byte-level models number them."""

    def run(batches):
        for batch in batches:
            flat, offs = utf8(batch.column(1))
            ids = flat.astype("<u2") + np.uint16(3)
            blobs = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(2 * offs), pa.py_buffer(ids)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), blobs], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, ids binary")


NUMBERED = "part long, begin long, n long, doc_id long, ids binary"


def numberer(length: int):
    """Batches (doc_id, ids) with the task's number, the first sequence's number in the task and the number of sequences of each row."""

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = [-(-int(b or 0) // (2 * length)) for b in pc.binary_length(batch.column(1)).to_pylist()]
            begin = at + np.append(0, np.cumsum(n))[:-1].astype(np.int64)
            at += int(sum(n))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(begin), pa.array(n, pa.int64()), *batch.columns], names=["part", "begin", "n", "doc_id", "ids"])

    return number


def materialise(sequences: DataFrame, path: str, length: int = LENGTH, slots: int = SLOTS, key: int = KEY) -> int:
    """Writes doc_id, ids (binary, 16 bits each) as shards under path; the number of sequences."""
    spark = sequences.sparkSession

    if "begin" not in sequences.columns:
        sequences = sequences.select("doc_id", "ids").mapInArrow(numberer(length), NUMBERED)
    held = written(sequences.select("part", "begin", "n", "doc_id", "ids"))
    sizes = held.groupBy("part").agg(F.max(F.col("begin") + F.col("n")).alias("n")).orderBy("part").collect()  # one row an input split
    first, total = {}, 0
    for r in sizes:
        first[r["part"]] = total
        total += r["n"]
    stride = HEADER + 2 * length

    def send(batches):
        records, slot, size = [], [], 0

        def flush():
            where = feistel(np.concatenate(slot), total, key)
            data = np.concatenate(records)
            shard = where // slots
            order = np.argsort(shard, kind="stable")
            cut = np.append(np.flatnonzero(np.append(True, np.diff(shard[order]) > 0)), len(order))
            blobs = [zstandard.ZstdCompressor(level=1).compress(where[order[s:e]].tobytes() + data[order[s:e]].tobytes()) for s, e in zip(cut[:-1], cut[1:])]
            return pa.RecordBatch.from_arrays([pa.array(shard[order[cut[:-1]]]), pa.array([int(e - s) for s, e in zip(cut[:-1], cut[1:])], pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "n", "blob"])

        for batch in batches:
            for row in range(batch.num_rows):
                part, begin, n, doc = (batch.column(c)[row].as_py() for c in range(4))
                if not n:
                    continue
                ids = batch.column(4)[row].as_buffer()
                for k in range(0, n, 4096):  # very long texts: some sequences at a time
                    m = min(4096, n - k)
                    rows = np.zeros((m, stride), np.uint8)
                    head = rows[:, :HEADER].view(np.dtype([("doc", "<i8"), ("part", "<u4"), ("used", "<u2"), ("none", "<u2")]))[:, 0]
                    head["doc"] = NO_ID if doc is None else doc
                    head["part"] = np.arange(k, k + m)
                    body = np.frombuffer(ids, np.uint8)[2 * length * k : 2 * length * (k + m)]
                    head["used"] = np.minimum(len(body) // 2 - np.arange(m) * length, length)
                    room = np.zeros(m * 2 * length, np.uint8)
                    room[: len(body)] = body
                    rows[:, HEADER:] = room.reshape(m, -1)
                    records.append(rows)
                    slot.append(first[part] + begin + np.arange(k, k + m))
                    size += rows.nbytes
                    if size >= FLUSH:
                        yield flush()
                        records, slot, size = [], [], 0
        if size:
            yield flush()

    def assemble(batches):
        shard, where, data = None, [], []

        def block():
            slot = np.concatenate(where)
            order = np.argsort(slot)
            if not np.array_equal(slot[order], np.arange(shard * slots, shard * slots + len(slot))):
                raise ValueError(f"shard {shard} lacks slots or has some twice")
            records = np.concatenate(data)[order].tobytes()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, shard * slots, len(slot), stride)] + [pa.array([records], pa.binary())], names=["shard", "first_slot", "n", "stride", "records"])

        for batch in batches:  # in the order of shards
            for row in range(batch.num_rows):
                k, n = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                if k != shard and where:
                    yield block()
                    where, data = [], []
                shard = k
                raw = zstandard.ZstdDecompressor().decompress(batch.column(2)[row].as_buffer())
                where.append(np.frombuffer(raw, np.int64, n))
                data.append(np.frombuffer(raw, np.uint8, offset=8 * n).reshape(n, stride))
        if where:
            yield block()

    shards = -(-total // slots)
    files = max(1, min(shards, -(-total * stride // FILE)))
    sent = held.mapInArrow(send, "shard long, n long, blob binary").withColumn("_k", F.col("shard") * files / max(shards, 1))
    out = in_ranges(sent.withColumn("_k", F.floor("_k")), "_k", files).sortWithinPartitions("shard").select("shard", "n", "blob")
    out = out.mapInArrow(assemble, "shard long, first_slot long, n long, stride long, records binary")
    out.write.option("compression", "zstd").option("parquet.block.size", str(8 << 20)).parquet(path)
    return total


def in_ranges(rows: DataFrame, col: str, parts: int) -> DataFrame:
    """rows in `parts` partitions, all of one number of `col` (from 0) in one, and numbers apart as far as the partitions go: each number stands for a key that Spark's hash deals to that partition."""
    spark = rows.sparkSession
    keys = spark.range(max(64, 30 * parts)).select(F.pmod(F.hash("id"), F.lit(parts)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()  # a row a partition
    found = {r["p"]: r["id"] for r in keys}
    keyed = spark.createDataFrame([(p, found.get(p, -1 - p)) for p in range(parts)], "_p long, _key long")
    return rows.join(F.broadcast(keyed), F.col(col) == F.col("_p")).repartition(parts, "_key").drop("_p", "_key", col)  # a row a file


def read_slots(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """slot, shard, byte_offset, doc_id, part, ids (binary) of the slots in [start, stop); only shards that hold some are read."""
    shards = spark.read.parquet(path)
    if start:
        longest = shards.agg(F.max("n")).first()[0] or 0
        shards = shards.filter(F.col("first_slot") > start - longest)  # reaches the file's statistics
    shards = shards.filter(F.col("first_slot") + F.col("n") > start)
    if stop is not None:
        shards = shards.filter(F.col("first_slot") < stop)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, n, stride = (batch.column(c)[row].as_py() for c in range(4))
                rows = np.frombuffer(batch.column(4)[row].as_buffer(), np.uint8).reshape(n, stride)
                head = rows[:, :HEADER].copy().view(np.dtype([("doc", "<i8"), ("part", "<u4"), ("used", "<u2"), ("none", "<u2")]))[:, 0]
                take = np.flatnonzero((np.arange(first, first + n) >= start) & (np.arange(first, first + n) < (stop if stop is not None else 1 << 62)))
                docs = head["doc"][take]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first + take), pa.array(np.full(len(take), shard, np.int64)), pa.array(take * stride), pa.array(docs, mask=docs == NO_ID), pa.array(head["part"][take].astype(np.int64)), pa.array([rows[i, HEADER : HEADER + 2 * int(head["used"][i])].tobytes() for i in take], pa.binary())],
                    names=["slot", "shard", "byte_offset", "doc_id", "part", "ids"],
                )

    return shards.select("shard", "first_slot", "n", "stride", "records").mapInArrow(run, "slot long, shard long, byte_offset long, doc_id long, part long, ids binary")


def in_order(spark: SparkSession, path: str, start: int = 0, window: int = 1 << 16):
    """Records (slot, doc_id, part, ids) of all slots from `start` on, in order; `window` slots at most are held at once."""
    row = spark.read.parquet(path).agg(F.max(F.col("first_slot") + F.col("n"))).first()
    for low in range(start, row[0] or 0, window):
        yield from read_slots(spark, path, low, low + window).select("slot", "doc_id", "part", "ids").sort("slot").toLocalIterator()


def token_ids(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", length: int | None = None, check: bool = False) -> DataFrame:
    """doc_id and ids (binary, 16 bits each) of a merge-type vocabulary of at most 2^16 pieces. With `length` the rows are numbered for materialise in the same pass. check: against the library, as op5 does."""
    start = codec_starter(docs.sparkSession, model_path, check)

    def encode(batches):
        codec = start()
        for whole in batches:
            for i, j in chunks(utf8(whole.column(1))[1], SLICE):
                texts = pc.fill_null(whole.column(1).slice(i, j - i).cast(pa.string()), "")
                total, ids = np.zeros(j - i, np.int64), [np.zeros(0, "<u2")]
                for s, e, counts, part in codec.pieces(texts):
                    total[s:e] += counts
                    ids.append(part.astype("<u2"))
                blobs = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.append(0, np.cumsum(2 * total)).astype(np.int32)), pa.py_buffer(np.concatenate(ids))])
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(i, j - i), blobs], names=["doc_id", "ids"])
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    if length is None:
        return rows.mapInArrow(encode, "doc_id long, ids binary")
    return rows.mapInArrow(lambda batches: numberer(length)(encode(batches)), NUMBERED)


def op9_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    materialise(token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model(), length=LENGTH), path)
    return read_slots(spark, path).select("slot", "shard", "byte_offset", "doc_id", "part", (F.octet_length("ids") / 2).cast("long").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256"))


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """(doc_id, part, ids in use, digest) of all sequences, without their slots."""
    out = []
    for doc, text in rows:
        ids = np.frombuffer((text or "").encode(), np.uint8).astype("<u2") + np.uint16(3)
        out += [(doc, k // length, len(ids[k : k + length]), hashlib.sha256(ids[k : k + length].tobytes()).hexdigest()) for k in range(0, len(ids), length)]
    return out


QUERIES = {"op9_training_order": op9_training_order}
ORACLES: dict[str, str] = {}
