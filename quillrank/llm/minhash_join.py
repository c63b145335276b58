"""Near-duplicate documents: MinHash banding over 5-word shingles, verified on full shingle sets.

Documents with the same words in the same order form a class, and only classes go on. The numbers
of bands and rows follow from the wanted recall at the similarity bound. Classes meet by a shuffle
on band hashes. Each class's home is the smallest class that it shares a bucket with; classes of one
home are a block, a home of many classes is dealt into blocks by hash. Two blocks (or a block and
itself) are compared if some bucket has classes of both, each such block pair once, in a task of its
own, on the full shingle sets; so classes that a chain of buckets joins don't all meet. No pair is
written out: a block pair gives each class its number of links and one link that keeps linked classes
together, and connected components of these are the groups.

Defined results: documents without words link to nothing and are a group of their own. Null ids
come out with a null class and no links. Words are runs of 0-9, A-Z in either case and non-ASCII
characters. A text of fewer than five words has one shingle of all. Rows that repeat a doc_id are
judged by their own words: copies if these agree, else classes apart. Classes are told apart by 128
bits of hash, in links by 64 of them. An empty table gives an empty result. Extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import annotate, chunks, mix, shingles, table, trim, utf8, words, written

SHINGLE, SIMILARITY, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 128
#: Classes of one block; two blocks are compared in one go.
BLOCK = 256
#: Bits of the broadcast filter: at most 2^17 rows of two longs, however many documents there are.
FILTER_BITS = 1 << 23


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most `most` hashes that finds a pair at the bound with the wanted probability."""
    for rows in range(16, 0, -1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError("no banding of so few hashes has this recall")


def set_bounds(x: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each run of x, sorted, and where each run's begin."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.append(True, (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])) if len(x) else np.zeros(0, bool)
    return x[new], np.searchsorted(owner[new], np.arange(len(begin)))


def sequence_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words (0 without words)."""
    n = len(first) - 1
    some = np.flatnonzero(np.diff(first) > 0)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if len(some):
        seat = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
        spread = mix(h ^ (seat.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        one[some] = np.add.reduceat(spread, first[:-1][some])
        two[some] = np.add.reduceat(mix(spread ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first[:-1][some])
    return one, two


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for an Arrow array of texts."""
    flat, offs = utf8(texts)
    ones, twos = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i, j in chunks(offs):
        h, _, _, first, _ = words(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        one, two = sequence_hashes(h, first)
        ones.append(one)
        twos.append(two)
    return np.concatenate(ones), np.concatenate(twos)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int) -> DataFrame:
    """doc_id, two hashes of the word sequence, and the band hashes as packed longs (null without words)."""

    def run(batches):
        salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            flat, offs = utf8(batch.column(1))
            k1, k2, packed = [], [], []
            for i, j in chunks(offs):
                h, _, _, first, _ = words(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                some = np.flatnonzero(np.diff(first) > 0)
                one, two = sequence_hashes(h, first)
                keys = np.zeros((j - i, bands), np.uint64)
                if len(some):
                    x, begin = shingles(h, first, SHINGLE)
                    at = begin[:-1][some]
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(rows):
                            key = mix(key ^ np.minimum.reduceat((x ^ salt[b * rows + r]) * np.uint64(0xC2B2AE3D27D4EB4F), at))
                        keys[some, b] = key
                k1.append(one)
                k2.append(two)
                full = np.zeros(j - i, bool)
                full[some] = True
                packed += [k.tobytes() if f else None for k, f in zip(keys, full)]
            cat = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), cat(k1), cat(k2), pa.array(packed, pa.binary())], names=["doc_id", "k1", "k2", "bands"])
        trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, k1 long, k2 long, bands binary")


def unpack_bands(sigs: DataFrame, bands: int) -> DataFrame:
    """(band hash, class) for every band of every class."""

    def run(batches):
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], names=["key", "rep"])

    return sigs.select("rep", "bands").mapInArrow(run, "key long, rep long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component: its smallest node) of the links (a, b): smallest neighbouring label, then the label's label, until nothing changes."""
    sym = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(sym.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = sym.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        once = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        step = written(once.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        labels = step.select("node", "label")
        if step.filter("label <> old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))


def marked(rows: DataFrame, col: str, members: DataFrame, key: str) -> DataFrame:
    """rows with _likely: whether `col` may be among the members' keys, by a broadcast bit table of fixed size. It keeps most rows from being shuffled for a join with the members."""
    bit = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(FILTER_BITS))
    table = members.select(bit(key).alias("p")).groupBy(F.shiftright("p", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("_b"))
    kept = rows.withColumn("_p", bit(col)).join(F.broadcast(table), F.shiftright("_p", 6) == F.col("_w"), "left")
    return kept.withColumn("_likely", F.expr("coalesce((shiftrightunsigned(_b, cast(_p & 63 as int)) & 1) = 1, false)")).drop("_p", "_w", "_b")


def link_blocks(rows: pa.Table, similarity: float) -> pa.Table:
    """For each block pair in a bin: links of each class, weighted by the other class's documents, and its smallest linked class."""
    flat, offs = utf8(rows.column("text"))
    rep, n, pair, side, two = (rows.column(c).to_numpy() for c in ("rep", "n", "pair", "side", "two"))
    order = np.lexsort((rep, pair))
    heads = np.append(np.flatnonzero(np.append(True, pair[order][1:] != pair[order][:-1])), len(order)) if len(order) else np.zeros(1, np.int64)
    out_rep, out_n, out_link = [], [], []
    k1, k2 = rows.column("k1").to_numpy(), rows.column("k2").to_numpy()
    for s, e in zip(heads[:-1], heads[1:]):
        g = order[s:e]
        sets, keep = [], []
        for d in g:
            h, _, _, first, _ = words(flat[offs[d] : offs[d + 1]], np.array([0, offs[d + 1] - offs[d]]))
            one, two_ = (x.view(np.int64)[0] for x in sequence_hashes(h, first))
            if len(h) and one == k1[d] and two_ == k2[d] and not (keep and rep[keep[-1]] == rep[d]):
                sets.append(np.unique(shingles(h, first, SHINGLE)[0]))
                keep.append(d)
        g = np.array(keep, np.int64)
        m = len(g)
        if m < 2:
            continue
        size = np.array([len(x) for x in sets])
        value, column = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(m), size)
        shared = np.bincount(column) > 1
        use = shared[column]
        column, owner = (np.cumsum(shared) - 1)[column[use]], owner[use]
        order_c = np.argsort(column, kind="stable")
        column, owner = column[order_c], owner[order_c]
        inter = np.zeros((m, m), np.float64)
        for c in range(0, int(shared.sum()), 2048):
            lo, hi = np.searchsorted(column, [c, c + 2048])
            x = np.zeros((m, 2048), np.float32)
            x[owner[lo:hi], column[lo:hi] - c] = 1
            inter += x @ x.T
        linked = inter >= similarity * (size[:, None] + size[None, :] - inter) - 1e-9
        np.fill_diagonal(linked, False)
        if two[g[0]]:  # pairs inside a block are counted by the block with itself
            linked &= side[g][:, None] != side[g][None, :]
        label = np.arange(m)
        while True:
            least = np.minimum(label, np.where(linked, label[None, :], m).min(axis=1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        some = np.flatnonzero(linked.any(axis=1))
        out_rep.append(rep[g][some])
        out_n.append(linked[some] @ n[g])
        out_link.append(rep[g][label[some]])
    cat = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
    trim()
    return pa.table([cat(out_rep), cat(out_n), cat(out_link)], names=["rep", "links", "link"])


def candidate_blocks(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (key, rep): blocks (rep, blk) of the classes that share a bucket, and (blk, pair, side, two) for the block pairs that each block is part of."""
    buckets = keys.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key", "low")
    shared = written(keys.join(buckets, "key"))
    home = shared.groupBy("rep").agg(F.min("low").alias("home"))
    size = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("k"))
    blocks = written(home.join(size, "home").select("rep", F.xxhash64("home", F.pmod(F.xxhash64("rep"), F.col("k"))).alias("blk")))
    # A bucket's blocks, and not its classes, make pairs; most buckets lie in one block, and many hold the same blocks.
    met = shared.select("key", "rep").join(blocks, "rep").select("key", "blk").distinct()
    sets = met.groupBy("key").agg(F.array_sort(F.collect_set("blk")).alias("bs")).select("bs").distinct()
    pairs = sets.select("bs", F.explode("bs").alias("a")).select("a", F.explode(F.filter("bs", lambda x: x >= F.col("a"))).alias("b")).distinct()
    pairs = pairs.select("a", "b", F.xxhash64("a", "b").alias("pair"), (F.col("a") != F.col("b")).alias("two"))
    left = pairs.select(F.col("a").alias("blk"), "pair", F.lit(0).alias("side"), "two")
    return blocks, written(left.union(pairs.filter("two").select(F.col("b").alias("blk"), "pair", F.lit(1).alias("side"), "two")))


def grouped(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows with words and an id: (doc_id, k1, k2, rep, copy_id, n_links, group); and the other rows' signatures. rep stands for a class, group for the group's smallest rep."""
    bands, rows = bands_for(similarity, recall)
    sigs = written(signatures(docs, id_col, text_col, bands, rows))
    live = sigs.filter("bands is not null and doc_id is not null")
    classes = written(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("n"), F.first("bands").alias("bands")).withColumn("rep", F.col("k1")))
    blocks, parts = candidate_blocks(unpack_bands(classes, bands))
    members = written(blocks.join(classes.select("rep", "k1", "k2", "n", F.col("copy_id").alias("doc")), "rep"))
    sent = members.join(parts, "blk")
    bins = max(256, parts.count() // 4)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    # One text of each class; rows that repeat its id with other words are told apart by k1 and k2 where they arrive.
    held = marked(texts, "doc", members, "doc").filter("_likely").join(sent, "doc").withColumn("bin", F.pmod(F.xxhash64("pair"), F.lit(bins)))
    linked = written(held.select("bin", "pair", "side", "two", "rep", "k1", "k2", "n", "text").groupBy("bin").applyInArrow(lambda t: link_blocks(t, similarity), "rep long, links long, link long"))
    groups = components(linked.filter("rep <> link").select(F.col("rep").alias("a"), F.col("link").alias("b")))
    counts = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.select("k1", "k2", "rep", "copy_id", "n").join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("k1", "k2", "rep", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    return live.select("doc_id", "k1", "k2").join(named, ["k1", "k2"]), sigs.filter("bands is null or doc_id is null")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id (smallest id among all documents that links join), copy_id (smallest id with the same words), n_links (documents at or over the similarity, copies included)."""
    found, others = grouped(docs, id_col, text_col, similarity, recall)
    found = written(found)
    ids = found.groupBy("group").agg(F.min("copy_id").alias("class_id"))
    lone = others.select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return found.join(ids, "group").select("doc_id", "class_id", "copy_id", "n_links").union(lone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row, of the smallest id, of each group of near-duplicates; same columns. Rows without an id or words all stay."""
    rows = written(grouped(docs, id_col, text_col, SIMILARITY, RECALL)[0].groupBy("doc_id", "k1", "k2", "group").agg(F.count("*").alias("_times")))
    first = rows.groupBy("group").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first"))
    judged = rows.join(first, "group").withColumn("_stays", F.col("first") == F.struct("doc_id", "k1", "k2")).filter("not _stays or _times > 1")
    judged = written(judged.select(F.col("doc_id").alias("_gone"), "k1", "k2", "_stays"))
    split = marked(docs, id_col, judged, "_gone")
    doubtful = split.filter("_likely").drop("_likely")
    hashes = lambda: lambda texts: [pa.array(x.view(np.int64)) for x in word_hashes(texts)]
    doubtful = annotate(doubtful, [text_col], [("_k1", "long"), ("_k2", "long")], hashes)
    k1, k2 = doubtful.columns[-2:]
    keyed = doubtful.join(judged, (F.col(id_col) == F.col("_gone")) & (F.col(k1) == judged["k1"]) & (F.col(k2) == judged["k2"]), "left")
    once = keyed.filter("_stays").dropDuplicates([id_col, k1, k2])  # the row of a group that stays, there more than once
    return split.filter("not _likely").select(*docs.columns).unionByName(keyed.filter("_stays is null").select(*docs.columns)).unionByName(once.select(*docs.columns))


def op6_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_minhash_join": op6_minhash_join}
ORACLES: dict[str, str] = {}
