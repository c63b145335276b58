"""Benchmark decontamination by a prefix-filtered containment join.

An item's windows are its runs of 13 words (an item of fewer words, but not none, is one window).
A window's shingles are its adjacent word pairs (the word itself for a one-word window). The pairs
are counted over all documents, and a window's prefix is its rarest pair: a document that contains
the window must contain that pair. Document pairs are joined with the prefixes; the place of the
pair in the window gives the only possible start (positional bound), which must leave room for the
whole window inside the document (length bound); what remains is compared word by word over the
item-sized window, first by word hash and then by its bytes.

The benchmark side travels to the executors in blocks of a checked size; documents pass one block
after another, with a written table between blocks, so a benchmark of any size is handled whole; an item
of more than a block is cut into pieces that overlap by a window less one word.

Defined results: null and wordless texts have no words and hit nothing; items with a null id or
without words take no part; repeated items with one id count once; repeated documents are each
marked. Texts are taken whole. Extra columns stay; result names that clash get underscores.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import annotate, chunks, fresh, hash_spans, load8, ranges, table, utf8, words, written

WINDOW = 13
#: Bytes of benchmark text in one block, which bounds what is broadcast and held by a worker.
BLOCK_BYTES = 8 << 20
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())  # bytes.lower() changes A-Z only


class Block:
    """The windows of some items, and how to look for them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        found: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for name, ws in items:
            for i in range(max(1, len(ws) - window + 1)):
                found[tuple(ws[i : i + window])].add(name)
        self.windows = sorted(found)
        self.names = [sorted(found[w]) for w in self.windows]
        vocab = sorted({w for ws in self.windows for w in ws})
        flat = np.frombuffer(b"".join(vocab) + b"\0" * 8, np.uint8)
        lens = np.array([len(w) for w in vocab], np.int64)
        hashes = hash_spans(load8(flat), np.cumsum(lens) - lens, lens)
        # Words that share a hash share a number; what is found is compared by its bytes in the end.
        self.hashes, at = np.unique(hashes, return_inverse=True)
        number = dict(zip(vocab, (at + 1).tolist()))
        self.base = np.int64(len(self.hashes) + 1)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.matrix = np.zeros((len(self.windows), max(self.length, default=1)), np.int32)
        for i, w in enumerate(self.windows):
            self.matrix[i, : len(w)] = [number[x] for x in w]
        two = self.matrix[:, 1:] if self.matrix.shape[1] > 1 else np.zeros((len(self.windows), 0), np.int32)
        codes = self.matrix[:, : two.shape[1]].astype(np.int64) * self.base + two
        self.codes = [c[: n - 1] if n > 1 else np.array([m[0] * self.base]) for c, n, m in zip(codes, self.length, self.matrix.astype(np.int64))]
        self.pairs = np.unique(np.concatenate(self.codes)) if self.codes else np.zeros(0, np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Benchmark word numbers; 0 for other words."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int64) if len(self.hashes) else np.zeros(len(hashes), np.int64)

    def occurring(self, ids: np.ndarray, first: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into the sorted `pairs`, word position) of each pair, or single word, in the documents."""
        where, what = [], []
        near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0)) if len(ids) else np.zeros(0, np.int64)
        for pos, code in ((near, ids[near] * self.base + ids[near + 1] if len(near) else near), *([(p := np.flatnonzero(ids > 0), ids[p] * self.base)] if self.single else [])):
            at = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
            ok = pairs[at] == code
            where.append(pos[ok])
            what.append(at[ok])
        return np.concatenate(what), np.concatenate(where)

    @property
    def single(self) -> bool:
        return bool((self.length == 1).any())

    def choose(self, counts: dict[int, int]) -> None:
        """The rarest pair of each window becomes its prefix."""
        best = [min(range(len(c)), key=lambda k: (counts.get(int(c[k]), 0), k)) for c in self.codes]
        code = np.array([c[k] for c, k in zip(self.codes, best)], np.int64)
        order = np.argsort(code, kind="stable")
        self.prefix, begin = np.unique(code[order], return_index=True)
        self.prefix_begin = np.append(begin, len(order))
        self.prefix_window, self.prefix_offset = order, np.array(best, np.int64)[order]

    def matches(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, word position of its start) for all occurrences."""
        what, where = self.occurring(ids, first, self.prefix)
        n = self.prefix_begin[what + 1] - self.prefix_begin[what]
        slot = ranges(self.prefix_begin[what], n)
        window, start = self.prefix_window[slot], np.repeat(where, n) - self.prefix_offset[slot]
        doc = np.searchsorted(first, np.repeat(where, n), side="right") - 1
        ok = (start >= first[doc]) & (start + self.length[window] <= first[doc + 1])
        window, start = window[ok], start[ok]
        for k in range(self.matrix.shape[1]):
            inside = k < self.length[window]
            ok = ~inside | (ids[np.minimum(start + k, len(ids) - 1)] == self.matrix[window, k])
            window, start = window[ok], start[ok]
        return window, start


def pieces(ws: list[bytes], window: int, most: int):
    """Runs of an item's words, of about `most` bytes (one window at least), that hold all its windows: a run begins window - 1 words before the last one's end."""
    i = 0
    while True:
        j = min(i + window, len(ws))
        size = sum(map(len, ws[i:j]))
        while j < len(ws) and size + len(ws[j]) <= most:
            size += len(ws[j])
            j += 1
        yield ws[i:j], size
        if j == len(ws):
            return
        i = j - window + 1


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int):
    """The benchmark's rows in blocks of bounded bytes, read one partition at a time. A longer item is cut into pieces that overlap, with all its windows."""
    held, size = [], 0
    for name, text in benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).toLocalIterator():
        ws = item_words(text)
        if name is None or not ws:
            continue
        for part, n in pieces(ws, window, block_bytes):
            if held and size + n > block_bytes:
                yield Block(held, window)
                held, size = [], 0
            held.append((name, part))
            size += n
    if held:
        yield Block(held, window)


def pair_counts(docs: DataFrame, text_col: str, block: Block) -> dict[int, int]:
    """How often each pair of the block occurs over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def count(batches):
        b = shared.value
        total = np.zeros(len(b.pairs), np.int64)
        for batch in batches:
            flat, offs = utf8(batch.column(0))
            for i, j in chunks(offs):
                h, _, _, first, _ = words(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = b.numbers(h)
                total += np.bincount(b.occurring(ids, first, b.pairs)[0], minlength=len(b.pairs))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b.pairs[seen]), pa.array(total[seen])], names=["code", "n"])

    counted = docs.select(text_col).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return {r["code"]: r["n"] for r in counted.collect()}  # at most the pairs of one block


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Sorted, merged [start, end) rows."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    top = np.maximum.accumulate(spans[:, 1])
    head = np.append(True, spans[1:, 0] > top[:-1])
    return np.column_stack([spans[head, 0], top[np.append(np.flatnonzero(head)[1:] - 1, len(spans) - 1)]])


def _pass(docs: DataFrame, text_col: str, names: list[str], block: Block | None, again: bool) -> DataFrame:
    """One block against all documents: word count, hit words' spans and item ids, joined with an earlier block's."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def begin():
        b = shared.value

        def step(texts, old_spans=None, old_items=None):
            flat, offs = utf8(texts)
            n_words, n_hit, spans_out, items_out = [], [], [], []
            for i, j in chunks(offs):
                base = offs[i]
                h, starts, lens, first, low = words(flat[base : offs[j]], offs[i : j + 1] - base)
                window, start = b.matches(b.numbers(h), first) if b is not None else (np.zeros(0, np.int64),) * 2
                found, named = defaultdict(list), defaultdict(set)
                doc = np.searchsorted(first, start, side="right") - 1
                for w, s, d in zip(window.tolist(), start.tolist(), doc.tolist()):
                    e = s + int(b.length[w])
                    if all(low[starts[x] : starts[x] + lens[x]].tobytes() == y for x, y in zip(range(s, e), b.windows[w])):
                        found[d].append((s - first[d], e - first[d]))
                        named[d].update(b.names[w])
                n_words += np.diff(first).tolist()
                for d in range(j - i):
                    old = np.frombuffer(old_spans[i + d].as_py(), np.int32).reshape(-1, 2) if again else np.zeros((0, 2), np.int32)
                    if d not in found and not len(old):
                        n_hit.append(0)
                        spans_out.append(b"")
                        items_out.append([])
                        continue
                    merged = merge_spans(np.concatenate([old, np.array(found[d], np.int32).reshape(-1, 2)]))
                    n_hit.append(int((merged[:, 1] - merged[:, 0]).sum()))
                    spans_out.append(merged.astype(np.int32).tobytes())
                    items_out.append(sorted(named[d] | set(old_items[i + d].as_py() if again else ())))
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans_out, pa.binary()), pa.array(items_out, pa.list_(pa.string()))]

        return step

    kinds = ("long", "long", "binary", "array<string>")
    if not again:
        return annotate(docs, [text_col], list(zip(names, kinds)), begin)
    made = annotate(docs, [text_col, names[2], names[3]], list(zip(names, kinds)), begin)
    keep = [c for c in docs.columns if c not in names]
    return made.select(*keep, *[F.col("_" + n).alias(n) for n in names])


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, spans (merged word ranges hit, pairs of int32) and items (sorted ids of items with occurring windows)."""
    names: list[str] = []
    for n in ("n_words", "n_hit", "spans", "items"):
        names.append(fresh([*docs.columns, *names], n))
    out, again = None, False
    for block in blocks_of(benchmark, item_id, item_text, window, block_bytes):
        block.choose(pair_counts(docs, text_col, block))
        out = _pass(written(out) if again else docs, text_col, names, block, again)
        again = True
    return _pass(docs, text_col, names, None, False) if out is None else out


def is_contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least one word in twenty lies in a benchmark window."""
    return (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones, same columns."""
    marked = mark(docs, benchmark, text_col)
    new = marked.columns[len(docs.columns) :]
    return marked.filter(~is_contaminated(new[0], new[1])).select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
wins AS (SELECT DISTINCT item, len(p) AS l, array_to_string(p, ' ') AS win FROM (
  SELECT item, unnest([w[i:i+12] FOR i IN range(1, greatest(2, len(w) - 11))]) AS p FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM wins),
dw AS (SELECT r, l, i, array_to_string(w[i:i+l-1], ' ') AS win FROM (
  SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT dw.r, dw.i, dw.l, wins.item FROM dw JOIN wins ON dw.win = wins.win AND dw.l = wins.l),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""

QUERIES = {"op3_decontaminate": op3_decontaminate}
ORACLES = {"op3_decontaminate": SQL}
