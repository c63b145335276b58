"""Removal of repeated 50-byte strings with suffix arrays.

A byte of a document goes if a 50-byte string that covers it also starts in a document with a
smaller id. Documents are dealt into batches by a hash of their id. Every 50-byte window has an
anchor: the smallest-hashing 20-byte gram inside it (the leftmost on ties), so equal windows have
equal anchors, and neighbouring windows with one anchor travel together as one strip of text.

1. Each batch sends its distinct anchors to shards by hash. A shard answers which anchors occur in
   two documents or more, and which are hot (in more than HOT distinct strips); the rest is dropped.
2. Each batch sends the distinct strips of shared anchors to shards by anchor, and the distinct
   windows of hot anchors to shards by window, so one common phrase doesn't meet in one task.
   A batch sends one copy of a strip, however many documents hold it.
3. A shard collapses equal strips and builds suffix arrays over blocks of them: Larsson-Sadakane
   refinement in numpy (from five bytes on doubling; groups of one are left alone), Kasai common
   prefixes in text order, classes of suffixes whose common prefix has 50 bytes; neighbouring
   blocks are merged by binary search. Each strip is answered with the smallest id per window.
4. Each batch applies the answers to its documents.

Batches and shards write to each other directly as long as a letter holds some thirty anchors. Beyond
DIRECT batches that would be mostly envelopes, so there a sender writes to groups of about the root of
the receivers' number, and relays hand the letters on, many senders' in one envelope a receiver.

Defined results: null text is empty. A null doc_id is neither smaller nor larger than another, so
its document loses and causes nothing. Rows that repeat a doc_id don't affect each other. Texts of
any length are taken whole. An empty table gives an empty table. Extra columns stay; result names
that clash get underscores.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillrank.llm.common import fresh, hash_spans, load8, mix, n_batches, ranges, table, trim, utf8

WIDTH, GRAM = 50, 20
#: Distinct strips of one anchor beyond which its windows are dealt singly; one anchor's strips always fit a block.
HOT = 4096
#: Bytes of text in a suffix array (positions and ranks take 20 bits each) and in a batch of documents.
BLOCK, BATCH = 1 << 19, 4 << 20
#: Bytes winnowed at once; longer documents are winnowed in pieces that overlap by WIDTH - 1.
PIECE, _BITS = 1 << 19, 24

#: Batches up to which each writes to each shard; bytes of letters that a sender gathers for a group, and a relay before it hands them on.
DIRECT, ENVELOPE, RELAY = 8192, 1 << 20, 32 << 20

NO_DOC = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    return b"".join(len(x := np.ascontiguousarray(a).tobytes()).to_bytes(8, "little") + x for a in arrays)


def unpack(raw: bytes, *kinds) -> list[np.ndarray]:
    at, out = 0, []
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def envelope(letters: list[tuple[int, int, bytes]]) -> bytes:
    """Letters (receiver, sender, content) in one compressed piece."""
    to, sender, content = zip(*letters)
    heads = np.array([to, sender, [len(c) for c in content]], np.int64)
    return zstandard.ZstdCompressor(level=3).compress(pack(heads) + b"".join(content))


def opened(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (heads,) = unpack(raw, np.int64)
    at = 8 + heads.nbytes
    for to, sender, n in heads.reshape(3, -1).T.tolist():
        yield to, sender, raw[at : at + n]
        at += n


def letters_of(rows: pa.Table):
    """(sender, content) of all letters in rows of MAIL."""
    for blob in rows.column("_blob"):
        for _, sender, content in opened(blob.as_py()):
            yield sender, content


def runs_of(numbers: np.ndarray):
    """(number, its places) in rising order of the numbers."""
    order = np.argsort(numbers, kind="stable")
    found, begin = np.unique(numbers[order], return_index=True)
    for k, i, j in zip(found.tolist(), begin.tolist(), np.append(begin[1:], len(order)).tolist()):
        yield k, order[i:j]


def gram_hash(eight: np.ndarray, at: np.ndarray | slice, n: int = 0) -> np.ndarray:
    """Hash of the 20 bytes from each place on."""
    if isinstance(at, slice):
        a, b, c = eight[:n], eight[8 : 8 + n], eight[12 : 12 + n]
    else:
        a, b, c = eight[at], eight[at + 8], eight[at + 12]
    h = a * np.uint64(0x9E3779B97F4A7C15)
    h += b * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h += c * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Strips:
    """The strips of a batch of documents: start in `flat`, number of windows, anchor place in the strip, document, anchor hash."""

    def __init__(self, flat: np.ndarray, offs: np.ndarray):
        self.padded = np.concatenate([flat, np.zeros(32, np.uint8)])
        self.eight = load8(self.padded)
        parts = [[np.zeros(0, np.int64)] * 5]
        pieces = [(d, s, min(s + PIECE, e)) for d, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())) if e - s >= WIDTH for s in range(s, e - WIDTH + 1, PIECE - WIDTH + 1)]
        i = 0
        while i < len(pieces):
            j = i + 1
            while j < len(pieces) and pieces[j][2] - pieces[i][1] <= PIECE and pieces[j][1] >= pieces[j - 1][2]:
                j += 1
            parts.append(self._winnow(pieces[i:j]))
            i = j
        self.start, self.windows, self.anchor, self.doc, self.gram = (np.concatenate(x) for x in zip(*parts))
        self.gram = self.gram.astype(np.uint64)

    def _winnow(self, pieces: list[tuple[int, int, int]]) -> list[np.ndarray]:
        base, top = pieces[0][1], pieces[-1][2]
        n = top - base
        h = gram_hash(self.eight[base:], slice(None), n)
        low = (h & ~np.uint64((1 << _BITS) - 1)) | np.arange(n, dtype=np.uint64)
        span, step = WIDTH - GRAM + 1, 1
        while step * 2 <= span:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < span:
            low = np.minimum(low[: len(low) - (span - step)], low[span - step :])
        anchor = (low & np.uint64((1 << _BITS) - 1)).astype(np.int64)
        first = np.array([s for _, s, _ in pieces], np.int64) - base
        count = np.array([e - s - WIDTH + 1 for _, s, e in pieces], np.int64)
        at = ranges(first, count)
        anchor = anchor[at]
        head = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))
        heads = np.flatnonzero(head)
        windows = np.diff(np.append(heads, len(at)))
        owner = np.repeat(np.array([d for d, _, _ in pieces], np.int64), count)[heads]
        return [at[heads] + base, windows, anchor[heads] - at[heads], owner, h[anchor[heads]]]

    def distinct(self, pick: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first of each distinct text, number of the distinct text for each), distinct texts in order of first occurrence."""
        a, b = hash_spans(self.eight, start, length, 1), hash_spans(self.eight, start, length, 2)
        order = np.lexsort((pick, b, a))
        new = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])) if len(a) else np.zeros(0, bool)
        firsts = order[new]
        rank = np.empty(len(firsts), np.int64)
        by_place = np.argsort(firsts, kind="stable")
        rank[by_place] = np.arange(len(firsts))
        number = np.empty(len(a), np.int64)
        number[order] = rank[np.cumsum(new) - 1]
        return firsts[by_place], number


class Batch:
    """A batch in a fixed order of its rows, its strips and what it sends; the same in every pass."""

    def __init__(self, docs: pa.Table, shards: int, id_at: int, text_at: int):
        ids = docs.column(id_at).cast(pa.int64())
        texts = pc.fill_null(docs.column(text_at), "") if docs.column(text_at).null_count else docs.column(text_at)
        order = pc.sort_indices(pa.table({"i": ids, "t": texts}), [("i", "ascending"), ("t", "ascending")])
        self.docs = docs.take(order)
        self.flat, self.offs = utf8(texts.take(order))
        ids = ids.take(order)
        live = len(ids) - ids.null_count  # nulls come last
        self.ids = ids.slice(0, live).to_numpy().astype(np.int64)
        self.s = Strips(self.flat, self.offs[: live + 1])
        self.shards = shards
        self.grams, self.gram_of = np.unique(self.s.gram, return_inverse=True)
        self.shard_of_gram = (mix(self.grams) % np.uint64(shards)).astype(np.int64)

    def send_grams(self):
        """(shard, anchors, number of strips, in two documents or more)."""
        s = self.s
        n = np.bincount(self.gram_of, minlength=len(self.grams))
        ids = self.ids[s.doc]
        least, most = np.full(len(self.grams), NO_DOC), np.full(len(self.grams), np.iinfo(np.int64).min)
        np.minimum.at(least, self.gram_of, ids)
        np.maximum.at(most, self.gram_of, ids)
        for k, g in runs_of(self.shard_of_gram):
            yield k, pack(np.diff(self.grams[g], prepend=np.uint64(0)), np.minimum(n[g], 65535).astype(np.uint16), (most[g] > least[g]).astype(np.uint8))

    def take_codes(self, answers: dict[int, bytes]) -> None:
        """0: the anchor is in one document, 1: shared, 2: hot. Then the texts to send, in a fixed order."""
        code = np.zeros(len(self.grams), np.uint8)
        for k, g in runs_of(self.shard_of_gram):
            code[g] = unpack(answers[k], np.uint8)[0]
        s, code = self.s, code[self.gram_of]
        one, hot = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        windows = s.windows[hot]
        start = np.concatenate([s.start[one], ranges(s.start[hot], windows)])
        count = np.concatenate([s.windows[one], np.ones(windows.sum(), np.int64)])
        doc = np.concatenate([s.doc[one], np.repeat(s.doc[hot], windows)])
        single = np.arange(len(start)) >= len(one)
        place = np.argsort(start, kind="stable")
        self.start, self.count, self.doc, single = start[place], count[place], doc[place], single[place]
        anchor = np.concatenate([s.anchor[one], np.repeat(s.anchor[hot], windows) - (ranges(np.zeros(len(hot), np.int64), windows))])[place]
        length = self.count + WIDTH - 1
        first, self.number = s.distinct(np.arange(len(self.start)), self.start, length)
        self.anchor, self.first, self.length = anchor, first, length
        key = np.where(single[first], hash_spans(s.eight, self.start[first], length[first], 3), gram_hash(s.eight, self.start[first] + anchor[first]))
        self.shard_of = (mix(key) % np.uint64(self.shards)).astype(np.int64)

    def by_shard(self):
        return dict(runs_of(self.shard_of))

    def send_texts(self):
        for k, u in self.by_shard().items():
            f = self.first[u]
            ids = self.ids[self.doc[f]]
            text = self.s.padded[ranges(self.start[f], self.length[f])]
            yield k, pack(np.diff(ids, prepend=0), self.count[f].astype(np.uint8), self.anchor[f].astype(np.uint8), text)

    def removed(self, answers: dict[int, bytes]) -> np.ndarray:
        """Mask of the bytes of `flat` that go."""
        windows = np.append(0, np.cumsum(self.count[self.first]))  # by distinct text
        least = np.full(windows[-1], NO_DOC)
        for k, u in self.by_shard().items():
            if k in answers:
                at, run, ids = unpack(answers[k], np.uint32, np.uint8, np.int64)
                which = u[at]
                least[ranges(windows[which], run)] = ids
        n = self.count
        own = np.repeat(self.ids[self.doc], n)
        low = least[ranges(windows[self.number], n)]
        place = ranges(self.start, n)[low < own]
        edge = np.zeros(len(self.flat) + 1, np.int32)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + WIDTH, -1)
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def suffix_array(flat: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order: Larsson-Sadakane refinement, from five bytes on doubling.

    A group's rank is the place of its first member in the order, so refining a group leaves all others alone; a group of one is done.
    """
    n = len(flat)
    pad = np.concatenate([flat, np.zeros(5, np.uint8)]).astype(np.uint64) + np.uint64(1)
    pad[n:] = 0  # the end sorts before every byte
    key = np.zeros(n, np.uint64)
    for k in range(5):
        key = key * np.uint64(257) + pad[k : k + n]
    shift, mask = np.uint64(20), np.uint64((1 << 20) - 1)
    packed = np.sort((key << shift) | np.arange(n, dtype=np.uint64))
    order, key = (packed & mask).astype(np.int64), packed >> shift
    head = np.append(True, key[1:] != key[:-1]) if n else np.zeros(0, bool)
    rank = np.maximum.accumulate(np.where(head, np.arange(n), 0))[np.argsort(order)] if n else np.zeros(0, np.int64)
    size = np.bincount(rank, minlength=n)
    live, h = np.flatnonzero(size[rank] > 1), 5
    while len(live):
        r, ahead = rank[live], live + h
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        packed = np.sort((r.astype(np.uint64) << np.uint64(41)) | (second.astype(np.uint64) << shift) | live.astype(np.uint64))
        place, pair = (packed & mask).astype(np.int64), packed >> shift
        r = (pair >> np.uint64(21)).astype(np.int64)
        i = np.arange(len(r))
        slot = r + i - np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), i, 0))
        new = np.append(True, pair[1:] != pair[:-1])
        order[slot] = place
        rank[place] = np.maximum.accumulate(np.where(new, slot, 0))
        alone = new & np.append(new[1:], True)
        live, h = place[~alone], 2 * h
    return order


def common_prefixes(flat: np.ndarray, sa: np.ndarray, lane: int = 64) -> np.ndarray:
    """Kasai: length, up to 50, of the prefix that each suffix of `sa` shares with the one before it.

    Places are visited in text order, in many stretches side by side; inside a stretch the prefix shared at a place is at most one shorter than at the place before.
    """
    n = len(flat)
    pad = np.concatenate([flat, np.zeros(WIDTH + 1, np.uint8)])
    before = np.empty(n, np.int64)
    before[sa] = np.append(-1, sa[:-1])
    shared_at = np.zeros(n, np.int64)
    begin = np.arange(0, n, lane)
    h = np.zeros(len(begin), np.int64)
    for step in range(min(lane, n)):
        i = begin + step
        i = i[i < n]
        j = before[i]
        shared = np.where(j < 0, 0, np.maximum(h[: len(i)] - 1, 0))
        going = np.flatnonzero((j >= 0) & (shared < WIDTH))
        while len(going):
            p, q = i[going] + shared[going], j[going] + shared[going]
            going = going[(pad[p] == pad[q]) & (p < n) & (q < n)]
            shared[going] += 1
            going = going[shared[going] < WIDTH]
        shared_at[i] = shared
        h[: len(i)] = shared
    return shared_at[sa]


def class_minima(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows sorted by text, smallest id of each window's class, by place in `flat`)."""
    sa = suffix_array(flat)
    number = np.cumsum(common_prefixes(flat, sa) < WIDTH) - 1
    owner, window = np.full(len(flat), NO_DOC), np.zeros(len(flat), bool)
    at = ranges(starts, counts)
    owner[at], window[at] = np.repeat(ids, counts), True
    low = np.full(len(flat), NO_DOC)
    if len(sa):
        least = np.minimum.reduceat(owner[sa], np.flatnonzero(np.append(True, number[1:] != number[:-1])))
        low[sa] = least[number]
    return sa[window[sa]], low


def windows_text(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    pad = np.concatenate([flat, np.zeros(WIDTH, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(pad, WIDTH)[at]).view(f"V{WIDTH}").ravel() if len(at) else np.zeros(0, f"V{WIDTH}")


def merge_blocks(a, b) -> None:
    """Gives windows that two blocks share the smaller id: the one's sorted windows are looked for among the other's by binary search."""
    (flat_a, sa_a, low_a), (flat_b, sa_b, low_b) = a, b
    # bytes objects of numpy drop trailing zero bytes when compared; all windows have one length, so equality holds.
    keys_a, keys_b = (windows_text(f, s).view(f"S{WIDTH}") for f, s in ((flat_a, sa_a), (flat_b, sa_b)))
    if not len(keys_a) or not len(keys_b):
        return
    left, right = np.searchsorted(keys_a, keys_b, "left"), np.searchsorted(keys_a, keys_b, "right")
    hit = np.flatnonzero(right > left)
    least = np.minimum(low_a[sa_a[left[hit]]], low_b[sa_b[hit]])
    low_b[sa_b[hit]] = least
    span = right[hit] - left[hit]
    target = sa_a[ranges(left[hit], span)]
    low_a[target] = np.minimum(low_a[target], np.repeat(least, span))


def least_ids(flat: np.ndarray, begin: np.ndarray, ids: np.ndarray, counts: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For all windows of distinct texts (where each begins in `flat`), text after text, the smallest id of a text with the same window. Texts with one group stand in one block or in two neighbours."""
    order = np.argsort(group, kind="stable")
    out = np.full(int(counts.sum()), NO_DOC)
    place = np.append(0, np.cumsum(counts))
    size = np.cumsum((counts + WIDTH - 1)[order])
    last, i = None, 0
    while i < len(order):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + BLOCK - 1 - WIDTH, "right")))
        part = order[i:j]
        length = counts[part] + WIDTH - 1
        piece = flat[ranges(begin[part], length)]
        starts = np.cumsum(length) - length
        sa, low = class_minima(piece, starts, counts[part], ids[part])
        now = (piece, sa, low, part, starts)
        if last is not None:
            if group[last[3][-1]] == group[part[0]]:
                merge_blocks(last[:3], now[:3])
            out[ranges(place[last[3]], counts[last[3]])] = last[2][ranges(last[4], counts[last[3]])]
        last, i = now, j
    if last is not None:
        out[ranges(place[last[3]], counts[last[3]])] = last[2][ranges(last[4], counts[last[3]])]
    return out


def answer_grams(rows: pa.Table):
    """For each batch, which of its anchors are shared or hot."""
    batches, parts = zip(*((p, unpack(x, np.uint64, np.uint16, np.uint8)) for p, x in letters_of(rows)))
    gram = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    n = np.concatenate([p[1] for p in parts]).astype(np.int64)
    several = np.concatenate([p[2] for p in parts]).astype(np.int64)
    _, number, times = np.unique(gram, return_inverse=True, return_counts=True)
    total = np.bincount(number, n)
    shared = (times > 1) | (np.bincount(number, several) > 0)
    code = np.where(shared, np.where(total > HOT, 2, 1), 0).astype(np.uint8)[number]
    at = 0
    for p, part in zip(batches, parts):
        yield p, pack(code[at : at + len(part[0])])
        at += len(part[0])


def answer_texts(rows: pa.Table):
    """For each batch, the smallest id for each window of its texts; texts that hold no smaller id are left out only if the batch can't use them."""
    batches, parts = zip(*((p, unpack(x, np.int64, np.uint8, np.uint8, np.uint8)) for p, x in letters_of(rows)))
    sizes = [len(p[1]) for p in parts]
    ids = np.concatenate([np.cumsum(p[0]) for p in parts])
    counts, anchors = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in (1, 2))
    flat = np.concatenate([*[p[3] for p in parts], np.zeros(32, np.uint8)])
    del parts
    # Equal texts collapse; they are told apart by two hashes, as where they were sent.
    length = counts + WIDTH - 1
    start = np.cumsum(length) - length
    eight = load8(flat)
    a, b = hash_spans(eight, start, length, 1), hash_spans(eight, start, length, 2)
    order = np.lexsort((b, a))
    head = np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(head) - 1
    least = np.minimum.reduceat(ids[order], np.flatnonzero(head))
    first = order[head]
    del a, b, order
    group = gram_hash(eight, start[first] + anchors[first])
    low = least_ids(flat, start[first], least, counts[first], group)
    windows = np.append(0, np.cumsum(counts[first]))
    at = 0
    for p, size in zip(batches, sizes):
        w, c = which[at : at + size], counts[at : at + size]
        yield p, pack(np.arange(size, dtype=np.uint32), c.astype(np.uint8), low[ranges(windows[w], c)])
        at += size


MAIL = T.StructType().add("_to", "long").add("_blob", "binary")


def mailed(made, sender: int, fan: int) -> pa.Table:
    """Rows of MAIL from pairs (receiver, content): a row a receiver, or (fan > 1) rows for groups of `fan` receivers."""
    to, blobs, held, size = [], [], defaultdict(list), defaultdict(int)

    def post(group):
        to.append(group)
        blobs.append(envelope(held.pop(group)))
        size.pop(group)

    for k, content in made:
        group = k // fan
        held[group].append((k, sender, content))
        size[group] += len(content)
        if fan == 1 or size[group] > ENVELOPE:
            post(group)
    for group in list(held):
        post(group)
    trim()
    return pa.table([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], names=MAIL.fieldNames())


def relayed(mail: DataFrame, fan: int) -> DataFrame:
    """Mail to groups of receivers (fan > 1) handed on to the receivers, in envelopes of many senders' letters."""
    if fan == 1:
        return mail

    def run(batches):
        held, size = defaultdict(list), 0

        def post():
            for to, letters in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([envelope(letters)], pa.binary())], names=MAIL.fieldNames())

        for batch in batches:
            for blob in batch.column(1):
                for letter in opened(blob.as_py()):
                    held[letter[0]].append(letter)
                    size += len(letter[2])
                if size > RELAY:
                    yield from post()
                    held, size = defaultdict(list), 0
        yield from post()
        trim()

    return mail.repartition("_to").sortWithinPartitions("_to").mapInArrow(run, MAIL)


def removal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | None = None, cut: bool = False, direct: int = DIRECT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (remaining bytes, binary). cut: without kept, the text itself is what remains, without parts of characters; a null text stays null."""
    batches = batches or n_batches(docs, text_col, BATCH, 64)
    fan = 1 if batches <= direct else math.isqrt(batches - 1) + 1
    cols = docs.columns
    at = (cols.index(id_col), cols.index(text_col))
    dealt = docs.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(cols)], F.pmod(F.xxhash64(F.col(id_col)), F.lit(batches)).cast("long").alias("_p"))
    shape = T.StructType()
    for f in docs.schema.fields:
        shape.add(f.name, f.dataType)
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), *([] if cut else [("kept", "binary")])):
        shape.add(fresh(shape.fieldNames(), name), T.DataType.fromDDL(kind))

    def first(key, rows: pa.Table) -> pa.Table:
        return mailed(Batch(rows, batches, *at).send_grams(), key[0].as_py(), fan)

    def gram_shard(key, rows: pa.Table) -> pa.Table:
        return mailed(answer_grams(rows), key[0].as_py(), fan)

    def second(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return mailed((), key[0].as_py(), fan)
        b = Batch(rows, batches, *at)
        b.take_codes(dict(letters_of(answers)))
        return mailed(b.send_texts(), key[0].as_py(), fan)

    def text_shard(key, rows: pa.Table) -> pa.Table:
        return mailed(answer_texts(rows), -1 - key[0].as_py(), fan)

    def third(key, rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table([pa.array([], f.type) for f in arrow_shape], names=shape.fieldNames())
        b = Batch(rows, batches, *at)
        got = dict(letters_of(answers))
        b.take_codes({s: x for s, x in got.items() if s >= 0})
        gone = b.removed({-1 - s: x for s, x in got.items() if s < 0})
        n_removed, n_spans, kept = [], [], []
        for s, e in zip(b.offs[:-1].tolist(), b.offs[1:].tolist()):
            g = gone[s:e]
            n_removed.append(int(g.sum()))
            n_spans.append(int((g[1:] & ~g[:-1]).sum() + (e > s and g[0])))
            kept.append((b.flat[s:e][~g] if n_removed[-1] else b.flat[s:e]).tobytes())
        keep = [b.docs.column(f"_c{k}") for k in range(len(cols))]
        made = [pa.array(np.diff(b.offs)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64())]
        if cut:  # a U+FFFD of the text itself is valid and stays
            keep[at[1]] = pa.array([k.decode("utf-8", "ignore") if t else None for k, t in zip(kept, keep[at[1]].is_valid().to_pylist())], pa.string())
        else:
            made.append(pa.array(kept, pa.binary()))
        return pa.table([*keep, *made], names=shape.fieldNames())

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_shape = list(to_arrow_schema(shape))
    grams = relayed(dealt.groupBy("_p").applyInArrow(lambda k, t: first(k, t), MAIL), fan)
    codes = relayed(grams.groupBy("_to").applyInArrow(lambda k, t: gram_shard(k, t), MAIL), fan)
    texts = relayed(dealt.groupBy("_p").cogroup(codes.groupBy("_to")).applyInArrow(lambda k, t, a: second(k, t, a), MAIL), fan)
    minima = relayed(texts.groupBy("_to").applyInArrow(lambda k, t: text_shard(k, t), MAIL), fan)
    return dealt.groupBy("_p").cogroup(codes.unionByName(minima).groupBy("_to")).applyInArrow(lambda k, t, a: third(k, t, a), shape)


def removed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the repeated strings cut out of the text, same columns. Parts of characters that a cut leaves go too; a null text stays null."""
    made = removal(docs, id_col, text_col, cut=True)
    gone = made.columns[len(docs.columns) + 1]
    if length_col:
        made = made.withColumn(length_col, F.when(F.col(gone) == 0, F.col(length_col)).otherwise(F.length(text_col).cast(docs.schema[length_col].dataType)))
    return made.select(*docs.columns)


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = removal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int | None, str | None]], width: int = WIDTH) -> list[tuple]:
    """The same for a few small documents, straight from the definition."""
    least: dict[bytes, int] = {}
    raws = [(i, (t or "").encode()) for i, t in rows]
    for i, raw in raws:
        for k in range(len(raw) - width + 1) if i is not None else ():
            w = raw[k : k + width]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1) if i is not None else ():
            if least[raw[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


QUERIES = {"op2_suffix_array": op2_suffix_array}
ORACLES: dict[str, str] = {}
