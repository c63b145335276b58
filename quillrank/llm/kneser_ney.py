"""Quality by perplexity under an interpolated modified Kneser-Ney model of word n-grams.

Tokens are runs of word bytes, each with the one blank before it, and the runs between them, so they
make up the whole text. The model is over three tokens; below single tokens stands a byte 5-gram
model (Kneser-Ney too) of the different trusted tokens with an end mark, which spells what was never
seen. Documents are dealt into folds by a hash of the id, and each is scored by a model of the trusted
documents of the other folds, so no text is scored by a model that has seen its row, and all trusted
documents both train and calibrate. A text's log-probability is a sum over its places: the token's below
bigrams, what a known bigram adds to it or the context leaves, and what a known trigram adds or its context
leaves. So places go to the shard of their middle token, part by part, next to the trigrams of the trusted texts
with the same middle token, which are counted and smoothed there; only the sums come back, and no table of
n-grams is ever written. Tokens that fill many places have several shards, by the token before them.
Spelt tokens pass over shards of the byte model. A document's perplexity, a byte, is held against
quantiles of the trusted documents of its language and length (bands of powers of two of its bytes).

Defined results: null and empty texts have no bytes, a null perplexity, and are not kept. A language
that is null or has no trusted documents uses the quantiles over all languages, a band of fewer than
FEW trusted documents those of its language; with no trusted
documents at all everything with a perplexity is kept. With no trusted text every byte
and end of a token has probability 1/256. Labels with a null id take no part, a document is trusted if
any of its labels says so. Repeated documents are each scored; columns other than the id are not
returned, whatever their names. Texts are taken whole. N-grams are told apart by 64-bit hashes, their outer
tokens by 48 bits among those of a middle token, and the tokens' probabilities are sent as 32-bit floats. Perplexities are rounded to 32-bit floats too: sums differ in
their last bits with a text's place in its batch, and copies should fall on one side of a bound.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm.common import WORD_TABLE, annotate, chunks, drop, fresh, hash_spans, lean, load8, mix, n_batches, ranges, table, trim, utf8, written

ORDER = 5
#: Parts of the corpus; each is scored by a model of the others.
FOLDS = 2
#: Shares of the trusted documents below the lower and above the upper bound. The README has what other shares keep and drop.
TAILS = (0.001, 0.01)
#: Trusted documents that a band of lengths needs for quantiles of its own.
FEW = 50
#: Entries of one model shard; distinct n-grams a task holds before it sends them on; trusted ids that are broadcast.
SHARD, HELD, SMALL = 2_000_000, 1_000_000, 1_000_000
#: Bytes of text for each shard of the word model; places that n-grams of one token fill in a shard.
BATCH, HEAVY = 16 << 20, 1_000_000
#: Parts of the n-grams, by the middle token; parts of their types, by the last.
PARTS, TRAIN_PARTS = 5, 2
#: Frequent tokens, which mails name by a number; the number that stands for all others; slots (a power of two) to find them by; of them, those that parts are balanced by.
FREQUENT, RARE, SLOTS, BALANCED = 65_535, 65_535, 20, 2_000
#: Ends a spelt token; in no UTF-8 text.
END = b"\xff"


def contexts(flat: np.ndarray, offs: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, that byte and the order - 1 before it as one big-endian number; zeros stand before a text."""
    n, gap = len(offs) - 1, order - 1
    size = np.diff(offs)
    wide = np.zeros(len(flat) + gap * (n + 1), np.uint64)
    place = np.arange(len(flat)) + gap * (np.repeat(np.arange(n), size) + 1)
    wide[place] = flat
    key = np.zeros(len(flat), np.uint64)
    for k in range(gap, -1, -1):
        key = (key << np.uint64(8)) | wide[place - k]
    return key, offs


def sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def count_grams(texts: DataFrame, text_col: str) -> DataFrame:
    """(g, c): how often each n-gram occurs."""

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            k, n = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(k, kind="stable")
            head = np.flatnonzero(np.append(True, np.diff(k[order]) > 0))
            return k[order][head], np.add.reduceat(n[order], head)

        for batch in batches:
            flat, offs = utf8(batch.column(0))
            for i, j in chunks(offs):
                k, n = sorted_counts(contexts(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])[0])
                if not len(k):
                    continue
                keys.append(k)
                counts.append(n)
                held += len(k)
                if held > HELD:
                    k, n = flush()
                    keys, counts, held = [k], [n], len(k)
                    if held > HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["g", "c"])
                        keys, counts, held = [], [], 0
        if held:
            k, n = flush()
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(n)], names=["g", "c"])

    return texts.select(text_col).mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of one order, from the numbers of n-grams that occur one to four times."""
    row = counts.agg(*[F.coalesce(F.sum((F.col("c") == i).cast("long")), F.lit(0)).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (max(row[f"n{i}"], 1) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    return [min(max(1 - 2 * y * n2 / n1, 0.05), 0.95), min(max(2 - 3 * y * n3 / n2, 0.05), 1.95), min(max(3 - 4 * y * n4 / n3, 0.05), 2.95)]


def train(texts: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """The model: (kind, key, value). kind k > 0: log-probability of the k-gram's last byte; kind -k: log of what context (k bytes) leaves to shorter ones."""
    levels = {order: lean(count_grams(texts, text_col))}
    for k in range(order - 1, 0, -1):
        # How many different bytes stand before each k-gram; a text's beginning stands for itself.
        longer = levels[k + 1].select(F.col("g").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("g"))
        levels[k] = lean(longer.groupBy("g").agg(F.count("*").alias("c")))
    parts, lower, steps = [], None, list(levels.values())
    for k in range(1, order + 1):
        d1, d2, d3 = discounts(levels[k])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        rows = levels[k].withColumn("ctx", F.shiftright("g", 8))
        sums = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(off).alias("left"))
        joined = rows.join(sums, "ctx").withColumn("own", F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total")).withColumn("rest", F.col("left") / F.col("total"))
        if lower is None:
            made = joined.withColumn("p", F.col("own") + F.col("rest") / 256)
        else:
            made = joined.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(lower, "s").withColumn("p", F.col("own") + F.col("rest") * F.col("q"))
        made = lean(made.select("g", "p"))
        steps.append(made)
        parts.append(made.select(F.lit(k).alias("kind"), F.col("g").alias("key"), F.log("p").alias("value")))
        parts.append(sums.select(F.lit(1 - k).alias("kind"), F.col("ctx").alias("key"), F.log(F.col("left") / F.col("total")).alias("value")))
        lower = made.select(F.col("g").alias("s"), F.col("p").alias("q"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    out = lean(out)
    drop(*steps)
    return out


class ModelShard:
    """The entries whose context ends in some pairs of bytes, and all entries that don't show such a pair."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray, number: int, shards: int, order: int = ORDER):
        self.number, self.shards, self.order, self.tables = number, shards, order, {}
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(key[at].astype(np.uint64))]
            self.tables[int(k)] = (key[at].astype(np.uint64), value[at])

    def look(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have, value = self.tables.get(kind, (np.zeros(0, np.uint64), np.zeros(0)))
        if not len(have):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        ok = have[at] == keys
        return ok, np.where(ok, value[at], 0.0)

    def log_p(self, keys: np.ndarray) -> np.ndarray:
        """Of each n-gram's last byte after the others: the longest seen suffix, and what the longer contexts leave to it."""
        out = np.zeros(len(keys))
        todo = np.arange(len(keys))
        for k in range(self.order, 0, -1):
            gram = keys[todo] & np.uint64((1 << (8 * k)) - 1)
            ok, value = self.look(k, gram)
            out[todo[ok]] += value[ok]
            todo, gram = todo[~ok], gram[~ok]
            out[todo] += self.look(1 - k, gram >> np.uint64(8))[1]
        out[todo] -= np.log(256)
        return out

    def mine(self, keys: np.ndarray) -> np.ndarray:
        return mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(self.shards) == np.uint64(self.number)

    def sums(self, flat: np.ndarray, offs: np.ndarray) -> np.ndarray:
        key, _ = contexts(flat, offs, self.order)
        if not len(key):
            return np.zeros(len(offs) - 1)
        low = np.uint64(24)  # a chunk's places take 24 bits beside the 40 of a 5-gram
        packed = np.sort((key << low) | np.arange(len(key), dtype=np.uint64)) if len(key) <= 1 << 24 else None
        if packed is None:
            found, back = np.unique(key, return_inverse=True)
        else:
            place, sorted_key = (packed & np.uint64((1 << 24) - 1)).astype(np.int64), packed >> low
            head = np.append(True, sorted_key[1:] != sorted_key[:-1])
            found, back = sorted_key[head], np.empty(len(key), np.int64)
            back[place] = np.cumsum(head) - 1
        value = np.zeros(len(found))
        use = np.flatnonzero(self.mine(found)) if self.shards > 1 else np.arange(len(found))
        value[use] = self.log_p(found[use])
        run = np.append(0.0, np.cumsum(value[back]))
        return run[offs[1:]] - run[offs[:-1]]


def shards_of(model: DataFrame, size: int = SHARD):
    """The model in shards of about `size` entries, one at a time at the driver."""
    n = -(-model.count() // size) if size else 1
    pair = F.when(F.col("kind") >= 3, F.shiftright("key", 8)).when(F.col("kind") <= -2, F.col("key")).bitwiseAND(F.lit(0xFFFF))
    for k in range(max(1, n)):
        rows = model
        if n > 1:
            spread = F.udf(lambda p: None if p is None else int(mix(np.array([p], np.uint64))[0] % np.uint64(n)), "int")
            numbers = model.sparkSession.range(1 << 16).select(F.col("id").alias("pair"), spread("id").alias("shard"))
            rows = model.withColumn("pair", pair).join(F.broadcast(numbers), "pair", "left").filter(F.coalesce("shard", F.lit(k)) == k)
        got = rows.select(F.col("kind").cast("byte"), "key", "value").toArrow()
        yield ModelShard(*[got.column(c).to_numpy() for c in ("kind", "key", "value")], k, max(1, n))


def spelt(docs: DataFrame, model: DataFrame, col: str, size: int = SHARD) -> tuple[DataFrame, str]:
    """docs with the log-probability of all byte strings of the lists in `col` together, and that column's name."""
    name, out = "", docs
    for shard in shards_of(model, size):
        shared = docs.sparkSession.sparkContext.broadcast(shard)  # about `size` entries

        def begin(shared=shared):
            s = shared.value

            def step(lists, earlier=None):
                flat, offs = utf8(lists.flatten())
                parts = [s.sums(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in chunks(offs)]
                run = np.append(0.0, np.cumsum(np.concatenate(parts))) if parts else np.zeros(1)
                at = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
                total = run[at[1:]] - run[at[:-1]]
                return [pa.array(total + earlier.to_numpy() if earlier is not None else total)]

            return step

        before = name
        name = fresh(out.columns, "log_p")
        out = annotate(written(out), [col, before], [(name, "double")], begin).drop(before) if before else annotate(out, [col], [(name, "double")], begin)
    return out, name


def tokens(flat: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its start, its length, first token of each text and one more)."""
    n = len(flat)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = np.take(WORD_TABLE, flat) != 0
    edge = np.zeros(n, bool)
    edge[offs[:-1][offs[:-1] < n]] = True
    begin = edge.copy()
    begin[1:] |= word[1:] != word[:-1]
    blank = np.flatnonzero((flat[:-1] == 32) & word[1:] & ~edge[1:])
    begin[blank] = True
    begin[blank + 1] = False
    starts = np.flatnonzero(begin)
    lens = np.diff(np.append(starts, n))
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = flat
    return hash_spans(load8(padded), starts, lens, 1), starts, lens, np.searchsorted(starts, offs)


def xx(seed: np.ndarray | int, value: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long, so that keys made here and in joins agree."""
    u = np.uint64
    value = value * u(0xC2B2AE3D27D4EB4F)
    h = (np.asarray(seed, u) + u(0x27D4EB2F165667C5) + u(8)) ^ ((value << u(31) | value >> u(33)) * u(0x9E3779B185EBCA87))
    h = (h << u(27) | h >> u(37)) * u(0x9E3779B185EBCA87) + u(0x85EBCA77C2B2AE63)
    h = (h ^ h >> u(33)) * u(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> u(29)) * u(0x165667B19E3779F9)
    return h ^ h >> u(32)


def before(t: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The token k before each token in its text; 0 before a text."""
    out = np.zeros(len(t), t.dtype)
    out[k:] = t[:-k]
    seat = np.arange(len(t)) - np.repeat(first[:-1], np.diff(first))
    out[seat < k] = 0
    return out


def count_words(texts: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(f, u, v, w, c): how often each three tokens occur in the texts (f, text) of a fold. part, parts: only those whose middle token's hash leaves `part`."""

    def run(batches):
        for batch in batches:
            fold = batch.column(0).to_numpy()
            flat, offs = utf8(batch.column(1))
            for i, j in chunks(offs):
                t, _, _, first = tokens(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                f, u, v = np.repeat(fold[i:j], np.diff(first)), before(t, first, 2), before(t, first, 1)
                if parts > 1:
                    mine = v % np.uint64(parts) == np.uint64(part)
                    f, u, v, t = f[mine], u[mine], v[mine], t[mine]
                _, at, n = np.unique(xx(xx(xx(f.astype(np.uint64), u), v), t), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(f[at]), *[pa.array(x[at].view(np.int64)) for x in (u, v, t)], pa.array(n)], names=["f", "u", "v", "w", "c"])
        trim()

    return texts.select("f", "text").mapInArrow(run, "f long, u long, v long, w long, c long").groupBy("f", "u", "v", "w").agg(F.sum("c").alias("c"))


def marked(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens, each with the end mark, and where each begins and ends."""
    ends = np.append(0, np.cumsum(lens + 1))
    out = np.full(ends[-1], END[0], np.uint8)
    out[ranges(ends[:-1], lens)] = flat[ranges(starts, lens)]
    return out, ends


def vocabulary(texts: DataFrame, shards: int = 24) -> DataFrame:
    """(f, w, token): the different tokens of each fold's texts, with the end mark."""

    def run(batches):
        for batch in batches:
            fold, rows, flat, base, found = batch.column(0).to_numpy(), [], utf8(batch.column(1))[0], 0, []
            for row, t, _, (raw, starts, lens) in stretch(batch.column(1)):
                found.append((fold[row], t, starts + base, lens))
                base += len(raw)
            f, t, starts, lens = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
            for k in np.unique(f).tolist():
                x = np.flatnonzero(f == k)
                x = x[grouped(t[x])[0]]
                s = (mix(t[x]) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(s, kind="stable")
                x, begin = x[order], np.searchsorted(s[order], np.arange(shards + 1))
                for i in np.flatnonzero(np.diff(begin)).tolist():
                    y = x[begin[i] : begin[i + 1]]
                    rows.append((i, k, rising(t[y]), shrunk(marked(flat, starts[y], lens[y])[0]), packed(lens[y].astype(np.uint32))))
            yield sent(rows, TOKENS)
        trim()

    def join(mails: pa.Table) -> pa.Table:
        t, size = (np.concatenate([get(b) for b in mails.column(c).to_pylist()]) for c, get in (("w", risen), ("size", lambda b: unpacked(b, np.uint32).astype(np.int64) + 1)))
        flat = np.concatenate([grown(b) for b in mails.column("raw").to_pylist()])
        x = grouped(t)[0]
        begin, ends = np.cumsum(size) - size, np.append(0, np.cumsum(size[x]))
        token = pa.Array.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat[ranges(begin[x], size[x])])]).cast(pa.binary())
        trim()
        return pa.table([np.full(len(x), mails.column("f")[0].as_py()), t[x].view(np.int64), token], names=["f", "w", "token"])

    return texts.select("f", "text").mapInArrow(run, ddl(TOKENS)).groupBy("_s", "f").applyInArrow(lambda t: join(t), "f long, w long, token binary")


def train_words(texts: DataFrame, folds: int = 1, parts: int = PARTS) -> tuple[DataFrame, list[float], list[DataFrame]]:
    """Of texts (f, text): the model (key, p, rest), what each fold leaves to spelling, and its byte model. p: log-probability of an n-gram's last token; rest: log of what it leaves, as a context, to shorter ones; a key may have a row of each. Trigrams are counted and smoothed in parts by their middle token, one after another, to hold less on disk."""
    t3 = [lean(count_words(texts, k, parts)) for k in range(parts)]
    t2 = [lean(t.groupBy("f", "v", "w").agg(F.count("*").alias("c"))) for t in t3]
    t1 = lean(reduce(DataFrame.union, t2).groupBy("f", "w").agg(F.count("*").alias("c")))
    words = lean(vocabulary(texts))
    spell = [train(words.filter(F.col("f") == k), "token") for k in range(folds)]
    spelling = []
    for k in range(folds):
        out, name = spelt(words.filter(F.col("f") == k).withColumn("_t", F.array("token")), spell[k], "_t")
        spelling.append(out.select("f", "w", F.exp(name).alias("q")))
    base = reduce(DataFrame.unionByName, spelling)
    left = [0.0] * folds

    def discounted(counts):
        """What is taken from each count, by the numbers of n-grams of all parts."""
        d = [discounts(counts.filter(F.col("f") == k)) for k in range(folds)]
        off = F.lit(0.0)
        for k in range(folds):
            off = F.when(F.col("f") == k, F.when(F.col("c") == 1, d[k][0]).when(F.col("c") == 2, d[k][1]).otherwise(d[k][2])).otherwise(off)
        return off

    def totals(counts, context, off):
        return counts.groupBy("f", *context).agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("rest"))

    def smoothed(counts, context, off, sums, lower, on):
        p = F.greatest(F.col("c") - off, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("q")
        return counts.join(sums, ["f", *context]).join(lower, ["f", *on]).withColumn("p", p)

    off1, off2, off3 = discounted(t1), discounted(reduce(DataFrame.union, t2)), discounted(reduce(DataFrame.union, t3))
    s1 = totals(t1, [], off1)
    for r in s1.collect():  # a row a fold
        left[r["f"]] = float(np.log(r["rest"]))
    p1 = lean(smoothed(t1, [], off1, s1, base, ["w"]).select("f", "w", "p"))
    drop(t1, words)
    log = lambda c: F.log(F.col(c)).cast("float").alias(c)
    made, contexts1 = [], []
    for a2, a3 in zip(t2, t3):  # an n-gram, its contexts and its lower order share the middle token, so a part has them all
        s2, s3 = lean(totals(a2, ["v"], off2)), lean(totals(a3, ["u", "v"], off3))
        contexts1.append(s2)
        p2 = lean(smoothed(a2, ["v"], off2, s2, p1.withColumnRenamed("p", "q"), ["w"]).select("f", "v", "w", "p"))
        drop(a2)
        p3 = smoothed(a3, ["u", "v"], off3, s3, p2.withColumnRenamed("p", "q"), ["v", "w"])
        made.append(lean(p3.select(F.xxhash64("f", "u", "v", "w").alias("key"), log("p"), F.lit(None).cast("float").alias("rest"))))
        drop(a3)
        # A context (u, v) stands with its last token in this part, as a bigram (u, v) with its first in another: two rows of one key.
        made.append(lean(p2.select(F.xxhash64("f", "v", "w").alias("key"), log("p"), F.lit(None).cast("float").alias("rest"))))
        made.append(lean(s3.select(F.xxhash64("f", "u", "v").alias("key"), F.lit(None).cast("float").alias("p"), log("rest"))))
        drop(p2, s3)
    one = p1.join(reduce(DataFrame.union, contexts1).select("f", F.col("v").alias("w"), "rest"), ["f", "w"], "full").select(F.xxhash64("f", "w").alias("key"), log("p"), log("rest"))
    made.append(lean(one))
    drop(p1, *contexts1)
    model = lean(reduce(DataFrame.union, made))
    drop(*made)
    return model, left, spell


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def shrunk(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def grown(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)


def rising(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=np.uint64(0)))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob, np.uint64), dtype=np.uint64)


LOW48 = np.uint64((1 << 48) - 1)


def letters(c: np.ndarray, t: np.ndarray, width: int = 6) -> bytes:
    """Tokens with the numbers c: these, and the low bytes of the hashes of those that have none."""
    rare = t[c == RARE].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return zstandard.ZstdCompressor(level=1).compress(len(c).to_bytes(4, "little") + (c & 255).astype(np.uint8).tobytes() + (c >> 8).astype(np.uint8).tobytes() + np.ascontiguousarray(rare).tobytes())


def lettered(blob: bytes, deal: Deal, width: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(c, t) of `letters`."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = int.from_bytes(raw[:4].tobytes(), "little")
    c = raw[4 : 4 + n] | raw[4 + n : 4 + 2 * n].astype(np.uint16) << 8
    t = deal.hashes(width)[c]
    rest = raw[4 + 2 * n :].reshape(-1, width)
    if len(rest):
        wide = np.zeros((len(rest), 8), np.uint8)
        wide[:, :width] = rest
        t[c == RARE] = wide.reshape(-1).view("<u8")
    return c, t


def several(blobs: list[bytes], deal: Deal, width: int = 6) -> tuple[np.ndarray, np.ndarray]:
    parts = [lettered(b, deal, width) for b in blobs]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint16), np.zeros(0, np.uint64))


def heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, head, count) of equal keys: order sorts them, head has where each key begins in it."""
    order = np.argsort(keys)
    k = keys[order]
    head = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    return order, head, np.diff(np.append(head, len(k)))


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A place of each different key, each key's among these, and their counts."""
    order, head, n = heads(keys)
    back = np.empty(len(keys), np.int64)
    back[order] = np.repeat(np.arange(len(head)), n)
    return order[head], back, n


class Slots:
    """Different hashes, found by their high bits; those whose slot is taken, by binary search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        slot = keys >> self.shift
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slot] = np.arange(len(keys), dtype=np.int32)
        lost = np.flatnonzero(self.table[slot] != np.arange(len(keys)))
        self.lost = lost[np.argsort(keys[lost])]
        self.lost_keys = keys[self.lost]

    def find(self, want: np.ndarray) -> np.ndarray:
        """The place of each hash among the keys, or -1."""
        if not len(self.keys):
            return np.full(len(want), -1, np.int32)
        at = self.table[want >> self.shift]
        other = np.flatnonzero((self.keys[at] != want) & (at >= 0))
        at[self.keys[at] != want] = -1
        if len(self.lost) and len(other):
            x = want[other]
            to = np.minimum(np.searchsorted(self.lost_keys, x), len(self.lost) - 1)
            at[other] = np.where(self.lost_keys[to] == x, self.lost[to], -1)
        return at


class Deal:
    """Numbers of frequent tokens, and where n-grams go: parts that are worked on one after another, shards within them; tokens that fill many places (0 too, which stands before texts) get parts by their counts and several shards."""

    def __init__(self, frequent: np.ndarray, counts: np.ndarray, shards: int, heavy: int):
        order = np.argsort(-counts, kind="stable")[:FREQUENT]
        best = None
        for shift in range(0, 64 - SLOTS + 1, 4):  # of two tokens in one slot the less frequent is not numbered
            keep = np.sort(np.unique(self.slot(frequent[order], shift), return_index=True)[1])
            lost = counts.sum() - counts[order][keep].sum()
            if best is None or lost < best[0]:
                best = lost, shift, order[keep]
        _, self.shift, order = best
        self.frequent, self.shards, self.counts = frequent[order], shards, counts[order][:BALANCED]
        self.spread = np.ones(RARE + 1, np.int64)
        self.spread[: len(order)] = np.clip(-(-counts[order] // heavy), 1, shards)
        self.held: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"held": {}}

    @staticmethod
    def slot(t: np.ndarray, shift: int) -> np.ndarray:
        return t >> np.uint64(shift) & np.uint64((1 << SLOTS) - 1)

    def hashes(self, width: int) -> np.ndarray:
        """The low bytes of the frequent tokens by number."""
        if width not in self.held:
            self.held[width] = np.append(self.frequent, np.zeros(RARE + 1 - len(self.frequent), np.uint64)) & np.uint64((1 << (8 * width)) - 1)
        return self.held[width]

    def code(self, t: np.ndarray) -> np.ndarray:
        """The number of each token, RARE if it has none."""
        if "table" not in self.held:
            self.held["table"] = np.full(1 << SLOTS, RARE, np.uint16)
            self.held["table"][self.slot(self.frequent, self.shift)] = np.arange(len(self.frequent), dtype=np.uint16)
        c = self.held["table"][self.slot(t, self.shift)]
        return np.where(self.hashes(8)[c] == t, c, np.uint16(RARE))

    def part(self, c: np.ndarray, t: np.ndarray, parts: int) -> np.ndarray:
        if ("part", parts) not in self.held:
            load = [0] * parts
            where = self.hashed(self.hashes(8), parts)
            for k, n in enumerate(self.counts.tolist()):
                where[k] = load.index(min(load))
                load[where[k]] += n
            self.held["part", parts] = where
        out = self.held["part", parts][c]
        rare = np.flatnonzero(c == RARE)
        out[rare] = self.hashed(t[rare], parts)
        return out

    @staticmethod
    def hashed(t: np.ndarray, parts: int) -> np.ndarray:
        return ((t >> np.uint64(40) & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)).astype(np.uint8 if parts < 256 else np.int64)

    def shard(self, c: np.ndarray, t: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
        """The shard of a token, or of its share of n-grams with `other` (48 bits)."""
        out = (mix(t) % np.uint64(self.shards)).astype(np.int64)
        if other is not None:
            n = self.spread[c]
            many = np.flatnonzero(n > 1)
            out[many] = (out[many] + (mix(other[many] + np.uint64(7)) % n[many].astype(np.uint64)).astype(np.int64)) % self.shards
        return out


def stretch(array: pa.Array):
    """(row, t, seat) of each MB of texts: the tokens' hashes, their texts and their places in them."""
    flat, offs = utf8(array)
    for i, j in chunks(offs):
        t, starts, lens, first = tokens(flat[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        size = np.diff(first)
        yield np.repeat(np.arange(i, j), size), t, np.arange(len(t)) - np.repeat(first[:-1], size), (flat[offs[i] : offs[j]], starts, lens)


def trigrams(array: pa.Array, deal: Deal, by: str, part: int, parts: int) -> tuple[np.ndarray, ...]:
    """(row, u, v, w, and their numbers) of the trigrams whose token `by` is of a part."""
    made, none = [], np.zeros(1, np.uint64)
    c0 = deal.code(none)
    p0 = deal.part(c0, none, parts)[0] == part
    for row, t, seat, _ in stretch(array):
        c = deal.code(t)
        mine = deal.part(c, t, parts) == part
        if by == "v":
            mine[1:] = mine[:-1]
            mine[seat == 0] = p0
        at = np.flatnonzero(mine)
        s = seat[at]
        had1, had2 = s >= 1, s >= 2
        at2, at1 = np.maximum(at - 2, 0), np.maximum(at - 1, 0)
        u, v = np.where(had2, t[at2], np.uint64(0)), np.where(had1, t[at1], np.uint64(0))
        made.append((row[at], u, v, t[at], np.where(had2, c[at2], c0), np.where(had1, c[at1], c0), c[at]))
    return tuple(np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3, *[np.zeros(0, np.uint16)] * 3)


def cut(shard: np.ndarray, c: np.ndarray, key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by shard, then number, then (its high half) key, and where each shard begins."""
    u = np.uint64
    if shards < 1 << 16:
        order = np.argsort(shard.astype(u) << u(48) | c.astype(u) << u(32) | np.where(c == RARE, key >> u(32), u(0)))
    else:
        order = np.lexsort((key, c, shard))
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def sent(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=[n for n, _ in kinds])


LONG, BLOB = pa.int64(), pa.binary()
TRAINING = [("_s", LONG), ("f", LONG), ("w", BLOB), ("v", BLOB), ("u", BLOB)]
TRAINED = [("_s", LONG), ("f", LONG), ("v", BLOB), ("u", BLOB), ("w", BLOB), ("c3", BLOB), ("c2", BLOB), ("p", BLOB)]
DEALT = [("_s", LONG), ("f", LONG), ("w", BLOB), ("p", BLOB)]
PLACES = [("_s", LONG), ("chunk", LONG), ("v", BLOB), ("u", BLOB), ("w", BLOB), ("doc", BLOB)]
TOKENS = [("_s", LONG), ("f", LONG), ("w", BLOB), ("raw", BLOB), ("size", BLOB)]
ASKED = [("_s", LONG), ("chunk", LONG), ("f", LONG), ("w", BLOB), ("raw", BLOB), ("size", BLOB), ("at", BLOB), ("doc", BLOB)]
SUMS = [("chunk", LONG), ("keys", BLOB), ("docs", BLOB), ("sums", BLOB)]


def ddl(kinds: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {'long' if k == LONG else 'binary'}" for n, k in kinds)


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, by those that make up over 1/400,000 of some task's texts, and how many places they fill there."""

    def run(batches):
        keys, counts, texts = [], [], 0

        def flush():
            order, head, _ = heads(np.concatenate(keys))
            k, n = np.concatenate(keys)[order[head]], np.add.reduceat(np.concatenate(counts)[order], head)
            return k, n

        def frequent():
            k, n = flush()
            keep = n * 400_000 > n.sum()
            k, n = np.append(k[keep], np.uint64(0)), np.append(n[keep], texts)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["t", "n"])

        for batch in batches:
            for _, t, seat, _ in stretch(batch.column(0)):
                k, n = sorted_counts(t)
                keys.append(k)
                counts.append(n)
                texts += np.count_nonzero(seat == 0)
                if sum(map(len, keys)) > HELD:
                    k, n = flush()
                    keys, counts = [k], [n]
                    if len(k) > HELD // 2:
                        yield frequent()
                        keys, counts, texts = [], [], 0
        if keys and sum(map(len, keys)):
            yield frequent()
        trim()

    rows = docs.select("text").mapInArrow(run, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(FREQUENT).toArrow()  # only the balance of shards and the size of mails depend on them
    return rows.column("t").to_numpy().view(np.uint64), rows.column("n").to_numpy()


def training_mail(texts: DataFrame, deal: Deal, by: str, part: int, parts: int) -> DataFrame:
    """TRAINING: the trigrams (u, v, w) of the texts whose token `by` is of a part, to the shards of w."""

    def run(batches):
        for batch in batches:
            row, u, v, w, cu, cv, cw = trigrams(batch.column(1), deal, by, part, parts)
            fold = batch.column(0).to_numpy()[row] if len(row) else row
            rows = []
            for f in np.unique(fold).tolist():
                at = np.flatnonzero(fold == f)
                order, begin = cut(deal.shard(cw[at], w[at], v[at] & LOW48), cw[at], w[at], deal.shards)
                at = at[order]
                for s in np.flatnonzero(np.diff(begin)).tolist():
                    x = at[begin[s] : begin[s + 1]]
                    rows.append((s, f, letters(cw[x], w[x], 8), letters(cv[x], v[x], 8), letters(cu[x], u[x])))
            yield sent(rows, TRAINING)
        trim()

    return texts.select("f", "text").mapInArrow(run, ddl(TRAINING))


def opened(mails: pa.Table, deal: Deal) -> tuple[np.ndarray, ...]:
    """(u, v, w, and their numbers) of mails of TRAINING."""
    (cu, u), (cv, v), (cw, w) = (several(mails.column(c).to_pylist(), deal, n) for c, n in (("u", 6), ("v", 8), ("w", 8)))
    return u, v, w, cu, cv, cw


def pair(v: np.ndarray, x: np.ndarray) -> np.ndarray:
    return mix(mix(v) + x)


def types(u: np.ndarray, v: np.ndarray, w: np.ndarray):
    """Places of the different trigrams, their counts, each one's bigram, places of the different bigrams among these and their counts."""
    both = pair(v, w)
    order, head, c3 = heads(mix(both + u))
    at = order[head]
    first, back, c2 = grouped(both[at])
    return at, c3, back, first, c2


def count_types(texts: DataFrame, deal: Deal, parts: int) -> list[DataFrame]:
    """(o, f, w, c), a table a part: o = 1: after how many different tokens w stands (a row for each shard that has some); o = 2, 3: how many bigrams and trigrams have the count w."""

    def run(mails: pa.Table) -> pa.Table:
        out = []
        for f in np.unique(mails.column("f").to_numpy()).tolist():
            u, v, w, *_ = opened(mails.filter(pa.compute.equal(mails.column("f"), f)), deal)
            at, c3, _, first, c2 = types(u, v, w)
            key, c1 = sorted_counts(w[at][first])
            rows = [(np.full(len(key), 1), key.view(np.int64), c1)]
            for o, c in ((2, c2), (3, c3)):
                rows.append((np.full(4, o), np.arange(1, 5), np.bincount(np.minimum(c, 5), minlength=6)[1:5]))
            out.append(pa.table([np.concatenate([r[0] for r in rows]), np.full(sum(len(r[0]) for r in rows), f), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])], names=["o", "f", "w", "c"]))
        trim()
        return pa.concat_tables(out)

    return [lean(training_mail(texts, deal, "w", k, parts).groupBy("_s").applyInArrow(lambda t: run(t), "o long, f long, w long, c long")) for k in range(parts)]


def three(counts: dict[int, int]) -> list[float]:
    n1, n2, n3, n4 = (max(counts.get(i, 0), 1) for i in range(1, 5))
    y = n1 / (n1 + 2 * n2)
    return [min(max(1 - 2 * y * n2 / n1, 0.05), 0.95), min(max(2 - 3 * y * n3 / n2, 0.05), 1.95), min(max(3 - 4 * y * n4 / n3, 0.05), 2.95)]


def train_tokens(texts: DataFrame, folds: int, deal: Deal, parts: int) -> tuple[DataFrame, list[float], list[DataFrame], dict]:
    """(_s, f, w, p): the probability of each token of each fold below bigrams, by shards; what each fold leaves to spelling, its byte model, and the discounts of bigrams and trigrams by (order, fold)."""
    words = lean(vocabulary(texts, deal.shards))
    spell = [train(words.filter(F.col("f") == k), "token") for k in range(folds)]
    spelling = []
    for k in range(folds):
        out, name = spelt(words.filter(F.col("f") == k).withColumn("_t", F.array("token")), spell[k], "_t")
        spelling.append(out.select("f", "w", F.exp(name).alias("q")))
    counted = count_types(texts, deal, parts)
    every = reduce(DataFrame.union, counted)
    found: dict[tuple[int, int], dict[int, int]] = {}
    for r in every.filter("o > 1").groupBy("o", "f", "w").agg(F.sum("c").alias("c")).collect():  # four rows an order and fold
        found.setdefault((r["o"], r["f"]), {})[r["w"]] = r["c"]
    taken = {(o, f): three(found.get((o, f), {})) for o in (2, 3) for f in range(folds)}
    t1 = lean(every.filter("o = 1").groupBy("f", "w").agg(F.sum("c").alias("c")))
    drop(*counted)
    off, left, total = F.lit(0.0), [0.0] * folds, F.lit(1)
    for k in range(folds):
        mine = t1.filter(F.col("f") == k)
        d = discounts(mine)
        own = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        r = mine.agg(F.sum("c").alias("total"), (F.sum(own) / F.sum("c")).alias("rest")).first()
        left[k] = float(np.log(r["rest"])) if r["rest"] else 0.0
        off, total = F.when(F.col("f") == k, own).otherwise(off), F.when(F.col("f") == k, F.lit(r["total"] or 1)).otherwise(total)
    rest = F.lit(1.0)
    for k in range(folds):
        rest = F.when(F.col("f") == k, F.lit(float(np.exp(left[k])))).otherwise(rest)
    p = F.greatest(F.col("c") - off, F.lit(0.0)) / total + rest * F.col("q")
    out = lean(dealt_tokens(t1.join(reduce(DataFrame.unionByName, spelling), ["f", "w"]).select("f", "w", p.cast("float").alias("p")), deal))
    drop(t1, words)
    return out, left, spell, taken


def off(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]


def summed(mails: pa.Table, docs: list[np.ndarray], values: np.ndarray) -> pa.Table:
    """SUMS of the values by mail and document."""
    rows, at = [], 0
    for chunk, doc in zip(mails.column("chunk").to_pylist(), docs):
        total = np.bincount(doc, weights=values[at : at + len(doc)])
        at += len(doc)
        some = np.flatnonzero(total)
        if len(some):
            rows.append((chunk, None, packed(some.astype(np.uint32)), packed(total[some])))
    return pa.Table.from_batches([sent(rows, SUMS)])


def directory(mails: pa.Table) -> pa.Table:
    return pa.Table.from_batches([sent([(c, k, None, None) for c, k in zip(mails.column("chunk").to_pylist(), mails.column("v").to_pylist())], SUMS)])


def added(sums: DataFrame) -> DataFrame:
    """(key, x): what each document of SUMS gets; copies of a row share a key and add up."""

    def run(t: pa.Table) -> pa.Table:
        keys, total = None, None
        for blob in t.column("keys").to_pylist():
            if blob is not None:
                keys = np.frombuffer(blob, np.int64)
        total = np.zeros(len(keys))
        for docs, x in zip(t.column("docs").to_pylist(), t.column("sums").to_pylist()):
            if docs is not None:
                np.add.at(total, unpacked(docs, np.uint32), unpacked(x, np.float64))
        return pa.table([keys, total], names=["key", "x"])

    return lean(sums.groupBy("chunk").applyInArrow(lambda t: run(t), "key long, x double"))


def numbered(batches):
    """(number, batch) with a number that no other batch of the job has, the same when a task is tried again."""
    from pyspark import TaskContext

    for k, batch in enumerate(batches):
        yield (TaskContext.get().partitionId() << 32) + k, batch


def frequent_logs(tokens_of: DataFrame, folds: int, deal: Deal) -> np.ndarray:
    """The log-probabilities of the frequent tokens by fold and number; NaN where a fold has not seen them, and for RARE."""

    def run(batches):
        for batch in batches:
            for s, f, w, p in zip(*[c.to_pylist() for c in batch.columns]):
                w, p = risen(w), unpacked(p, np.float32)
                c = deal.code(w)
                at = np.flatnonzero(c != RARE)
                at = at[deal.shard(c[at], w[at]) == s]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f)), pa.array(c[at].astype(np.int64)), pa.array(p[at].astype(np.float64))], names=["f", "c", "p"])

    rows = tokens_of.select("_s", "f", "w", "p").mapInArrow(run, "f long, c long, p double").toArrow()  # a row a frequent token and fold
    out = np.full((folds, RARE + 1), np.nan)
    out[rows.column("f").to_numpy(), rows.column("c").to_numpy()] = np.log(rows.column("p").to_numpy())
    return out


def token_sums(docs: DataFrame, tokens_of: DataFrame, left: list[float], spell: list[DataFrame], deal: Deal) -> list[DataFrame]:
    """(key, x) of docs (key, f, text): the tokens' log-probabilities below bigrams. Those of frequent tokens are at hand, the others are asked for in the shards, where unseen ones are spelt. Each pair of shards of the byte models takes a round of its own."""
    folds, out, shards, context = len(spell), [], [list(shards_of(m)) for m in spell], docs.sparkSession.sparkContext
    logs = context.broadcast(frequent_logs(tokens_of, folds, deal))

    def answering(number: int, shared):
        def answer(asks: pa.Table, entries: pa.Table) -> pa.Table:
            if not asks.num_rows:
                return pa.Table.from_batches([sent([], SUMS)])
            if asks.column("f")[0].as_py() < 0:
                rows = zip(*[asks.column(c).to_pylist() for c in ("chunk", "w", "raw")])
                return pa.Table.from_batches([sent([(chunk, keys, packed(np.arange(len(keys) // 8, dtype=np.uint32)), own) for chunk, keys, own in rows], SUMS)])
            known, models, fold = held_tokens(entries, folds), shared.value, asks.column("f").to_numpy()
            blobs = [asks.column(c).to_pylist() for c in ("w", "raw", "size", "at", "doc")]
            values, places = [None] * len(fold), [unpacked(b, np.uint32) for b in blobs[4]]
            for k in np.unique(fold).tolist():
                mine = np.flatnonzero(fold == k).tolist()
                each = [risen(blobs[0][i]) for i in mine]
                want, (key, here) = np.concatenate(each), known[k]
                value, hit = np.zeros(len(want)), np.zeros(len(want), bool)
                if len(key):
                    to = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    hit = key[to] == want
                    if number == 0:
                        value[hit] = np.log(here[to[hit]].astype(np.float64))
                miss = np.flatnonzero(~hit)
                if len(miss):
                    if number == 0:
                        value[miss] = left[k]
                    if models[k] is not None:
                        flat, size = np.concatenate([grown(blobs[1][i]) for i in mine]), np.concatenate([unpacked(blobs[2][i], np.uint32) for i in mine]).astype(np.int64)
                        first, back, _ = grouped(want[miss])
                        x = miss[first]
                        raw, ends = marked(flat, (np.cumsum(size) - size)[x], size[x])
                        value[miss] += np.concatenate([models[k].sums(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]) for i, j in chunks(ends)])[back]
                begin = 0
                for i, w in zip(mine, each):
                    values[i] = value[begin : begin + len(w)][unpacked(blobs[3][i], np.uint32)]
                    begin += len(w)
            trim()
            return summed(asks, places, np.concatenate(values))

        return lambda a, m: answer(a, m)

    def asking(number: int):
        def ask(batches):
            known = logs.value
            for chunk, batch in numbered(batches):
                fold, flat, base = batch.column(1).to_numpy(), utf8(batch.column(2))[0], 0
                own, found = np.zeros(batch.num_rows), []
                for row, t, _, (raw, starts, lens) in stretch(batch.column(2)):
                    c = deal.code(t)
                    x = known[fold[row], c]
                    rare = np.isnan(x)
                    if number == 0:
                        x[rare] = 0.0
                        own += np.bincount(row, weights=x, minlength=batch.num_rows)
                    at = np.flatnonzero(rare)
                    found.append((row[at], t[at], c[at], starts[at] + base, lens[at]))
                    base += len(raw)
                rows = [(deal.shards + chunk % deal.shards, chunk, -1, np.ascontiguousarray(batch.column(0).to_numpy()).tobytes(), packed(own), None, None, None)]
                row, t, c, starts, lens = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
                for f in range(folds):
                    x = np.flatnonzero(fold[row] == f)
                    if not len(x):
                        continue
                    first, back, _ = grouped(t[x])
                    y = x[first]  # the different tokens, by their hashes
                    s = deal.shard(c[y], t[y])
                    order = np.argsort(s, kind="stable")
                    begin = np.searchsorted(s[order], np.arange(deal.shards + 1))
                    rank = np.empty(len(y), np.int64)
                    rank[order] = np.arange(len(y))
                    place = rank[back]
                    by = np.argsort(place)
                    ends = np.searchsorted(place[by], begin)
                    for i in np.flatnonzero(np.diff(begin)).tolist():
                        k, z = y[order[begin[i] : begin[i + 1]]], by[ends[i] : ends[i + 1]]
                        text = flat[ranges(starts[k], lens[k])]
                        rows.append((i, chunk, f, rising(t[k]), shrunk(text), packed(lens[k].astype(np.uint32)), packed((place[z] - begin[i]).astype(np.uint32)), packed(row[x[z]].astype(np.uint32))))
                yield sent(rows, ASKED)
            trim()

        return ask

    for number in range(max(len(s) for s in shards)):
        shared = context.broadcast([s[number] if number < len(s) else None for s in shards])
        asks = docs.select("key", "f", "text").mapInArrow(asking(number), ddl(ASKED))
        out.append(added(asks.groupBy("_s").cogroup(tokens_of.groupBy("_s")).applyInArrow(answering(number, shared), ddl(SUMS))))
        shared.unpersist()
    logs.unpersist()
    return out


def dealt_tokens(tokens_of: DataFrame, deal: Deal) -> DataFrame:
    """(_s, f, w, p) of tokens (f, w, p): a row a shard and fold, with the tokens in order; those that are spread are in all shards of theirs."""

    def run(batches):
        for batch in batches:
            f, w, p = (batch.column(k).to_numpy() for k in range(3))
            w = w.view(np.uint64)
            c = deal.code(w)
            n = deal.spread[c]
            at = np.repeat(np.arange(len(w)), n)
            s = (deal.shard(c, w)[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) % deal.shards
            rows = []
            for k in np.unique(f).tolist():
                mine = at[f[at] == k]
                order, begin = cut(s[f[at] == k], c[mine], w[mine], deal.shards)
                for i in np.flatnonzero(np.diff(begin)).tolist():
                    x = mine[order[begin[i] : begin[i + 1]]]
                    x = x[np.argsort(w[x])]
                    rows.append((i, k, rising(w[x]), packed(p[x])))
            yield sent(rows, DEALT)
        trim()

    def join(t: pa.Table) -> pa.Table:
        w, p = (np.concatenate([get(b) for b in t.column(c).to_pylist()]) for c, get in (("w", risen), ("p", lambda b: unpacked(b, np.float32))))
        order = np.argsort(w)
        return pa.Table.from_batches([sent([(t.column("_s")[0].as_py(), t.column("f")[0].as_py(), rising(w[order]), packed(p[order]))], DEALT)])

    return tokens_of.select("f", "w", "p").mapInArrow(run, ddl(DEALT)).groupBy("_s", "f").applyInArrow(lambda t: join(t), ddl(DEALT))


def held_tokens(entries: pa.Table, folds: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The tokens of each fold in a shard, in order, and their probabilities."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.float32))] * folds
    for f, w, p in zip(*[entries.column(c).to_pylist() for c in ("f", "w", "p")]):
        out[f] = (risen(w), unpacked(p, np.float32))
    return out


def gram_sums(docs: DataFrame, texts: DataFrame, tokens_of: DataFrame, taken: dict, folds: int, deal: Deal, parts: int) -> list[DataFrame]:
    """(key, x) of docs (key, f, text): what bigrams and trigrams add to the tokens' log-probabilities, part by part of the middle tokens."""

    def trained(mails: pa.Table, entries: pa.Table) -> pa.Table:
        rows, known = [], held_tokens(entries, folds)
        for f in np.unique(mails.column("f").to_numpy()).tolist() if mails.num_rows else []:
            u, v, w, cu, cv, cw = opened(mails.filter(pa.compute.equal(mails.column("f"), f)), deal)
            at, c3, back, first, c2 = types(u, v, w)
            key, p = known[f]
            p, c2 = p[np.searchsorted(key, w[at[first]])][back], c2[back]
            u, v, w, cu, cv, cw = u[at], v[at], w[at], cu[at], cv[at], cw[at]
            s, n = deal.shard(cv, v, u), deal.spread[cv]
            # All shards of a token learn of its bigrams.
            many = np.flatnonzero(n > 1)
            many = many[np.unique(back[many], return_index=True)[1]]
            more = np.repeat(many, n[many])
            step = np.arange(len(more)) - np.repeat(np.cumsum(n[many]) - n[many], n[many])
            s = np.append(s, (deal.shard(cv[more], v[more]) + step) % deal.shards)
            c3 = np.append(c3, np.zeros(len(more), np.int64))
            take = np.append(np.arange(len(v)), more)
            order, begin = cut(s, cv[take], v[take], deal.shards)
            for k in np.flatnonzero(np.diff(begin)).tolist():
                x = order[begin[k] : begin[k + 1]]
                y = take[x]
                rows.append((k, f, letters(cv[y], v[y], 8), letters(cu[y], u[y]), letters(cw[y], w[y]), packed(c3[x].astype(np.uint32)), packed(c2[y].astype(np.uint32)), packed(p[y])))
        trim()
        return pa.Table.from_batches([sent(rows, TRAINED)])

    def answer(places: pa.Table, model: pa.Table) -> pa.Table:
        if not places.num_rows:
            return pa.Table.from_batches([sent([], SUMS)])
        if places.column("u")[0].as_py() is None:
            return directory(places)
        blobs = [places.column(c).to_pylist() for c in ("v", "u", "w", "doc")]
        v, u, w = (several(x, deal, n)[1] for n, x in zip((8, 6, 6), blobs))
        codes = [unpacked(b, np.uint32) for b in blobs[3]]
        fold, value = np.concatenate([c % folds for c in codes]), np.zeros(len(v))
        for f in range(folds):
            mine = np.flatnonzero(fold == f)
            rows = model.filter(pa.compute.equal(model.column("f"), f))
            if not rows.num_rows or not len(mine):
                continue
            got = [rows.column(c).to_pylist() for c in ("v", "u", "w", "c3", "c2", "p")]
            tv, tu, tw = (several(x, deal, n)[1] for n, x in zip((8, 6, 6), got))
            c3, c2 = (np.concatenate([unpacked(b, np.uint32) for b in x]).astype(np.int64) for x in got[3:5])
            p = np.concatenate([unpacked(b, np.float32) for b in got[5]]).astype(np.float64)
            # Bigrams and their contexts.
            both = pair(tv, tw)
            at, back, _ = grouped(both)
            two = Slots(both[at])
            one, inv, _ = grouped(tv[at])
            ones = Slots(tv[at[one]])
            taken2, total2 = off(c2[at], taken[2, f]), np.bincount(inv, weights=c2[at])
            rest2 = np.bincount(inv, weights=taken2) / total2
            p2 = np.maximum(c2[at] - taken2, 0.0) / total2[inv] + rest2[inv] * p[at]
            gain2 = np.log(p2) - np.log(p[at])
            # Trigrams and theirs.
            own = np.flatnonzero(c3)
            context = pair(tv[own], tu[own] + np.uint64(1 << 60))
            first, inv, _ = grouped(context)
            pairs = Slots(context[first])
            taken3, total3 = off(c3[own], taken[3, f]), np.bincount(inv, weights=c3[own])
            rest3 = np.bincount(inv, weights=taken3) / total3
            p3 = np.maximum(c3[own] - taken3, 0.0) / total3[inv] + rest3[inv] * p2[back[own]]
            three, gain3 = Slots(mix(both[own] + tu[own])), np.log(p3) - np.log(p[own])
            log1, log3 = np.log(rest2), np.append(np.log(rest3), 0.0)

            qv, qu, qw = v[mine], u[mine], w[mine]
            seen = ones.find(qv)
            here = np.flatnonzero(seen >= 0)  # else nothing with v was seen
            qv, qu, qw, mine, left1 = qv[here], qu[here], qw[here], mine[here], log1[seen[here]]
            both = pair(qv, qw)
            seen = three.find(mix(both + qu))
            out = np.append(gain3, 0.0)[seen]
            rest = np.flatnonzero(seen < 0)
            seen = two.find(both[rest])
            out[rest] = np.where(seen >= 0, gain2[seen], left1[rest]) + log3[pairs.find(pair(qv[rest], qu[rest] + np.uint64(1 << 60)))]
            value[mine] = out
        trim()
        return summed(places, [c // folds for c in codes], value)

    out = []
    for part in range(parts):

        def ask(batches, part=part):
            for chunk, batch in numbered(batches):
                row, u, v, w, cu, cv, cw = trigrams(batch.column(2), deal, "v", part, parts)
                code = row * folds + batch.column(1).to_numpy()[row] if len(row) else row
                order, begin = cut(deal.shard(cv, v, u & LOW48), cv, v, deal.shards)
                rows = [(deal.shards + chunk % deal.shards, chunk, np.ascontiguousarray(batch.column(0).to_numpy()).tobytes(), None, None, None)]
                for s in np.flatnonzero(np.diff(begin)).tolist():
                    x = order[begin[s] : begin[s + 1]]
                    rows.append((s, chunk, letters(cv[x], v[x], 8), letters(cu[x], u[x]), letters(cw[x], w[x]), packed(code[x].astype(np.uint32))))
                yield sent(rows, PLACES)
            trim()

        model = training_mail(texts, deal, "v", part, parts).groupBy("_s").cogroup(tokens_of.groupBy("_s")).applyInArrow(lambda t, m: trained(t, m), ddl(TRAINED))
        places = docs.select("key", "f", "text").mapInArrow(ask, ddl(PLACES))
        out.append(added(places.groupBy("_s").cogroup(model.groupBy("_s")).applyInArrow(lambda a, m: answer(a, m), ddl(SUMS))))
    return out


def log_likelihood(docs: DataFrame, texts: DataFrame, folds: int = 1, batch: int = BATCH, shard: int = HEAVY, parts: int = PARTS) -> tuple[DataFrame, str]:
    """docs (f, text and more) without the text, with n_bytes and the log-probability of each text under its fold's model of `texts`, and that column's name. batch: bytes of text a shard; shard: places of a token that go to one shard."""
    name = fresh([*docs.columns, "n_bytes", "_key"], "log_p")
    keyed = docs.withColumn("_key", F.xxhash64(*docs.columns))
    rows = keyed.select(F.col("_key").alias("key"), "f", "text")
    deal = Deal(*frequent_tokens(docs), n_batches(docs, "text", batch, 24), shard)
    tokens_of, left, spell, taken = train_tokens(texts, folds, deal, TRAIN_PARTS)
    sums = token_sums(rows, tokens_of, left, spell, deal)
    sums += gram_sums(rows, texts, tokens_of, taken, folds, deal, parts)
    drop(tokens_of, *spell)
    total = reduce(DataFrame.union, sums).groupBy(F.col("key").alias("_key")).agg(F.sum("x").alias("_x"), F.count("*").alias("_n"))
    # Copies of a row have one key; each of them gave every table of sums a row.
    value = F.coalesce(F.col("_x") / (F.col("_n") / len(sums)), F.lit(0.0))
    held = keyed.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text")
    return held.join(total, "_key", "left").withColumn(name, value).drop("_key", "_x", "_n"), name


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tails: tuple[float, float] = TAILS) -> DataFrame:
    """doc_id, n_bytes, perplexity, low, high (bounds of its language), keep. trusted: ids of trusted documents."""
    ids = written(trusted.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_trusted")).distinct())
    side = F.broadcast(ids) if ids.count() <= SMALL else ids
    marked = docs.join(side, F.col(id_col) == F.col("_trusted"), "left")
    fold = F.pmod(F.xxhash64(F.col(id_col), F.lit("fold")), F.lit(FOLDS))
    rows = marked.select(fold.alias("f"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col("_trusted").isNotNull().alias("calibrates"))
    scored, name = log_likelihood(rows, rows.filter("calibrates").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FOLDS - 1).cast("long"))).alias("g"), "f", "text").filter("g <> f").select(F.col("g").alias("f"), "text"), FOLDS)
    n = F.col("n_bytes")
    scored = written(scored.select("doc_id", "lang", "calibrates", "n_bytes", F.when(n > 0, F.exp(-F.col(name) / n).cast("float").cast("double")).alias("perplexity")))
    scored = scored.withColumn("band", F.floor(F.log2(F.greatest("n_bytes", F.lit(1)))))
    known = scored.filter("calibrates and perplexity is not null")
    two = [F.percentile_approx("perplexity", q, 10000) for q in (tails[0], 1 - tails[1])]
    fine = known.groupBy("lang", "band").agg(two[0].alias("low2"), two[1].alias("high2"), F.count("*").alias("_n")).filter(F.col("_n") >= FEW).drop("_n")
    each = known.groupBy("lang").agg(two[0].alias("low1"), two[1].alias("high1"))
    whole = known.agg(two[0].alias("low"), two[1].alias("high")).first()
    held = scored.join(F.broadcast(fine), ["lang", "band"], "left").join(F.broadcast(each), "lang", "left")  # rows a language and band
    low, high = (F.coalesce(F.col(f"{c}2"), F.col(f"{c}1"), F.lit(whole[c]).cast("double")) for c in ("low", "high"))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity").between(low, high), F.lit(True))
    return held.select("doc_id", "n_bytes", "perplexity", low.alias("low"), high.alias("high"), keep.alias("keep"))


def op1_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted)


QUERIES = {"op1_kneser_ney": op1_kneser_ney}
ORACLES: dict[str, str] = {}
