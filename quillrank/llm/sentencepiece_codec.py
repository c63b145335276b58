"""SentencePiece encoding and decoding of merge-type vocabularies.

Encoding works on a score-ordered agenda of adjacent symbol pairs: the best-scoring pair that
makes a piece is merged first, the leftmost one on equal scores, until no pair makes a piece.
No piece of such a vocabulary holds the space mark after another character (this is checked when
the model is loaded), so no merge crosses the end of a run "spaces, then other characters".

An Arrow batch is cut into runs, equal runs are found by dictionary encoding, and only runs met for
the first time are merged: many runs side by side, as rows of numpy matrices that hold each run's
symbols, links to the neighbours and the agenda, one merge of every row a step. Ids and decoded
bytes of all runs are then gathered with Arrow's take. A worker process keeps the ids of earlier
runs up to a bound of bytes. In every batch the ids of all new runs, and the text decoded from them,
are checked against the sentencepiece library; a difference raises.

Defined results: null text is an empty text; an empty text has no ids and decodes to an empty
text. Texts of any length are taken whole. Repeated rows give repeated results, an empty table an
empty one. Extra columns stay; on a name clash the result columns get leading underscores.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quillrank.llm.common import annotate, chunks, per_process, ranges, table, utf8

SPACE = "▁"
#: A run of blanks with what follows it up to the next blank.
RUN = re.compile("[ ▁]*[^ ▁]+|[ ▁]+")
#: Runs of more symbols than the last go through a heap one by one; the others lie in matrices of these widths.
WIDTHS = (8, 12, 16, 24, 40)
#: Bytes of ids, and number of runs, that a worker process keeps; the longest run it keeps.
KEPT_BYTES, KEPT_RUNS, KEPT_LENGTH = 12 << 20, 250_000, 64
#: Bytes of texts cut into runs at once (a longer text alone), runs gathered at once, and bytes of a line that the library checks.
SLICE, PART, LINE = 1 << 20, 120_000, 1024
NONE = np.uint32(0xFFFFFFFF)


class Vocabulary:
    """The pieces of a serialised merge-type model without a text normaliser."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or not spec.trainer_spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback, a leading blank and no normaliser is needed")
        self.library = SentencePieceProcessor(model_proto=model)
        kinds = proto.ModelProto.SentencePiece
        self.ids, self.rank, self.byte_ids, self.raw = {}, {}, {}, []
        for i, p in enumerate(spec.pieces):
            if p.type in (kinds.USER_DEFINED, kinds.UNUSED):
                raise ValueError("user-defined and unused pieces are not supported")
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
                self.raw.append(bytes([int(p.piece[1:-1], 16)]))
            elif p.type == kinds.NORMAL:
                if SPACE in p.piece.lstrip(SPACE):
                    raise ValueError("a piece holds the space mark after another character")
                self.ids[p.piece] = i
                self.rank[p.piece] = -p.score
                self.raw.append(p.piece.replace(SPACE, " ").encode())
            else:
                self.raw.append(b"")
        if len(self.raw) > 1 << 16 or 0 in self.ids.values():
            raise ValueError("at most 2^16 pieces are supported, and the first one must not stand for text")
        if any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("a piece has a character that is no piece")

        #: Adjacent characters inside pieces: no merge joins any others.
        self.inner = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: Piece of each character (0: none); blanks are space marks.
        self.symbol = np.zeros(0x110000, np.uint16)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(" " if p == SPACE else p)] = i
        self._pairs()
        self.raw_array = pa.array(self.raw, pa.binary())
        self.decimal = pa.array([b"%d," % i for i in range(len(self.raw))], pa.binary())

    def _pairs(self) -> None:
        """A hash table of all pairs of pieces that make a piece: its place in the order of scores, and its id."""
        scores = np.array(sorted(set(self.rank.values())))
        place = {s: k for k, s in enumerate(scores.tolist())}
        #: With a score for each piece, a pair's place and id are compared as one number.
        self.one_score = len(scores) == len(self.rank)
        key, value = [], []
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                if a is not None and b is not None:
                    key.append(a << 16 | b)
                    value.append(place[self.rank[p]] << 16 | i)
        key, value = np.array(key, np.uint32), np.array(value, np.uint32)
        bits = max(8, int(len(key) * 4).bit_length())
        self.shift = np.uint32(32 - bits)
        self.table_key, self.table_value = np.zeros((1 << bits) + 4096, np.uint32), np.full((1 << bits) + 4096, NONE)
        todo, at = np.arange(len(key)), self._hash(key)
        while len(todo):
            free = self.table_key[at[todo]] == 0
            some, first = np.unique(at[todo[free]], return_index=True)
            won = todo[free][first]
            self.table_key[some], self.table_value[some] = key[won], value[won]
            lost = np.ones(len(key), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] += 1

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place in the order of scores and id of the piece that each pair makes (NONE: it makes none)."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b
        at = self._hash(key)
        have = self.table_key[at]
        out = np.where(have == key, self.table_value[at], NONE)
        todo = np.flatnonzero((have != key) & (have != 0))
        while len(todo):
            at[todo] += 1
            have = self.table_key[at[todo]]
            hit = have == key[todo]
            out[todo[hit]] = self.table_value[at[todo[hit]]]
            todo = todo[~hit & (have != 0)]
        return out

    def merge(self, text: str) -> list[str]:
        """The symbols left when no adjacent pair makes a piece, by a heap."""
        symbols, rank = list(text), self.rank
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap = [(r, i, i + 1, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, made = heapq.heappop(heap)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != made:
                continue
            symbols[i], symbols[j] = made, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank.get(x := made + symbols[k])) is not None:
                    heapq.heappush(heap, (r, i, k, x))
            if (h := before[i]) >= 0 and (r := rank.get(x := symbols[h] + made)) is not None:
                heapq.heappush(heap, (r, h, i, x))
        return [s for s in symbols if s is not None]

    def encode_run(self, run: str) -> list[int]:
        """Ids of one run, blanks given as space marks."""
        out: list[int] = []
        cuts = [i for i in range(1, len(run)) if run[i - 1 : i + 1] not in self.inner]
        for i, j in zip([0, *cuts], [*cuts, len(run)]):
            for s in self.merge(run[i:j]):
                k = self.ids.get(s)
                out += [k] if k is not None else [self.byte_ids[b] for b in s.encode()]
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, as the library's encode without begin or end ids."""
        return [i for run in RUN.findall((SPACE + text).replace(" ", SPACE)) for i in self.encode_run(run)] if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids, as the library's decode: a blank that leads the first piece goes; each byte that is no UTF-8 becomes a replacement character."""
        raw = b"".join([self.raw[i] for i in ids])
        return to_text(raw.removeprefix(b" ") if ids and ids[0] not in self.byte_ids.values() else raw)

    def encode_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all runs, where each run's begin): the agendas of many runs side by side. Runs are UTF-8 with plain blanks."""
        flat, offs = utf8(runs)
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        begin = np.append(0, np.cumsum((flat & 0xC0) != 0x80, dtype=np.int64))[offs]
        size = np.diff(begin)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (rows, ids a row, ids)
        least = 0
        for width in WIDTHS:
            rows = np.flatnonzero((size > least) & (size <= width))
            for k in range(0, len(rows), 1 << 15):
                some = rows[k : k + (1 << 15)]
                parts.append((some, *self._merge_rows(points, begin[some], size[some], width)))
            least = width
        for r in np.flatnonzero(size > least):
            ids = np.array(self.encode_run(flat[offs[r] : offs[r + 1]].tobytes().decode().replace(" ", SPACE)), np.int32)
            parts.append((np.array([r]), np.array([len(ids)]), ids))
        count = np.zeros(len(runs), np.int64)
        for rows, n, _ in parts:
            count[rows] = n
        out_begin = np.append(0, np.cumsum(count))
        out = np.zeros(out_begin[-1], np.int32)
        for rows, n, ids in parts:
            out[ranges(out_begin[rows], n)] = ids
        return out, out_begin

    def _merge_rows(self, points: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each run, their ids) for runs of at most `width` symbols."""
        n, stride = len(begin), width + 2  # a column before and one behind take writes past the ends
        column = np.arange(stride)
        real = (column > 0) & (column <= size[:, None])
        place = np.minimum(begin[:, None] + np.maximum(column - 1, 0), len(points) - 1)
        char = points[place]
        symbols = np.where(real, self.symbol[char], np.uint16(0))
        agenda = np.full((n, stride), NONE)
        some = real[:, :-1] & real[:, 1:]
        agenda[:, :-1][some] = self.look(symbols[:, :-1][some], symbols[:, 1:][some])
        alive = real.copy()
        after = np.tile((column + 1).astype(np.int16), n)
        before = np.tile((column - 1).astype(np.int16), n)
        s, a, live = symbols.ravel(), agenda.ravel(), alive.ravel()
        rows = np.arange(n)
        while len(rows):
            open_ = agenda[rows]
            i = (open_ if self.one_score else open_ >> np.uint32(16)).argmin(axis=1)
            best = open_[np.arange(len(rows)), i]
            going = best != NONE
            rows, i, best = rows[going], i[going], best[going]
            base = rows * stride
            left = base + i
            right = base + after[left]
            s[left] = best & np.uint32(0xFFFF)
            live[right], a[right] = False, NONE
            k = after[right]
            after[left] = k
            next_ = base + k
            before[next_] = i
            prev = base + before[left]
            # Columns outside the run hold symbol 0, which no piece is made of.
            a[left] = self.look(s[left], s[next_])
            inside = before[left] > 0
            a[prev[inside]] = self.look(s[prev[inside]], s[left[inside]])
        ids = s[live].astype(np.int32)
        count = alive.sum(axis=1)
        unknown = np.flatnonzero(ids == 0)
        if len(unknown):  # characters that are no piece become the ids of their bytes
            what, which = np.unique(char.ravel()[live][unknown], return_inverse=True)
            spelt = [[self.byte_ids[b] for b in chr(c).encode()] for c in what.tolist()]
            length = np.array([len(x) for x in spelt])
            repeat = np.ones(len(ids), np.int64)
            repeat[unknown] = length[which]
            owner = np.repeat(np.arange(n), count)
            at = np.cumsum(repeat) - repeat
            ids = np.repeat(ids, repeat)
            pool, first = np.array(list(chain.from_iterable(spelt)), np.int32), np.cumsum(length) - length
            ids[ranges(at[unknown], length[which])] = pool[ranges(first[which], length[which])]
            count = np.bincount(owner, repeat, minlength=n).astype(np.int64)
        return count, ids


def to_text(raw: bytes) -> str:
    """UTF-8; one replacement character for each byte that is none, as the library has it."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))
        return raw.decode("utf-8", errors="each_byte")


def binary(offs: np.ndarray, data) -> pa.Array:
    """A binary array over a buffer (the offsets must fit 32 bits)."""
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs.astype(np.int32))), pa.py_buffer(data)])


class Codec:
    """Encodes batches of texts, run by run, with the ids of earlier runs at hand."""

    def __init__(self, model: bytes, check: bool = True):
        self.vocabulary, self.check = Vocabulary(model), check
        #: Known runs and their places in `held`, which has their ids, four bytes each; the oldest come first.
        self.known: dict[bytes, int] = {}
        self.held = pa.array([], pa.binary())

    def learn(self, runs: pa.Array) -> pa.Array:
        """Ids of distinct runs (UTF-8, plain blanks), as 32-bit numbers."""
        ids, begin = self.vocabulary.encode_runs(runs)
        if self.check:
            self._compare(runs, ids, begin)
        return binary(4 * begin, ids)

    def _compare(self, runs: pa.Array, ids: np.ndarray, begin: np.ndarray) -> None:
        """The library's ids of lines of runs, and its text for these ids, must be ours. It puts a blank before a line, so a line's own first one stays out."""
        flat, offs = utf8(runs)
        blank = flat[offs[1:] - 1] == 32  # nothing but blanks: they would run on into the next run
        lines, spans = [], []
        i, n = 0, len(runs)
        raw = flat.tobytes()
        while i < n:
            if blank[i]:
                line, j, lead = "a" + raw[offs[i] : offs[i + 1]].decode(), i + 1, self.vocabulary.encode_run(SPACE + "a")
            else:
                j = max(i + 1, int(np.searchsorted(offs, offs[i] + LINE, "right")) - 1)
                stop = np.flatnonzero(blank[i:j])
                j = i + int(stop[0]) if len(stop) else j
                line, lead = raw[offs[i] + 1 : offs[j]].decode(), []
            lines.append(line)
            spans.append((i, j, lead))
            i = j
        library = self.vocabulary.library
        said = library.encode(lines, num_threads=1, out_type="numpy")
        for line, (i, j, lead), theirs in zip(lines, spans, said):
            if not np.array_equal(theirs[len(lead) :], ids[begin[i] : begin[j]]) or theirs[: len(lead)].tolist() != lead:
                raise AssertionError(f"ids of {line[:40]!r} differ from the library's")
        made = pc.take(self.vocabulary.raw_array, pa.array(ids))
        data, ends = utf8(made)
        data = data.tobytes()
        for text, (i, j, lead) in zip(library.decode(said, num_threads=1), spans):
            ours = data[ends[begin[i]] : ends[begin[j]]].decode()
            if text != ("a" + ours if lead else ours[1:]):
                raise AssertionError(f"the text decoded from the ids of {ours[:40]!r} differs from the library's")

    def runs_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all texts with a blank before each, where each run starts and the end, first run of each text and one more). Empty texts have no run."""
        if pc.any(pc.match_substring(texts, SPACE)).as_py():
            texts = pc.replace_substring(texts, SPACE, " ")
        flat, offs = utf8(texts)
        size = np.diff(offs)
        some = size > 0
        shift = np.cumsum(some)
        begin = offs[:-1] + shift - some
        out = np.full(len(flat) + int(shift[-1] if len(shift) else 0), 32, np.uint8)
        inside = np.ones(len(out), bool)
        inside[begin[some]] = False
        out[inside] = flat
        blank = out == 32
        head = blank.copy()
        head[1:] &= ~blank[:-1]
        head[begin[some]] = True  # a text's end closes its last run
        # A text's own leading blanks belong to its first run.
        starts = np.flatnonzero(head)
        return out, np.append(starts, len(out)), np.searchsorted(starts, np.append(begin, len(out)))

    def pieces(self, texts: pa.Array):
        """(first text, last text and one more, number of ids of each, ids as 32-bit numbers): parts of the batch in order; a text of many runs comes in several parts."""
        _, offs = utf8(texts)
        for s, e in chunks(offs, SLICE):
            for text, last, counts, ids in self._pieces(texts.slice(s, e - s)):
                yield s + text, s + last, counts, ids

    def _pieces(self, texts: pa.Array):
        flat, starts, first = self.runs_of(texts)
        n, i, text = len(starts) - 1, 0, 0
        while i < n:
            j = min(n, i + PART)
            lo, hi = starts[i], starts[j]
            runs = binary(starts[i : j + 1] - lo, np.ascontiguousarray(flat[lo:hi])).dictionary_encode()
            flat_runs, cuts = utf8(runs.dictionary)
            raw, cuts = flat_runs.tobytes(), cuts.tolist()
            found = [raw[x:y] for x, y in zip(cuts[:-1], cuts[1:])]
            pick = np.fromiter(map(self.known.get, found, repeat(-1)), np.int64, len(found))
            fresh = np.flatnonzero(pick < 0)
            made = self.learn(runs.dictionary.take(pa.array(fresh)))
            pick[fresh] = len(self.held) + np.arange(len(fresh))
            every = pa.concat_arrays([self.held, made])
            got = every.take(pa.array(pick)).take(runs.indices)
            self._keep([found[k] for k in fresh.tolist()], every)
            del found, raw, every
            data, ends = utf8(got)
            ids, ends = data.view(np.int32) if len(data) else np.zeros(0, np.int32), ends // 4
            last = int(np.searchsorted(first, j, "left"))  # texts that begin before run j
            bounds = np.clip(first[text : last + 1], i, j) - i
            yield text, last, np.diff(ends[bounds]), ids
            text = last if first[last] == j else last - 1
            i = j

    def _keep(self, new: list[bytes], every: pa.Array) -> None:
        """Adds new runs; beyond the bounds the older half goes. A long run's ids stay until then, but it is not found again."""
        at = len(self.held)
        self.known.update(zip(new, range(at, len(every))))
        for r in [r for r in new if len(r) > KEPT_LENGTH]:
            del self.known[r]
        self.held = every
        if len(every) > KEPT_RUNS or every.nbytes > KEPT_BYTES:
            size = np.cumsum(pc.binary_length(every).to_numpy()[::-1])
            n = min(KEPT_RUNS // 2, int(np.searchsorted(size, KEPT_BYTES // 2)))
            gone = len(every) - n
            self.known = {r: k - gone for r, k in self.known.items() if k >= gone}
            self.held = pa.concat_arrays([every.slice(gone), pa.array([], pa.binary())])

    def text_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes of all ids, and where each id's begin."""
        return utf8(pc.take(self.vocabulary.raw_array, pa.array(ids)))

    def batch(self, texts: list[str | None]) -> list[tuple[list[int], str]]:
        """For each text its ids and the text decoded from them."""
        ids, raw = [[] for _ in texts], [[] for _ in texts]
        for s, e, counts, part in self.pieces(pc.fill_null(pa.array(texts, pa.string()), "")):
            data, ends = self.text_bytes(part)
            at = np.append(0, np.cumsum(counts))
            for t, i, j in zip(range(s, e), at[:-1].tolist(), at[1:].tolist()):
                ids[t] += part[i:j].tolist()
                raw[t].append(data[ends[i] : ends[j]].tobytes())
        return [(i, to_text(b"".join(r).removeprefix(b" "))) for i, r in zip(ids, raw)]


def load_model(path: str, limit: int = 64 << 20) -> bytes:
    """The serialised model; it travels to the executors, so its size is checked."""
    with open(path, "rb") as f:
        model = f.read(limit + 1)
    if len(model) > limit:
        raise ValueError(f"the model file has more than {limit} bytes")
    return model


def codec_starter(spark: SparkSession, model_path: str, check: bool):
    model = spark.sparkContext.broadcast(load_model(model_path))
    return lambda: per_process(("codec", hashlib.sha256(model.value).digest(), check), lambda: Codec(model.value, check))


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """docs with ids array<int> and decoded string."""
    start = codec_starter(docs.sparkSession, model_path, check)

    def begin():
        codec = start()

        def step(texts):
            texts = pc.fill_null(texts.cast(pa.string()), "")
            total, size = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            ids, raw = [np.zeros(0, np.int32)], [np.zeros(0, np.uint8)]
            for s, e, counts, part in codec.pieces(texts):
                data, ends = codec.text_bytes(part)
                at = np.append(0, np.cumsum(counts))
                head = (total[s:e] == 0) & (counts > 0)  # the blank that leads a text's first run goes
                total[s:e] += counts
                size[s:e] += np.diff(ends[at]) - head
                stay = np.ones(len(data), bool)
                stay[ends[at[:-1][head]]] = False
                ids.append(part)
                raw.append(data[stay])
            ids, raw = np.concatenate(ids), np.concatenate(raw)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(total)).astype(np.int32)), pa.array(ids))
            texts_out = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(np.append(0, np.cumsum(size)).astype(np.int32)), pa.py_buffer(raw)])
            texts_out.validate(full=True)
            return [lists, texts_out]

        return step

    return annotate(docs, [text_col], [("ids", "array<int>"), ("decoded", "string")], begin, SLICE)


def encode_digest(docs: DataFrame, model_path: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 of what encode_decode makes."""
    start = codec_starter(docs.sparkSession, model_path, check)

    def begin():
        codec = start()

        def step(texts):
            texts = pc.fill_null(texts.cast(pa.string()), "")
            total = np.zeros(len(texts), np.int64)
            of_ids, of_text = [None] * len(texts), [None] * len(texts)
            for s, e, counts, part in codec.pieces(texts):
                data, ends = codec.text_bytes(part)
                said, stops = utf8(pc.take(codec.vocabulary.decimal, pa.array(part)))
                at = np.append(0, np.cumsum(counts))
                for t, i, j, k, m, x, y in zip(range(s, e), *(z.tolist() for z in (at[:-1], at[1:], stops[at[:-1]], stops[at[1:]], ends[at[:-1]], ends[at[1:]]))):
                    if i == j:
                        continue
                    if of_ids[t] is None:
                        of_ids[t], of_text[t] = hashlib.sha256(said[k : m - 1]), hashlib.sha256(data[x + 1 : y])
                    else:  # a text that goes on from the part before
                        of_ids[t].update(b",")
                        of_ids[t].update(said[k : m - 1])
                        of_text[t].update(data[x:y])
                total[s:e] += counts
            none = hashlib.sha256(b"")
            return [pa.array(total), *[pa.array([(h or none).hexdigest() for h in x], pa.string()) for x in (of_ids, of_text)]]

        return step

    return annotate(docs, [text_col], [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")], begin, SLICE)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(table(spark, sf_dir, "documents").select("doc_id", "text"), default_model()).drop("text")


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
