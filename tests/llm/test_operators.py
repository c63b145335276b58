"""Each corpus operator against brute force, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillrank.llm import chat_format, decontaminate, kneser_ney, language, linear, minhash_join, sentencepiece_codec, suffix_dedup, topk_search, toxicity, training_order

DOCS = "doc_id long, text string, lang string, n_words string, n_bytes string"


def texts(seed=1, n=40):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.randint(20, 60))) for _ in range(n)]
    base[3] = base[2]
    base[5] = base[4].replace(" ", " ", 1) + " zz"
    base[7] = base[6][:80] + base[1][:200] + base[8][-60:]
    return base


@pytest.fixture(scope="module")
def rows():
    t = texts()
    extra = [(100, None), (101, ""), (102, " .,;"), (103, "one two"), (103, "one two"), (None, t[0]), (104, t[0] * 30), (105, "☃ " + t[9] + " ☃"), (106, t[9])]
    return [(i, x, "en", "taken", "too") for i, x in enumerate(t)] + [(i, x, None, None, None) for i, x in extra]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sort(rows):
    return sorted(map(tuple, rows), key=str)


# suffix arrays


def test_suffix_array_matches_definition(docs, rows):
    made = suffix_dedup.removal(docs, batches=3)
    assert made.columns == [*docs.columns, "_n_bytes", "n_removed", "n_spans", "kept"]
    got = made.select("doc_id", "_n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    want = suffix_dedup.brute_force([(r[0], r[1]) for r in rows])
    assert sort(got) == sort(want)
    assert sum(w[2] > 0 for w in want) > 4


def test_suffix_array_hot_anchor_and_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 400)
    got = suffix_dedup.removal(docs, batches=2).select("doc_id", "_n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sort(got) == sort(suffix_dedup.brute_force([(r[0], r[1]) for r in rows]))


def test_suffix_array_over_relays(docs, rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ENVELOPE", 200)
    monkeypatch.setattr(suffix_dedup, "RELAY", 1000)
    made = suffix_dedup.removal(docs, batches=7, direct=6)
    got = made.select("doc_id", "_n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sort(got) == sort(suffix_dedup.brute_force([(r[0], r[1]) for r in rows]))


def test_relays_bring_every_letter_in_few_envelopes(spark):
    n, fan = 100, 10
    rows = [r for p in range(n) for r in suffix_dedup.mailed([(k, b"%d-%d" % (p, k)) for k in range(n)], p, fan).to_pylist()]
    assert len(rows) == n * fan
    got = suffix_dedup.relayed(spark.createDataFrame([(r["_to"], r["_blob"]) for r in rows], suffix_dedup.MAIL), fan).toArrow()
    assert len(got) == n
    letters = [x for blob in got.column("_blob").to_pylist() for x in suffix_dedup.opened(blob)]
    assert sorted(letters) == sorted((k, p, b"%d-%d" % (p, k)) for p in range(n) for k in range(n))


def test_suffix_array_of_text():
    flat = np.frombuffer(b"mississippi" * 3 + b"\0ab", np.uint8)
    sa = suffix_dedup.suffix_array(flat)
    raw = flat.tobytes()
    assert sa.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    lcp = suffix_dedup.common_prefixes(flat, sa, lane=4)
    for a, b, n in zip(sa[:-1], sa[1:], lcp[1:]):
        x, y = raw[a:], raw[b:]
        k = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert n == min(k, 50)


def test_blocks_merge_by_binary_search():
    r = random.Random(3)
    common = bytes(r.randrange(97, 100) for _ in range(60))
    made = []
    for own in (b"x" * 30, b"y" * 30):
        flat = np.frombuffer(own + common, np.uint8)
        sa, low = suffix_dedup.class_minima(flat, np.array([0]), np.array([41]), np.array([len(made) + 5]))
        made.append((flat, sa, low))
    suffix_dedup.merge_blocks(*made)
    assert made[1][2][30:41].tolist() == [5] * 11 and set(made[1][2][:30].tolist()) == {6}


def test_suffix_array_empty_table(empty):
    assert suffix_dedup.removal(empty).count() == 0


def test_cut_text_stays_valid(spark):
    shared = "é" * 40
    df = spark.createDataFrame([(1, "a" + shared, 9), (2, "b" + shared + "c", 9), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r[0]: (r[1], r[2]) for r in suffix_dedup.removed_text(df, length_col="n_chars").collect()}
    assert got == {1: ("a" + shared, 9), 2: ("bc", 2), 3: (None, None)}


# decontamination


def brute_contamination(docs, items, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for name, item in items:
            iw = split(item)
            if name is None or not iw:
                continue
            n = min(window, len(iw))
            for k in range(len(iw) - n + 1):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == iw[k : k + n]:
                        hit.update(range(s, s + n))
                        found.add(str(name))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [8 << 20, 150])
def test_decontamination_matches_definition(spark, docs, rows, block):
    t = texts()
    words = t[10].split()
    items = [(1, " ".join(words[3:19])), (2, t[11].upper() if t[11].isascii() else t[11]), (12, "one two"), (3, "zz"), (4, None), (5, " - "), (None, t[12]), (1, " ".join(words[3:19])), (6, t[2] + " extra " + t[14])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    made = decontaminate.mark(docs, bench, block_bytes=block)
    new = made.columns[len(docs.columns) :]
    assert new[0] == "_n_words"
    got = made.select("doc_id", new[0], new[1], F.size(new[3]), F.sha2(F.array_join(new[3], ","), 256)).collect()
    want = brute_contamination([(r[0], r[1]) for r in rows], items)
    assert sort(got) == sort(want)
    assert sum(w[2] > 0 for w in want) >= 5


def test_decontamination_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, none).count() == docs.count()
    assert decontaminate.remove_contaminated(empty, none).columns == docs.columns


# near-duplicates


def test_near_duplicates_match_all_pairs(docs, rows):
    got = {}
    for r in minhash_join.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], set()).add(tuple(r)[1:])
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    sets = [(r[0], {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := split(r[1])) else set()) for r in rows if r[0] is not None]
    for a, x in sets:
        links = sum(len(x & y) >= 0.8 * len(x | y) for _, y in sets if x and y) - (1 if x else 0)
        assert {g[2] for g in got[a]} == {links}, a
    assert got[3] == {(2, 2, 1)} and got[5] == {(4, 5, 1)} and got[103] == {(103, 103, 1)}
    assert got[100] == {(100, 100, 0)} and got[None] == {(None, None, 0)}
    assert got[106] == got[9] == {(9, 9, 2)} or got[106] != {(106, 106, 0)}


def test_large_component_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK", 4)
    base = texts(5)[0].split()
    df = spark.createDataFrame([(i, " ".join([*base, *base[::-1], f"end{i}"])) for i in range(20)], "doc_id long, text string")
    got = minhash_join.near_duplicates(df).collect()
    assert {(r["class_id"], r["n_links"]) for r in got} == {(0, 19)}
    assert [r["doc_id"] for r in minhash_join.one_of_each(df).collect()] == [0]


def test_repeated_ids_are_judged_by_their_words(spark):
    a, b, c = texts(6, 20)[10:13]
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, None), (8, None), (9, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(map(tuple, minhash_join.near_duplicates(df).collect()))
    assert got == sorted([(3, 3, 3, 1), (5, 3, 3, 1), (5, 5, 5, 0), (7, 7, 7, 2), (7, 7, 7, 2), (9, 7, 7, 2), (8, 8, 8, 0), (8, 8, 8, 0)])
    assert sort(minhash_join.one_of_each(df).collect()) == sort([(3, a), (5, b), (7, c), (8, None), (8, None)])


def test_a_chain_of_buckets_does_not_compare_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash_join, "BLOCK", 4)
    keys = [(k, r) for k in range(200) for r in (k, k + 1)] + [(1000, r) for r in range(500, 512)]
    blocks, parts = minhash_join.candidate_blocks(spark.createDataFrame(keys, "key long, rep long"))
    size = {r["blk"]: r["count"] for r in blocks.groupBy("blk").count().collect()}
    of = {r["rep"]: r["blk"] for r in blocks.collect()}
    pairs = {}
    for r in parts.collect():
        pairs.setdefault(r["pair"], []).append(r["blk"])
    compared = sum(sum(size[x] for x in b) ** 2 for b in pairs.values())
    assert compared < 0.1 * 200**2
    met = {frozenset(b) for b in pairs.values()}
    assert all(frozenset((of[x], of[y])) in met for x, y in [(k, k + 1) for k in range(200)] + [(x, y) for x in range(500, 512) for y in range(x, 512)])


def test_recall_on_a_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    held = {r["doc_id"]: r for r in minhash_join.near_duplicates(df).collect()}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    sets = {r["doc_id"]: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for r in df.collect() if (w := split(r["text"]))}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = [p for p in pairs if held[p[0]]["class_id"] == held[p[1]]["class_id"]]
    assert pairs and len(found) >= 0.9 * len(pairs)
    assert sum(held[d]["n_links"] for d in sets) >= 0.9 * 2 * len(pairs)


def test_near_duplicates_empty(empty):
    assert minhash_join.near_duplicates(empty).count() == 0
    assert minhash_join.one_of_each(empty).columns == empty.columns


def test_banding_reaches_recall():
    bands, rows = minhash_join.bands_for()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999


# sentencepiece

ODD = ["", " ", "a", " a", "  a  b ", "\n\n x", "日本語 テスト 😀", "a▁b ▁", "x" * 300, "<s> </s> [INST]", "\0 a\1", "ab" * 900 + " " * 50 + "cd" * 20, "é" * 100, " \t\r\n "]


def test_codec_equals_library():
    model = sentencepiece_codec.load_model(sentencepiece_codec.default_model())
    c = sentencepiece_codec.Codec(model)
    cases = ODD + texts(9, 30)
    for text, (got, decoded), ids in zip(cases, c.batch(cases), c.vocabulary.library.encode(cases)):
        assert got == ids == c.vocabulary.encode(text)
        assert decoded == c.vocabulary.library.decode(ids)
    r = random.Random(2)
    odd = ["".join(r.choice("ab  ▁é☃\n\t.the  日本語😀ñ ") for _ in range(r.randint(1, 80))) for _ in range(500)]
    assert [ids for ids, _ in c.batch(odd)] == c.vocabulary.library.encode(odd)
    for _ in range(200):
        ids = [r.choice([r.randrange(3, 32000), r.randrange(3, 259)]) for _ in range(r.randrange(9))]
        assert c.vocabulary.decode(ids) == c.vocabulary.library.decode(ids)


def test_codec_in_small_parts_and_with_few_kept_runs(monkeypatch):
    model = sentencepiece_codec.load_model(sentencepiece_codec.default_model())
    whole = sentencepiece_codec.Codec(model).batch(ODD + texts(9, 30))
    monkeypatch.setattr(sentencepiece_codec, "PART", 7)
    monkeypatch.setattr(sentencepiece_codec, "KEPT_RUNS", 20)
    assert sentencepiece_codec.Codec(model).batch(ODD + texts(9, 30)) == whole


def test_codec_notices_wrong_ids_and_wrong_text():
    model = sentencepiece_codec.load_model(sentencepiece_codec.default_model())
    for spoil in ("ids", "text"):
        c = sentencepiece_codec.Codec(model)
        if spoil == "ids":
            c.vocabulary.symbol[ord("q")] = c.vocabulary.ids["w"]
        else:
            raw = list(c.vocabulary.raw)
            raw[c.vocabulary.encode("quite")[-1]] = b"?"
            c.vocabulary.raw_array = pa.array(raw, pa.binary())
        with pytest.raises(AssertionError):
            c.batch(["a quite plain text"])


def test_encode_digest_equals_library(spark):
    path = sentencepiece_codec.default_model()
    library = sentencepiece_codec.Vocabulary(sentencepiece_codec.load_model(path)).library
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD, *texts(9, 30), ODD[-3]])]
    made = sentencepiece_codec.encode_digest(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), path)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sort(made.select("doc_id", "_n_tokens", "ids_sha256", "decoded_sha256").collect()) == sort(want)


def test_encode_decode_empty_table(spark, empty):
    assert sentencepiece_codec.encode_decode(empty, sentencepiece_codec.default_model()).count() == 0


def test_encode_decode_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a b", None)], "doc_id long, text string, ids string")
    made = sentencepiece_codec.encode_decode(df, sentencepiece_codec.default_model())
    assert made.columns == ["doc_id", "text", "ids", "_ids", "decoded"]
    assert {r[0]: (len(r[3]), r[4]) for r in made.collect()} == {1: (0, ""), 2: (2, "a b")}


# top-k


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(300, 8)), 2)
    x[40:60] = x[20]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (920, [None] * 8), (940, [float("nan")] * 8), (960, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = np.floor(64 * x)
    got = {}
    for r in topk_search.top_k(df.filter("vec_id % 20 = 0"), df, block=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 300, 20))
    for i in got:
        s = (q @ q[i]).astype(int)
        order = [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if j != i][:20]
        assert sorted(got[i]) == [(k + 1, j, s[j]) for k, j in enumerate(order)]


def test_top_k_of_mixed_lengths_and_huge_vectors(spark):
    big = [[3.0, -2e8], [1e8, 1e7], [2e8, 5.0], [-1e16, 7e15], [1e300, -1e300], [1e300, 1e300]]
    rows = [(0, [1.0]), (1, [2.0]), (20, [0.5, 0.25]), (2, [1.0, 1.0]), (3, [1.0, 1.0])] + [(40 + 20 * i, v) for i, v in enumerate(big)]
    df = spark.createDataFrame([(*r, "taken") for r in rows], "vec_id long, embedding array<double>, score string").repartition(2)
    got = {}
    for r in topk_search.top_k(df.filter("vec_id % 20 = 0"), df).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
    hold = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    for i in [i for i, _ in rows if i % 20 == 0]:
        s = {j: hold(sum(a * b for a, b in zip(whole[i], whole[j]))) for j in whole if j != i and len(whole[j]) == len(whole[i])}
        assert sorted(got[i]) == [(k + 1, j, s[j]) for k, j in enumerate(sorted(s, key=lambda j: (-s[j], j)))]


def test_search_prunes_clusters():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 40
    x = np.floor(64 * (centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16))))
    state = topk_search.Search(np.arange(0, 6000, 20), x[::20], 20)
    state.feed(np.arange(6000), x)
    assert state.products < 0.5 * state.possible == 0.5 * 300 * 6000
    s = (x[::20] @ x.T).astype(np.int64)
    s[np.arange(300), np.arange(0, 6000, 20)] = topk_search.NONE
    assert (np.sort(state.scores, axis=1)[:, ::-1] == np.sort(s, axis=1)[:, ::-1][:, :20]).all()


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(500, 5))
    t = topk_search.CoverTree(x, leaf=8)
    for c, r, (s, e) in zip(t.center, t.radius, t.run):
        assert (np.linalg.norm(x[t.order[s:e]] - x[c], axis=1) <= r + 1e-9).all()
    assert sorted(t.order) == list(range(500))


def test_top_k_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(none, none).count() == 0


# chat


def test_reply_tree_paths_and_round_trip(spark):
    odd = ["</s>", "<\\/s>", "[INST] x [/INST]", "<\\\\s> é", "", None, "a<", "</s", "[[INST]"]
    rows = [(1, i, (i - 1) // 2 if i else None, ["user", "assistant", None][i % 3], odd[i], float(i)) for i in range(9)]
    rows += [(2, 5, 99, "system", "lone", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "no tree", 1.0)]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double")
    made = chat_format.conversations(df, None).select("tree", "leaf", "formatted", "loss_spans", chat_format.read_back(F.col("formatted")).alias("back")).collect()
    assert {(r[0], r[1]) for r in made} == {(1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 5)}
    for r in made:
        path, node = [], r["leaf"]
        by = {(x[0], x[1]): x for x in rows}
        while (r["tree"], node) in by:
            path.insert(0, by[r["tree"], node])
            node = path[0][2]
        assert [tuple(b) for b in r["back"]] == [(p[3] or "", p[4] or "") for p in path]
        learnt = [r["formatted"][s - 1 : s - 1 + n] for s, n in r["loss_spans"]]
        assert len(learnt) == sum(p[3] == "assistant" for p in path)
    best = chat_format.conversations(df, 1).select("tree", "leaf").collect()
    assert {tuple(r) for r in best} == {(1, 6), (2, 5)} or {tuple(r) for r in best} == {(1, 8), (2, 5)}


def test_long_conversation(spark):
    df = spark.createDataFrame([(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(70)] + [(1, 69, "assistant", "t69"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    made = chat_format.conversations(chat_format.linear_messages(df)).select(chat_format.read_back(F.col("formatted")).alias("b")).collect()
    assert len(made) == 1 and [x["text"] for x in made[0]["b"]] == [f"t{i}" for i in range(70)] + ["t69"]


# training order


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        for key in (1, 99):
            assert sorted(training_order.feistel(np.arange(n), n, key)) == list(range(n))
    assert training_order.feistel(np.arange(100), 100, 1).tolist() != training_order.feistel(np.arange(100), 100, 2).tolist()


def test_shards_hold_every_sequence_and_resume(spark, docs, rows, empty, tmp_path):
    path = str(tmp_path / "shards")
    n = training_order.materialise(training_order.byte_ids(docs), path, length=64, slots=16)
    got = training_order.read_slots(spark, path).collect()
    assert sorted(r["slot"] for r in got) == list(range(n))
    have = [(r["doc_id"], r["part"], len(r["ids"]) // 2, hashlib.sha256(r["ids"]).hexdigest()) for r in got]
    assert sort(have) == sort(training_order.brute_force([(r[0], r[1]) for r in rows], 64))
    part = training_order.read_slots(spark, path, 10, 40).collect()
    assert sort(part) == sort(r for r in got if 10 <= r["slot"] < 40)
    assert all(r["byte_offset"] == (r["slot"] - 16 * r["shard"]) * (16 + 128) for r in got)
    assert training_order.materialise(training_order.byte_ids(empty), str(tmp_path / "none")) == 0
    assert list(training_order.in_order(spark, str(tmp_path / "none"))) == []


def test_slots_follow_the_permutation_and_files_hold_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(training_order, "FILE", 1500)
    path = str(tmp_path / "ranges")
    df = spark.createDataFrame([(i, bytes([i % 251, 0] * (1 + i % 7)), "x") for i in range(300)], "doc_id long, ids binary, slot string").coalesce(1)
    n = training_order.materialise(df, path, length=2, slots=8)
    index = [(i, k) for i in range(300) for k in range(-(-(1 + i % 7) // 2))]
    want = dict(zip(training_order.feistel(np.arange(n), n).tolist(), index))
    order = list(training_order.in_order(spark, path, window=100))
    assert [r["slot"] for r in order] == list(range(n)) and [(r["doc_id"], r["part"]) for r in order] == [want[s] for s in range(n)]
    assert [r["slot"] for r in training_order.in_order(spark, path, start=n - 5)] == list(range(n - 5, n))
    held = spark.read.parquet(path).select("shard", F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.min("shard").alias("a"), F.max("shard").alias("b"), F.count("*").alias("n")).orderBy("a").collect()
    assert len(held) > 5 and all(r["b"] - r["a"] + 1 == r["n"] for r in held)


def test_token_ids_are_the_codecs(spark, docs, rows):
    path = sentencepiece_codec.default_model()
    library = sentencepiece_codec.Vocabulary(sentencepiece_codec.load_model(path)).library
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u2").tolist()) for r in training_order.token_ids(docs, path).collect()]
    assert sort(got) == sort((r[0], library.encode(r[1] or "")) for r in rows)


# classifiers and the language model


def test_language_families_and_held_out(spark):
    parts = {"en": "the of and ing tion", "de": "der und sch ung keit", "fr": "le eau oir que é", "es": "el ción los ña que", "xx": "qqq www zzz vvv"}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(p.split()) + r.choice(p.split()) for _ in range(r.randint(3, 40))), lang) for i, (lang, p) in enumerate(list(parts.items()) * 60)]
    rows += [(9000, None, "en"), (9001, "12 34 !", "en"), (9002, "", None), (None, "the", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, F.col("doc_id") % 4 != 2)
    got = language.identify(df.withColumn("score", F.lit(1)), model).collect()
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 9000 and x["doc_id"] % 4 == 2]
    assert sum(x["lang"] == x["lang_pred"] for x in held) >= 0.97 * len(held)
    assert {(x["doc_id"], x["lang_pred"], x["_score"]) for x in got if (x["doc_id"] or 0) >= 9000} == {(9000, "und", 0.0), (9001, "und", 0.0), (9002, "und", 0.0)}
    assert all(0 <= x["_score"] <= 1 for x in got)
    none = language.fit(df.filter("false"), F.lit(True))
    assert {x["lang_pred"] for x in language.identify(df.limit(3), none).collect()} == {"und"}


def test_classifier_chain_held_out(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, marks = [], []
    for i in range(400):
        w = [word() for _ in range(40)]
        if i % 4 == 1:
            w[5] = w[20] = "vileslur"
        if i % 4 == 3:
            w = [x + "!!" for x in w]
        rows.append((i, " ".join(w)))
        marks.append((i, 0 if i % 4 == 3 else 1, 1 if i % 4 == 1 else 0))
    rows += [(900, None), (901, ""), (None, "vileslur vileslur")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([m for m in marks if m[0] % 3] + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(df, labels)
    got = {x["doc_id"]: x for x in toxicity.score(df, chain).collect()}
    test = [m for m in marks if m[0] % 3 == 0]
    assert sum((got[m[0]]["p_toxic"] >= 0.5) == bool(m[2]) for m in test) >= 0.97 * len(test)
    assert got[900]["p_toxic"] == got[901]["p_toxic"] == 0
    assert toxicity.without_toxic(df, labels.filter("false")).count() == len(rows)


def test_kneser_ney_sums_to_one_in_any_shards(spark):
    df = spark.createDataFrame([("abracadabra",), ("banana",), ("",), (None,), ("x",)], "text string")
    model = kneser_ney.train(df)
    whole = next(kneser_ney.shards_of(model))
    shards = list(kneser_ney.shards_of(model, 20))
    assert len(shards) > 1
    for ctx in (b"\0\0\0\0", b"brac", b"zzzz", b"anan"):
        keys = np.array([int.from_bytes(ctx + bytes([w]), "big") for w in range(256)], np.uint64)
        p = whole.log_p(keys)
        assert abs(np.exp(p).sum() - 1) < 1e-9
        parts = sum(np.where(s.mine(keys), s.log_p(keys), 0) for s in shards)
        assert np.allclose(p, parts)


def test_quality_keeps_clean_and_drops_junk(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice(["the", "ing", "and", "er"]) for _ in range(2))
    rows = [(i, " ".join(word() for _ in range(50)), "en") for i in range(300)] + [(500, "#$%^&*" * 30, "en"), (501, None, "en"), (502, "", None), (503, "!!!! " * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in kneser_ney.quality(df, df.filter("doc_id < 200").select("doc_id")).collect()}
    assert sum(got[i]["keep"] for i in range(300)) >= 260
    assert not any(got[i]["keep"] for i in (500, 501, 502, 503)) and got[501]["perplexity"] is None
    assert kneser_ney.quality(df.filter("false"), df.select("doc_id")).count() == 0


def test_bounded_sample(spark):
    df = spark.range(3000).withColumn("k", F.when(F.col("id") < 10, None).otherwise(F.lit("a")))
    n = {r["group"]: r["count"] for r in linear.bounded(df, "id", F.col("k"), 500).groupBy("group").count().collect()}
    assert n[None] == 10 and 400 < n["a"] < 600
