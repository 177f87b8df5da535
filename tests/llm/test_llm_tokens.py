"""Tokens, packing, the store, fingerprints, repeats and the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import golay, packing, registry, simhash, store
from tessera.llm.common import work_path
from tessera.llm.graph import components
from tessera.llm.substring import SuffixAutomaton, substring_dedup
from tessera.llm.suffixdedup import common, front_code, front_decode, merge_runs, suffix_dedup
from tessera.llm.tokens import PieceEncoder, default_path
from tests.llm import brute

ODD = ["", " ", "\n", "a\n\nb  c", " lead", "trail ", "x\t y", "don't  we'll 12 3.4", "é b c d", "a \n b", "<|endoftext|> hi", "a\r\nb", "日本 語 x", "a\x1cb c\x85 d", "Foo, bar. baz.\nFoo,", "😀, 😀."]


@pytest.fixture(scope="module")
def tokenizer():
    return default_path()


@pytest.fixture(scope="module")
def corpus(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    return rows + [(1_000_000 + i, t) for i, t in enumerate([*ODD, None, "w" * 20_000, rows[0][1]])]


@pytest.fixture(scope="module")
def table(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("h", "part", "start", "payload")}).repartition(4)


@pytest.fixture(scope="module")
def ids(corpus, tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    return {k: e.ids for (k, _), e in zip(corpus, t.encode_batch([x or "" for _, x in corpus], add_special_tokens=False))}


def test_pieces_equal_whole_texts(corpus, ids, tokenizer):
    for limit in (2_000_000, 3_000):  # the small one starts anew again and again
        enc = PieceEncoder(tokenizer, limit)
        assert [x.tolist() for x in enc.encode_many([t or "" for _, t in corpus])] == [ids[k] for k, _ in corpus]


def test_assign_is_gapless_and_full():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.choice([1, 5, 1023, 1024, 1025, 5000, rng.randint(1, 3000)]) for _ in range(rng.randint(0, 60))]
        out = packing.assign(lengths, 1024)
        for i, n in enumerate(lengths):
            at = 0
            for _, s, k, _, _ in sorted(p for p in out if p[0] == i):
                assert s == at and k > 0
                at += k
            assert at == n
        seqs = {}
        for _, _, k, q, at in sorted(out, key=lambda p: (p[3], p[4])):
            assert seqs.get(q, 0) == at
            seqs[q] = at + k
        assert all(v <= 1024 for v in seqs.values()) and len(seqs) == -(-sum(lengths) // 1024)


def test_packing(spark, table, corpus, ids, tokenizer):
    got = {}
    for r in packing.pack(table, tokenizer=tokenizer, window_tokens=20_000).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert got.keys() == {k for k, _ in corpus}
    for k, pieces in got.items():
        x, at = [*ids[k], 0], 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(x) and r["ids_crc32"] == brute.crc(x[at: at + r["length"]])
            at += r["length"]
        assert at == len(x)
    assert packing.pack(table.limit(0), tokenizer=tokenizer).count() == 0
    assert packing.pack(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string"), tokenizer=tokenizer).count() == 2


def test_costs_are_balanced():
    rng = random.Random(2)
    lengths = [rng.randint(1, 1023) for _ in range(4000)]
    cost = {}
    for _, _, n, q, _ in packing.assign(lengths, 1024, 1.0, 1 / 256):
        cost[q] = cost.get(q, 0) + n + n * n / 256
    greedy, q, room = {}, 0, 1024
    for n in sorted(lengths, reverse=True):
        while n:
            k = min(n, room)
            greedy[q] = greedy.get(q, 0) + k + k * k / 256
            n, room = n - k, room - k
            if not room:
                q, room = q + 1, 1024
    assert np.std(list(cost.values())) < np.std(list(greedy.values()))


def test_store_round_trip(spark, table, corpus, ids, tokenizer):
    path = store.build_store(table, work_path(spark, "test-store"), tokenizer=tokenizer, end_id=2, average=64, least=16, most=256, part_bytes=200_000)
    store.verify_manifest(spark, path)
    rows = store.offsets(store.read_store(spark, path), spark, path).collect()
    assert len(rows) == len(corpus)
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        x = [*ids[r["doc_id"]], 2]
        assert r["start"] == at and r["n_tokens"] == len(x) and r["ids_crc32"] == brute.crc(x)
        assert np.frombuffer(r["ids"], "<u4").tolist() == x
        at += len(x)
    data = spark.read.parquet(f"{path}/data")
    edges = data.groupBy("part").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("part").collect()
    assert len(edges) > 1 and all(x["b"] < y["a"] for x, y in zip(edges, edges[1:]))
    used, kept = [], []
    for r in data.collect():
        each = [bytes(h) for h in r["digests"]]
        used += each
        kept += [h for i, h in enumerate(each) if i not in set(r["refs"])]
    assert len(kept) == len(set(kept)) == len(set(used)) < len(used)  # each chunk is stored once


def test_parts_dealt_to_several_tasks_are_the_same(spark, table, tokenizer):
    got = []
    for most in (1 << 16, 2):
        path = store.build_store(table, work_path(spark, "test-parts"), tokenizer=tokenizer, end_id=2, part_bytes=50_000, most_parts=most)
        store.verify_manifest(spark, path)
        rows = store.offsets(store.read_store(spark, path), spark, path)
        got.append(sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows.collect()))
        assert (spark.read.parquet(f"{path}/manifest").count() <= 2) == (most == 2)
    assert got[0] == got[1]


def test_manifest_counts_are_sealed(spark, table, tokenizer):
    path = store.build_store(table, work_path(spark, "test-tamper"), tokenizer=tokenizer, end_id=2, part_bytes=200_000)
    store.verify_manifest(spark, path)
    rows = store.read_store(spark, path)
    want = sorted((r["doc_id"], r["start"]) for r in store.offsets(rows, spark, path).collect())
    assert sorted((r["doc_id"], r["start"]) for r in store.offsets(rows, spark, path, together=2).collect()) == want
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    for column, change in (("n_tokens", 7), ("n_docs", 1)):
        told = [r.asDict() | {column: r[column] + change} for r in manifest]
        spark.createDataFrame(told, store.MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
        with pytest.raises(ValueError, match="manifest"):
            store.verify_manifest(spark, path)
    r = manifest[0]
    assert store.sealed(r["n_docs"] + 1, r["n_tokens"], b"x") != store.sealed(r["n_docs"], r["n_tokens"], b"x")


def test_encoder_is_bounded_by_bytes(corpus, ids, tokenizer, monkeypatch):
    from tessera.llm import tokens

    texts = [t or "" for _, t in corpus]
    for most, size in ((1 << 20, 1 << 20), (96 << 20, 100), (2 << 20, 4000)):
        monkeypatch.setattr(tokens, "SLICE", size)
        enc = PieceEncoder(tokenizer, most_bytes=most)
        got, top = [], 0
        for a in range(0, len(texts), 16):
            got += enc.encode_many(texts[a: a + 16])
            top = max(top, enc.table_bytes())
        assert [x.tolist() for x in got] == [list(ids[k]) for k, _ in corpus] and top <= most
    long = " ".join(texts)
    assert PieceEncoder(tokenizer).encode_many([long, "", long])[2].tolist() == enc.tok.encode(long, add_special_tokens=False).ids


def test_store_edges(spark, tokenizer):
    kind = "doc_id long, text string"
    path = store.build_store(spark.createDataFrame([], kind), work_path(spark, "test-empty"), tokenizer=tokenizer, end_id=2)
    assert store.read_store(spark, path).count() == 0
    with pytest.raises(ValueError):
        store.build_store(spark.createDataFrame([(None, "a")], kind), work_path(spark, "test-null"), tokenizer=tokenizer, end_id=2)
    with pytest.raises(Exception, match="share a doc_id"):
        store.build_store(spark.createDataFrame([(1, "a"), (1, "b")], kind), work_path(spark, "test-twice"), tokenizer=tokenizer, end_id=2)


def test_store_keeps_null_and_repeated_ids(spark, tokenizer, tmp_path):
    docs = [(1, "one two"), (1, "one two"), (1, "three four five"), (None, "six seven"), (None, None), (2, ""), (-3, "eight"), (None, "long " * 3000), (7, "long " * 3000)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = store.op9_content_store(spark, str(tmp_path)).collect()
    enc = PieceEncoder(tokenizer)
    want = sorted(((k is None, k or 0), len(x) + 1, brute.crc([*x, 2])) for (k, _), x in zip(docs, (enc.encode_many([t or "" for _, t in docs]))))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [-3, 1, 1, 1, 2, 7, None, None, None]


def test_chunks_survive_a_shift():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50_000, 20_000)

    def chunks(v):
        ends = store.cut_points(v, 256, 32, 2048)
        return {v[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    assert len(chunks(x) & chunks(np.r_[x[:100], 7, x[100:]])) > 0.9 * len(chunks(x))
    assert store.cut_points(np.zeros(5000, np.int64), 256, 32, 1000).tolist()[-1] == 5000


def test_stars_connect_the_same():
    from tessera.llm.graph import stars

    rng = random.Random(2)
    for n in (0, 1, 5, 60):
        edges = [(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(n)]
        parent = {x: x for e in edges for x in e}
        for a, b in edges:
            x, y = sorted((parent[a], parent[b]))
            parent = {k: x if v == y else v for k, v in parent.items()}
        assert sorted(stars(edges)) == sorted((k, v) for k, v in parent.items() if k != v)


def test_golay_keys_meet_within_two_bits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 1 << 23, 500)
    for _ in range(40):
        flips = np.bitwise_or.reduce([np.int64(1) << rng.integers(0, 23, 500) for _ in range(2)])
        (ka, ua), (kb, ub) = golay.keys(x), golay.keys(x ^ flips)
        assert ((ka[:, :, None] == kb[:, None, :]) & ua[:, :, None] & ub[:, None, :]).any((1, 2)).all()
    assert set(golay.tables()[3].tolist()) == {1, 6}


def test_fingerprints_and_components(spark, table, corpus):
    fps = {}
    for k, t in corpus:
        w = brute.words((t or "").translate({65 + i: 97 + i for i in range(26)}))
        grams = [" ".join(w[i: i + 4]) for i in range(len(w) - 3)] or [" ".join(w)] * bool(w)
        hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fps[k] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    got = simhash.simhash_components(table).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == fps and len(got) == len(corpus)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute.components(fps, 4)


@pytest.mark.parametrize("entries", [8 << 20, 300])
def test_dense_groups_lose_no_component(spark, entries):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {i: base[i % 4] ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for i in range(600)}
    fps = {i: v for i, v in {v: i for i, v in fps.items()}.items() for i, v in [(v, i)]}
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in fps.values()], "fp long")
    roots = dict(map(tuple, components(simhash.near_links(table, len(fps), range_entries=entries)).collect()))
    want = brute.components(fps, 4)
    signed = {i: v - (1 << 64) if v >> 63 else v for i, v in fps.items()}
    got = {}
    for i, v in signed.items():
        got.setdefault(roots.get(v, v), set()).add(i)
    classes = {}
    for i, c in want.items():
        classes.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_near_dedup_catches_copies(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    docs = []
    for i in range(40):
        w = [word() for _ in range(300)]
        docs.append((i, " ".join(w)))
        v = list(w)
        v[rng.randrange(300)] = "changed"
        docs.append((100 + i, " ".join(v)))
    docs += [(None, "alone with null"), (None, None), (500, ""), (501, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("own"))
    kept = simhash.near_dedup(df)
    ids = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
        # the row without id and text is like 500 and goes, the one with a text of its own stays
    assert kept.columns == df.columns and ids == [*range(40), 500] and [r["text"] for r in kept.where("doc_id IS NULL").collect()] == ["alone with null"]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Null and repeated ids, repeated rows, and columns named like the operator's own."""
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(3, text), (3, text), (3, text + " end"), (None, text), (None, other), (None, other), (None, other + " end"), (9, "alone"), (9, "alone"), (None, None), (None, ""), (4, "short one")]
    df = spark.createDataFrame([(k, t, i, "x", "y") for i, (k, t) in enumerate(rows)], "doc_id long, text string, t long, root string, gone string")
    kept = simhash.near_dedup(df)
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert kept.columns == df.columns and len(got) == 5
    assert [g for g in got if g[0] is not None] == [(3, got[0][1]), (4, "short one"), (9, "alone")] and got[0][1] in (text, text + " end")
    assert sorted((g[1] or "")[:2] for g in got if g[0] is None) == ["", "v0"]
    parts = {r["component_id"] for r in simhash.similar_components(df).collect()}
    assert parts == {3, 9, 4, None} and simhash.similar_components(df).count() == len(rows)


def test_near_dedup_recall_and_precision(spark, sf):
    """Against a comparison of all pairs of real documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r["doc_id"]: {tuple(x) for x in zip(*(brute.words((r["text"] or "").lower())[k:] for k in range(5)))} for r in docs.collect()}
    keys = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    of = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert pairs and all(of[a] == of[b] for a, b in pairs)
    parent = {k: k for k in keys}
    for a, b in pairs:
        x, y = sorted((parent[a], parent[b]))
        parent = {k: x if v == y else v for k, v in parent.items()}
    long = [k for k in keys if len(sets[k]) > 1]
    assert {k: of[k] for k in long} == {k: parent[k] for k in long}


@pytest.mark.parametrize("bits", [1 << 26, 1 << 19])
def test_sifted_lets_all_keys_pass(spark, bits):
    rng = random.Random(1)
    rows = [(i, rng.getrandbits(64) - (1 << 63), str(i)) for i in range(500)]
    texts = spark.createDataFrame(rows, "doc_id long, t long, text string")
    keys = texts.where("doc_id % 10 = 0").select("t")
    got = {r["doc_id"] for r in simhash.sifted(texts, keys, bits).collect()}
    assert got >= {i for i in range(0, 500, 10)} and len(got) < 60
    assert simhash.sifted(texts, keys.limit(0), bits).count() == 0


@pytest.mark.parametrize("batch,nbytes", [(1 << 20, 6 << 20), (300, 2000)])
def test_repeated_texts_are_those_with_partners(spark, sf, batch, nbytes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    sets = {r["doc_id"]: simhash.shingle_set(r["text"], 5).tolist() for r in docs.collect()}
    count = Counter(h for x in sets.values() for h in x)
    want = {k for k, x in sets.items() if 5 * sum(count[h] > 1 for h in x) >= 4 * len(x)}
    got = [r["doc_id"] for r in simhash.repeated_texts(docs, 5, 4, 5, batch_shingles=batch, range_bytes=nbytes).collect()]
    assert len(got) == len(set(got)) and set(got) == want and 0 < len(want) < len(sets)


def test_near_dedup_goes_by_exact_similarity(spark):
    """Pairs at and over 0.8 are all found, those under it never."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    phrase = [word() for _ in range(40)]
    docs, over, under = [], 0, 0
    for i in range(150):
        w = [word() for _ in range(300)]
        # a tail of k other words leaves 296 - k of 296 + k shingles
        k = [32, 33, 40, 55, 74][i % 5]
        other = w[: 300 - k] + [word() for _ in range(k)]
        shingles = [{tuple(x[s: s + 5]) for s in range(len(x) - 4)} for x in (w, other)]
        near = len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) >= 0.8
        over, under = over + near, under + (not near)
        docs += [(i, " ".join(w), True), (1000 + i, " ".join(other), not near)]
    docs += [(2000, " ".join(phrase), True), (2001, " ".join(phrase * 30), False), (2002, " ".join(phrase + phrase[:4]), False)]  # like sets, unlike counts
    kept = {r["doc_id"] for r in simhash.near_dedup(spark.createDataFrame(docs, "doc_id long, text string, kept boolean")).collect()}
    assert over and under and kept == {i for i, _, stays in docs if stays}


def test_prefix_candidates_need_no_fingerprint():
    rng = np.random.default_rng(12)
    for small in (2, 24):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 25))) for _ in range(60)]
        sets += [x[rng.random(len(x)) < 0.9] if len(x) > 1 else x for x in sets]
        sets = [x if len(x) else sets[0] for x in sets]
        key = np.concatenate([x[: simhash._prefix_length(len(x), 4, 5)] for x in sets])
        who = np.repeat(np.arange(120), [simhash._prefix_length(len(x), 4, 5) for x in sets])
        got = set(map(tuple, simhash.pairs_of(key, who, who, np.array([len(x) for x in sets])[who], 4, 5, small).tolist()))
        want = {(a, b) for a in range(120) for b in range(a + 1, 120) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
        assert want <= got and want
    for n, m in ((0, 5), (40, 50), (300, 320), (2000, 90)):
        x, y = (np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (n, m))
        y[: m // 2] = x[: m // 2] if n >= m // 2 else y[: m // 2]
        assert simhash.least_apart(simhash.parities(x), simhash.parities(y)) <= len(np.setxor1d(x, y))


def test_parities_of_many_pairs():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, k).astype(np.uint64)) for k in (0, 1, 20, 40, 70, 300, 300, 1000)]
    bits = [simhash.parities(x) for x in sets]
    a, b = (x.reshape(-1) for x in np.meshgrid(np.arange(8), np.arange(8)))
    want = [simhash.least_apart(bits[i], bits[j]) for i, j in zip(a, b)]
    for together in (1, 1 << 14):
        assert simhash.Parities(bits).least_apart(a, b, together).tolist() == want


def test_loosely_like_texts_leave_no_pairs(spark):
    """Copies of one text that are like it only at 0.7 or so: nearly all pairs are ruled out within the tasks."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(400):
        w = list(base)
        for k in rng.sample(range(0, 300, 6), 12):
            w[k] = f"x{rng.getrandbits(40)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "t long, text string")
    sets = simhash.shingle_sets(df, 5).cache()
    rows = simhash.prefixes(sets, 4, 5, simhash.frequent_shingles(sets)).withColumn("root", F.col("node"))
    found = {tuple(r) for r in simhash.prefix_pairs(rows, 30_000, 4, 5).collect()}
    own = {r["node"]: set(np.frombuffer(r["own"], np.uint64).tolist()) for r in sets.collect()}
    keys = sorted(own)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1:] if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    assert want <= found and len(found) < 400 * 399 // 20


def test_loser_tree():
    rng = random.Random(7)
    for _ in range(60):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 6))]
        shared = [front_code(r)[0].tolist() for r in runs]
        run, index, lcp = merge_runs(runs, shared)
        out = [runs[r][i] for r, i in zip(run, index)]
        assert out == sorted(x for r in runs for x in r)
        assert all(n == common(a, b, 0) for a, b, n in zip(out, out[1:], lcp[1:].tolist()))
        for r in runs:
            s, rest = front_code(r)
            assert front_decode(s, np.array([len(x) for x in r], int), rest) == r


def test_automaton_counts():
    rng = random.Random(8)
    for _ in range(40):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(0, 15))] for _ in range(5)]
        a = SuffixAutomaton()
        for t in texts:
            a.add(t)
        a.close()
        for n in (1, 3):
            grams = [tuple(t[i: i + n]) for t in texts for i in range(len(t) - n + 1)]
            for t in texts:
                assert list(a.occurrences(t, n)) == [grams.count(tuple(t[i: i + n])) for i in range(len(t) - n + 1)]


def made_up(seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcde ") for _ in range(rng.randint(20, 200))) for _ in range(8)]

    def text():
        if rng.random() < 0.1:
            return rng.choice([None, "", "x", "a" * 300, "ab " * 90, "w " * 80])
        letters = rng.choice(["ab ", "abcdefgh ", "é ñ "])
        return "".join(rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 6)))

    rows = list({k: (k, text()) for k in (rng.randint(-50, 10**6) for _ in range(120))}.values())
    return rows + [(2 * 10**6 + i, rows[i][1]) for i in range(10)]


@pytest.mark.parametrize("length,gram", [(50, 24), (20, 8)])
def test_suffix_dedup(spark, length, gram):
    docs = made_up(length)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("own"))
    got = suffix_dedup(df, length=length, gram=gram, digests=True, block_bytes=2000).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.suffix(docs, length) and len(got) == len(docs)


@pytest.mark.parametrize("length,gram", [(35, 12), (6, 3)])
def test_substring_dedup(spark, length, gram):
    docs = made_up(100 + length)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("r", F.lit("own"))
    got = substring_dedup(df, length=length, gram=gram, shard_words=50, digests=True, block_bytes=2000, range_bytes=5000).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.passages(docs, length) and len(got) == len(docs)


@pytest.mark.parametrize("hot", [1, 3, 40])
def test_hot_anchors_are_split_without_loss(spark, hot):
    """Anchors of more places than may meet in one task go window by window, with the same results."""
    docs = made_up(7 + hot)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = suffix_dedup(df, length=20, gram=8, digests=True, block_bytes=2000, hot_places=hot).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.suffix(docs, 20)
    got = substring_dedup(df, length=6, gram=3, shard_words=50, digests=True, block_bytes=2000, hot_places=hot).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute.passages(docs, 6)


def test_one_anchor_in_thousands_of_contexts(spark):
    """A passage of an anchor's length, with surroundings of its own in every text, and in some those of another."""
    rng = random.Random(21)
    common_words = [f"c{i}" for i in range(14)]
    docs = []
    for i in range(3000):
        left, right = ([f"{s}{rng.randrange(10**6)}" for _ in range(25)] for s in "lr")
        docs.append((i, " ".join(left + common_words + right)))
        if i % 100 == 0:
            docs.append((10_000 + i, " ".join(["x"] + left[1:] + common_words + right[:-1] + ["y"])))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = brute.passages(docs, 35)
    for places in (64, 1 << 20):
        got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup(df, digests=True, block_bytes=50_000, hot_places=places).collect()}
        assert got == want and sum(r[1] > 0 for r in got.values()) == 60


def test_repeats_edges(spark):
    kind, text = "doc_id long, text string", "one two three four five six seven eight nine ten " * 12
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text), (3, None)], kind)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup(rows, digests=True).collect())
    n = len(text)
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, n), (False, 3, 0), (True, 0, n), (True, 0, n)]
    assert {r["n_removed"] for r in substring_dedup(rows.where("text IS NOT NULL"), digests=True).collect()} == {120}
    for f in (suffix_dedup, substring_dedup):
        assert f(rows.limit(0)).count() == 0
        assert f(rows).columns == ["doc_id", "text"]


def test_contract_columns(spark, sf):
    want = {
        "op1": "doc_id held_out lang_pred score", "op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op3": "page_id host path rule verdict",
        "op4": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op5": "doc_id fingerprint component_id", "op6": "doc_id item_id first_word n_words",
        "op7": "doc_id n_lines n_removed kept_sha256", "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9": "doc_id start n_tokens ids_crc32", "op10": "doc_id n_words n_removed kept_sha256",
    }
    assert {n.split("_")[0] for n in registry.QUERIES} == set(want)
    for name, query in registry.QUERIES.items():
        assert query(spark, sf).columns == want[name.split("_")[0]].split()


def test_pipeline(spark, sf, ids):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, last = docs.columns, docs.count()
    assert [n for n, _ in c.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns
        path = work_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        assert 0 < docs.count() <= last
        last = docs.count()
    pieces = c.run(spark, sf)
    assert pieces.select("doc_id").distinct().count() == last


def test_pipeline_on_odd_tables(spark, sf, tmp_path):
    """Nulls, empties, repeated rows and columns named like the operators' own; an empty table."""
    import shutil

    import corpus_pipeline as c

    body = " ".join(f"the word{i} and {i}th" for i in range(60))
    other = "\n".join(f"line {i} the {i}th a{i} and b{i} c{i}" for i in range(20))
    rows = [(1, body), (1, body), (2, body), (None, other), (None, other), (None, None), (5, None), (6, ""), (7, " \n\t"), (8, "x" * 50_000), (9, "# | " * 90), (10, other + "\nend")]
    made = [(k, t, None if i % 2 else "en", None if i % 3 else "s", i, "a", "b", "c", "d") for i, (k, t) in enumerate(rows)]
    kind = "doc_id long, text string, lang string, source string, n_chars long, later string, t string, root string, gone string"
    for name, n in (("odd", len(made)), ("empty", 0)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(made[:n], kind).write.parquet(f"{folder}/documents.parquet")
        shutil.copy(f"{sf}/benchmark.parquet", f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        columns = docs.columns
        for step, stage in c.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == columns
            path = work_path(spark, step)
            out.write.parquet(path)
            docs = spark.read.parquet(path)
        kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
        assert kept.count((1, body)) == 1 and (2, body) not in kept and (9, rows[10][1]) not in kept if n else not kept
        assert len(kept) == len(set(kept))
        pieces = c.run(spark, folder).collect()
        assert {r["doc_id"] for r in pieces} == {k for k, _ in kept}


def _loosely_like(n, seed=3, words=120, own=24):
    """Texts that share most of their words in order, each with words of its own spread over it: similarities under 0.8."""
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for j in rng.choice(words, size=own, replace=False).tolist():
            t[j] = f"x{i}_{j}"
        out.append(" ".join(t))
    return out


def test_pairs_of_a_hot_key_in_tiles():
    """One key of 5,000 nodes: pairs are made tile by tile and forests don't pair again what they have joined, in bounded time."""
    import time

    n = 5000
    key, node, size = np.zeros(n, np.uint64), np.arange(n), np.full(n, 100)
    seen = []

    def near(pairs):
        seen.append(len(pairs))
        return (pairs[:, 1] - pairs[:, 0]) % 997 == 0

    began = time.perf_counter()
    got = simhash.pairs_of(key, node, node, size, 4, 5, near=near)
    assert time.perf_counter() - began < 30 and max(seen) <= 512 * 512 and sum(seen) == n * (n - 1) // 2
    assert {tuple(x) for x in got.tolist()} == {(a, b) for a in range(n) for b in range(a + 997, n, 997)}
    seen.clear()
    slack = lambda pairs, x, y: simhash._forest(np.zeros(len(pairs)), x, y)
    joined = simhash.pairs_of(key, node, node, size, 4, 5, near=lambda pairs: near(pairs) | True, forest=slack)
    assert len(joined) == n - 1 and sum(seen) < 8_000_000  # a spanning tree, and far fewer pairs looked at than there are
    side = node % 2
    cross = simhash.pairs_of(key[:60], node[:60], node[:60], size[:60], 4, 5, side=side[:60])
    assert {tuple(x) for x in cross.tolist()} == {(a, b) for a in range(60) for b in range(a + 1, 60, 2)}


def test_hot_shingles_are_dealt_out(spark):
    """A range over the limit is split into blocks whose pairs meet in tasks of their own: the same candidates as from one task."""
    texts = _loosely_like(60) + [f"{t} tail" for t in _loosely_like(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    sets = simhash.shingle_sets(df, 5)
    heads = simhash.prefixes(sets, 4, 5, simhash.frequent_shingles(sets)).cache()
    rows = heads.select("node", F.col("node").alias("root"), "n", "prefix", "bits")
    n = heads.agg(F.sum(F.octet_length("prefix"))).first()[0] // 8
    blocks = simhash.oversize(heads, n, most=n // 40)
    assert blocks and max(blocks.values()) > 1
    pairs = lambda **how: {tuple(r) for r in simhash.prefix_pairs(rows, n, 4, 5, **how).collect()}
    assert pairs(blocks=blocks) == pairs()
    forest = pairs(blocks=blocks, forest=True)
    assert forest <= pairs() and len(forest) >= 60


def test_many_loosely_like_texts(spark):
    """Two thousand texts that are like, but not enough, each with one near copy: only the copies are joined."""
    import time

    texts = _loosely_like(2000)
    docs = [(i, t) for i, t in enumerate(texts)] + [(2000 + i, f"{t} end") for i, t in enumerate(texts)]
    began = time.perf_counter()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i % 2000 for i in range(4000)} and time.perf_counter() - began < 240


@pytest.mark.parametrize("ids", [None, 7])
def test_rows_of_one_id_are_spread_over_blocks(spark, ids):
    """A table of null ids, or of one id, is no single block, and its results are those of the definition: no smaller doc_id, but windows elsewhere."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=40))
    texts = [" ".join(rng.choices(words, k=60)) + (" " + passage if i % 3 == 0 else "") for i in range(30)]
    docs = spark.createDataFrame([(ids, t) for t in texts], "doc_id long, text string")
    seen = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(8)).alias("block")).distinct().count()
    assert seen > 4
    suffixes = suffix_dedup(docs, block_bytes=2000, digests=True)
    assert {(r["n_removed"], r["n_spans"]) for r in suffixes.collect()} == {(0, 0)}  # no doc_id is smaller
    got = sorted(r["n_removed"] for r in substring_dedup(docs, block_bytes=2000, digests=True).collect())
    assert got == sorted([40] * 10 + [0] * 20)
