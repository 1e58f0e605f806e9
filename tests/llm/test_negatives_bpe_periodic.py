"""Hard negatives, byte-level BPE, periodic runs."""

import base64
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from veilmark.llm import bpe, negatives, periodic
from veilmark.llm import queries as Q

SF = "/root/testdata/sf0.01"


# --- hard negatives

def brute_mine(rows, every=100, k=5, percent=80):
    """(anchor, positive, rank, negative, positive score, negative score); a row is (id, label, vector)."""
    part = [(i, lab, [math.floor(256 * c) for c in v]) for i, lab, v in rows if None not in (i, lab, v) and all(c is not None and math.isfinite(c) for c in v)]
    anchors = {}
    for r in sorted(part):
        if r[0] % every == 0:
            anchors.setdefault(r[0], r)
    out = []
    for a, label, v in anchors.values():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, lab) for i, lab, w in part if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            good = [x for x in scored if x[2] != label and percent * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(good)]
    return sorted(out)


VECTORS = "vec_id long, label int, embedding array<double>, id string, w int, anchor int"


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(3)
    return sorted(map(tuple, negatives.mine(table, **options).collect()))


def test_mining_equals_brute_force_with_ties_copies_and_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    copy = [0.5, 0.25, -0.125, 1.0]
    rows = [(i, rng.randrange(3), copy if i % 3 == 0 else [rng.uniform(-1, 1) for _ in range(4)]) for i in range(420)]
    rows += [(None, 1, copy), (701, None, copy), (702, 1, None), (703, 1, [None] * 4), (704, 1, [float("nan")] * 4), (705, 1, [float("inf"), 0.0, 0.0, 0.0]), (800, 1, [1.0, 2.0]), (801, 1, [2.0, 1.0]), (802, 2, [2.0, 1.0]), (900, 1, []), (901, 1, []), (902, 0, [])]
    rows += [rows[100], (100, 0, [0.1, 0.2, 0.3, 0.4]), rows[200], rows[5], rows[5]]
    wanted = brute_mine(rows)
    assert len(wanted) > 100
    assert mined(spark, rows) == wanted
    monkeypatch.setattr(negatives, "DIGIT", 5)
    monkeypatch.setattr(negatives, "SMALL", 0)
    monkeypatch.setattr(negatives, "PAIRS", 64)
    assert mined(spark, rows, block=4) == wanted


def test_mining_beyond_exact_floats(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(-60000, 60000) for _ in range(300)]) for i in range(120)]
    rows += [(200 + i, i % 2, rows[0][2]) for i in range(8)]
    assert mined(spark, rows, percent=1) == brute_mine(rows, percent=1)


def test_mining_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.5]), (2, 2, [0.5])]) == []
    assert mined(spark, [(100, 1, [0.5]), (2, 2, [0.5])]) == []


def same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = Q.QUERIES[name](spark, SF)
    cols = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(cols)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, ours.select(cols).collect())) == sorted(theirs)
    return theirs


def test_mining_query_equals_sql(spark):
    assert len(same_as_sql(spark, "op11_hard_negatives")) >= 20


# --- byte-level BPE

@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def peer(vocabulary):
    import tiktoken

    return tiktoken.Encoding("peer", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_refuses_strangers(vocabulary):
    tokens = list(vocabulary.ranks)
    lengths = np.array([len(t) for t in tokens])
    buffer = np.frombuffer(b"".join(tokens), np.uint8)
    keys = bpe.key_hashes(buffer, np.cumsum(lengths) - lengths, lengths)
    assert sorted(vocabulary.hash(keys).tolist()) == list(range(len(tokens)))
    assert vocabulary.whole(buffer, np.cumsum(lengths) - lengths, lengths).tolist() == list(vocabulary.ranks.values())
    rng = random.Random(5)
    strangers = [s for s in {bytes(rng.randrange(256) for _ in range(rng.randint(3, 20))) for _ in range(3000)} if s not in vocabulary.ranks]
    lengths = np.array([len(t) for t in strangers])
    assert set(vocabulary.whole(np.frombuffer(b"".join(strangers), np.uint8), np.cumsum(lengths) - lengths, lengths).tolist()) == {-1}
    for n in (0, 1, 2, 5, 1000):
        own = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        assert sorted(bpe.PerfectHash(own)(own).tolist()) == list(range(n)) if n else bpe.PerfectHash(own).n == 0
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.zeros(2, np.uint64))
    with pytest.raises(ValueError):
        bpe.Vocabulary({b"a": 0}, ".")


def test_ids_equal_a_peer_and_decode_to_the_text(vocabulary, peer):
    rng = random.Random(6)
    texts = ["", "a", " \n\n  x 漢字😀 don't 12345 éé<|endoftext|>", "a" * 5000, " " * 3000 + "x", "ab" * 3000, "\x00\x01  "]
    texts += ["".join(rng.choice("abcdeéß漢😀 \n\t'stre12.-Ωж") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    for t, ids in zip(texts, vocabulary.encode(texts), strict=True):
        assert ids == peer.encode_ordinary(t)
        assert vocabulary.decode(ids) == t.encode()
    # A memory that is full starts again.
    memory = {str(i): [0] for i in range(bpe.REMEMBERED)}
    assert list(vocabulary.encode(["qzxqzxvkw"], memory)) == [peer.encode_ordinary("qzxqzxvkw")]
    assert len(memory) < 10
    with pytest.raises(ValueError):
        list(bpe.Vocabulary(vocabulary.ranks, "[a-z]+").encode(["a b"]))


def test_merged_pieces_are_remembered_beyond_a_full_memory_and_a_task(vocabulary, peer, monkeypatch):
    merged, asked = vocabulary.merged, []
    monkeypatch.setattr(vocabulary, "merged", lambda piece: asked.append(piece) or merged(piece))
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    memory, older = {}, {}
    for word in ("qzxqzxvkw", "vkwvqzx", "zzqxjvk", "qzxqzxvkw"):
        ids, ends = vocabulary.encode_slice([word], memory, older)
        assert ids.tolist() == peer.encode_ordinary(word) and ends.tolist() == [len(ids)]
    assert asked == [b"qzxqzxvkw", b"vkwvqzx", b"zzqxjvk"] and max(len(memory), len(older)) <= 2
    # Unpickled with the vocabulary, so that each worker has its own.
    assert vocabulary.memory == ({}, {})


def test_bpe_query_on_whole_documents(spark, docs, peer):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = Q.op12_byte_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = peer.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_bpe_of_odd_rows(spark, odd, none, vocabulary, peer):
    both = bpe.decode(bpe.encode(odd, vocabulary), vocabulary)
    assert both.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, r.ids, bytes(r.decoded)) for r in both.collect()))
    assert got == sorted((r.doc_id or 0, peer.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect())
    assert bpe.decode(bpe.encode(none, vocabulary), vocabulary).count() == 0
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert bytes(bpe.decode(empty, vocabulary).first().decoded) == b""


def test_vocabulary_file_has_all_ranks(vocabulary):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        assert vocabulary.ranks == {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


# --- periodic runs

def brute_runs(w):
    """All runs by comparing every word with that of each period."""
    n, out = len(w), set()
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            e = i + p
            if e - s >= max(24, 3 * p) and not any(all(w[k] == w[k + q] for k in range(s, e - q)) for q in range(1, p)):
                out.add((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force(monkeypatch):
    rng = random.Random(7)
    some = 0
    for trial in range(250):
        monkeypatch.setattr(periodic, "GRID", 1 << 20 if trial % 2 else 50)
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 23, 24, 30, 80, 150])
            w = [rng.randint(0, rng.choice([1, 2, 5])) for _ in range(n)]
            if n and rng.random() < 0.7:
                a = rng.randrange(n)
                p = 1 + (n - a) // rng.randint(3, 10)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        got = periodic.runs_of([np.array(t, np.int64) for t in texts])
        for t, g in zip(texts, got, strict=True):
            assert g == brute_runs(t)
            some += len(g)
    assert some > 100


def test_suffix_array_and_extensions():
    rng = random.Random(8)
    for n in (1, 2, 3, 50, 400):
        words = np.array([rng.randrange(2) for _ in range(n - 1)] + [9])
        order, rank, lcp = periodic.suffix_order(words)
        tails = [words[i:].tolist() for i in range(n)]
        assert order.tolist() == sorted(range(n), key=tails.__getitem__)
        assert rank[order].tolist() == list(range(n))
        if n > 1:
            ext = periodic.Extensions(words)
            i, j = (np.array(x) for x in zip(*[(a, b) for a in range(min(n, 60)) for b in range(min(n, 60)) if a != b], strict=True))
            both = [next((k for k in range(n) if max(a, b) + k == n or words[a + k] != words[b + k]), n) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
            assert ext(i, j).tolist() == both


def test_runs_query_on_whole_documents(spark, docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = Q.op13_periodic_runs(spark, SF).collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        words = texts[r.doc_id].encode().split()
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n <= 3000:
            runs = brute_runs(words) if n >= 24 and len(set(words)) < n else []
            assert r.n_runs == len(runs)
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
            drop = {i for s, m, q in runs for i in range(s + q, s + m)}
            assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest()
            best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2])) if runs else (None,) * 3
            assert (r.start, r.length, r.period) == best
            assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
            planted += len(runs)
    assert planted > 40


def test_runs_of_odd_rows(spark, odd, none):
    found = {(r.doc_id, r.collapsed): r.runs for r in periodic.find_runs(odd).collect()}
    assert found[(3, "")] == found[(4, "")] == found[(5, "")] == []
    assert found[(10, "x")] == []
    assert len(found) == 13
    assert periodic.find_runs(none).count() == 0
    rows = [(1, "a b " * 12), (2, "a b " * 11), (3, "x " + "q r s " * 9 + "q t"), (4, "z " * 70_000)]
    got = {r.doc_id: (list(map(tuple, r.runs)), r.collapsed) for r in periodic.find_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ([(0, 24, 2)], "a b"), 2: ([], " ".join(["a b"] * 11)), 3: ([(1, 28, 3)], "x q r s t"), 4: ([(0, 70_000, 1)], "z")}


def test_strongest_run_is_exact(spark):
    # 10**17 / 3 and its neighbour do not differ as doubles.
    rows = [([(5, 24, 2), (1, 24, 2), (1, 36, 3)],), ([(9, 10**9 + 1, 3), (2, 10**9, 3)],), ([],), (None,)]
    table = spark.createDataFrame(rows, f"runs {periodic.RUNS}")
    assert [r[0] and tuple(r[0]) for r in table.select(periodic.strongest("runs")).collect()] == [(1, 24, 2), (9, 10**9 + 1, 3), None, None]
