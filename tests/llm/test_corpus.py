"""Language, quality, mixing, decontamination, near duplicates, lines, pages and the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from veilmark.llm import decontaminate, jaccard, language, mixing, pages, pii, quality, shingles, substrings
from veilmark.llm import queries as Q

SF = "/root/testdata/sf0.01"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


# --- language

def brute_language(text, profiles):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    grams = Counter()
    for w in words:
        w = f" {w} "
        grams.update(w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1) if w[i : i + n].strip())
    top = sorted(grams, key=lambda g: (-grams[g], len(g), g))[: language.PROFILE]
    if not top:
        return "und"
    costs = {lang: sum(abs(p.index(g) - r) if g in p else language.PROFILE for r, g in enumerate(top)) for lang, p in profiles.items()}
    return min(sorted(costs), key=costs.get)


def test_language_held_out_and_brute_force(spark, docs):
    labelled = {r.doc_id: r for r in docs.collect()}
    profiles = language.fit_profiles(docs.where(~language.held_out()))
    rows = Q.op1_language_id(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == labelled[r.doc_id].lang for r in held]) > 0.98
    for r in random.Random(1).sample(rows, 80):
        assert r.lang_pred == brute_language(labelled[r.doc_id].text, profiles)


def test_language_odd_rows(odd, none):
    profiles = language.fit_profiles(odd)
    got = {r.doc_id: r for r in language.identify(odd, profiles).collect()}
    assert len(language.identify(odd, profiles).collect()) == odd.count()
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 9))
    assert got[2].lang_pred == "de"
    assert language.fit_profiles(none) == {}
    assert language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    assert language.keep_identified(odd, profiles, 0.0).columns == odd.columns
    assert language.keep_identified(none, profiles).count() == 0


# --- quality

def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in Q.op4_quality(spark, SF).collect() if r.held_out and labels.get(r.doc_id) is not None]
    y = np.array([labels[r.doc_id] for r in rows])
    s = np.array([r.score for r in rows])
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]) > 0.9


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (9, 0, None), (None, 1, 0), (6, None, 0), (11, 1, 0), (11, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(odd, labels)
    rows = quality.quality_scores(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert len({r.score for r in rows if r.doc_id == 11}) == 2
    flat = quality.fit(none, labels.limit(0))
    assert {round(r.score, 6) for r in quality.quality_scores(odd, flat).collect()} == {0.5}


def brute_risk(x, pos, prior, w):
    """Row by row: the two terms of the non-negative risk, without the ridge."""
    z = [float(sum(a * b for a, b in zip(row, w))) for row in x]
    plus, minus = [np.log1p(np.exp(-v)) for v in z], [np.log1p(np.exp(v)) for v in z]
    own = [i for i, p in enumerate(pos) if p]
    first = prior * sum(plus[i] for i in own) / len(own)
    return first, sum(minus) / len(z) - prior * sum(minus[i] for i in own) / len(own)


@pytest.mark.parametrize("scale", [0.3, 6.0])
def test_risk_and_gradient(scale):
    """Against a plain sum and finite differences, with the second term above and below 0."""
    rng = np.random.default_rng(2)
    x = np.concatenate((rng.normal(0, 1, (40, 4)), np.ones((40, 1))), 1)
    pos = x[:, 0] + 0.3 * rng.normal(size=40) > 0.2
    w, prior = scale * np.array([1.0, 0.2, -0.1, 0.4, 0.0]), 0.8
    value, second, down, curve = quality.risk(quality.risk_sums(x, pos, w), prior, w)
    first, other = brute_risk(x, pos, prior, w)
    assert second == pytest.approx(other)
    assert value == pytest.approx(first + max(0.0, other) + quality.RIDGE / 2 * w @ w)
    assert (second < 0) == (scale > 1)

    def goal(v):
        a, b = brute_risk(x, pos, prior, v)
        return a + b + quality.RIDGE / 2 * v @ v if scale < 1 else -b

    steps = np.eye(5) * 1e-5
    assert down == pytest.approx([(goal(w + e) - goal(w - e)) / 2e-5 for e in steps], abs=1e-6)
    if scale < 1:
        for i, e in enumerate(steps):
            ahead, behind = (quality.risk(quality.risk_sums(x, pos, w + k * e), prior, w + k * e)[2] for k in (1, -1))
            assert curve[i] == pytest.approx((ahead - behind) / 2e-5, abs=1e-5)


def test_least_risk_and_sums_in_spark(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(0, 1, (200, 3)), np.ones((200, 1))), 1)
    pos = (x[:, 0] > 0) & (rng.random(200) < 0.5)
    w = quality.minimise(lambda v: quality.risk_sums(x, pos, v), 0.5, 4)
    down, v = None, np.zeros(4)
    for _ in range(20_000):  # plain descent
        _, second, down, _ = quality.risk(quality.risk_sums(x, pos, v), 0.5, v)
        assert second >= 0
        v = v - 0.5 * down
    assert w == pytest.approx(v, abs=1e-2)
    texts = [f"word{i} " * (i + 1) for i in range(50)]
    rows = quality.feature_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    total = quality._summed(rows, lambda b: quality._matrix(b.column(1)).sum(0), len(quality.NAMES))
    assert total == pytest.approx(sum(quality.features(t).astype(np.float32).astype(float) for t in texts))


# --- mixing

def test_mixing(spark, odd, none):
    rows = Q.op5_source_mix(spark, SF).collect()
    assert Q.op5_source_mix(spark, SF).exceptAll(Q.op5_source_mix(spark, SF)).isEmpty()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    per = spark.createDataFrame(rows).join(docs, "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m"))
    assert all(abs(r.k - r.t) <= r.m for r in per.collect())
    assert mixing.copies(none).count() == 0
    assert mixing.copies(odd).count() == odd.count()
    assert mixing.mix(odd).columns == [*odd.columns, "copy_"]
    assert mixing.mix(odd).count() == mixing.copies(odd).agg(F.sum("copies")).first()[0]


def brute_mix(rows, most=3, weights=(1, 2, 3)):
    """Copies of (id, source, words), listed by source, falling size, md5 of the id and id."""
    import hashlib
    import math

    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s))
    sizes = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full, left = set(), sum(sizes.values())
    while True:
        level = (left - sum(most * sizes[s] for s in full)) / (sum(weight[s] for s in sources if s not in full) or 1)
        more = {s for s in sources if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            break
        full |= more
    out = []
    for s in sources:
        rate = min(most * sizes[s], weight[s] * level) / sizes[s] if sizes[s] else 0
        u = int(hashlib.md5(f"0:{s or ''}".encode()).hexdigest()[:8], 16) / 2**32
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (-r[2], hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]))
        out += [(r, math.floor((i + 1) * rate + u) - math.floor(i * rate + u)) for i, r in enumerate(own)]
    return out


def test_rows_of_one_id_keep_their_own_copies(spark):
    """Rows that share an id, or have none, are taken as often as their own place says."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2, None, i + 10]), f"{i} " + " ".join("w" * rng.randint(0, 30)), f"s{i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(r.text for r in mixing.mix(df).collect())
    want = mixing.copies(df)
    assert sum(got.values()) == want.agg(F.sum("copies")).first()[0]
    per_size = Counter()
    for r in want.collect():
        per_size[r["size"], r["source"]] += r["copies"]
    mixed = Counter()
    for _, t, s in rows:
        mixed[len(t.split()), s] += got[t]
    assert mixed == per_size
    assert max(got.values()) <= 3


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), ("c", 1000), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 3
    assert got["b"] == 30
    assert sum(got.values()) == pytest.approx(1111)
    assert got[None] == pytest.approx(min(300, (1111 - 33) / 4))


# --- decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, w):
    x = WORD.findall(lower(text))
    hit, found = [False] * len(x), set()
    for name, item in items:
        y = WORD.findall(lower(item))
        m = min(w, len(y))
        windows = {tuple(y[i : i + m]) for i in range(len(y) - m + 1)} if y else set()
        for i in range(len(x) - m + 1):
            if tuple(x[i : i + m]) in windows:
                found.add(name)
                hit[i : i + m] = [True] * m
    return len(x), sum(hit), found


def test_automaton_against_brute_force():
    rng = random.Random(5)
    for _ in range(800):
        letters, w = rng.choice(["ab", "abc", "abcd"]), rng.choice([2, 3, 4])
        items = [(str(i), " ".join(rng.choice(letters) for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 5))]
        text = " ".join(rng.choice(letters + "z") for _ in range(rng.randint(0, 25)))
        words = decontaminate.words_of(text)
        spans, found = decontaminate.Automaton([(n, decontaminate.words_of(t)) for n, t in items], w).match(words)
        assert (len(words), sum(b - a for a, b in spans), found) == brute_hits(text, items, w)


def test_repetitive_item_takes_linear_time():
    import time

    words = [b"a", b"b"] * 10_000
    automaton = decontaminate.Automaton([("1", words[:4000])])
    began = time.time()
    spans, _ = automaton.match(words)
    assert spans == [[0, len(words)]]
    assert time.time() - began < 1


def test_blocks_of_items_give_the_same(spark):
    """Items in many blocks, rows with repeated and null ids; spans of several blocks merge."""
    rng = random.Random(9)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 14)))) for i in range(12)]
    texts = [(rng.choice([1, 2, None, i + 3]), "É, " + " - ".join(rng.choice("abcdez") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    one = decontaminate.contamination(docs, bench, 4)
    many = decontaminate.contamination(docs, bench, 4, block_words=15)
    assert len(decontaminate.item_blocks(bench, block_words=15)) > 3
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    cut = [sorted(map(str, decontaminate.remove_contamination(docs, bench, 4, max_share=0.9, block_words=b).collect())) for b in (15, 10_000)]
    assert cut[0] == cut[1]


def test_length_limit(spark):
    item = " ".join(f"i{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "a " * 40 + " ".join(f"i{k}" for k in range(12)) + " b"), (2, "a " * 40 + item + ", b c"), (3, "a b short item c d e f g")], "doc_id long, text string")
    bench = spark.createDataFrame([("x", item), ("y", "Short item")], "item_id string, text string")
    left = {n: {r.doc_id: r.text for r in decontaminate.remove_contamination(docs, bench, min_words=n).collect()} for n in (1, 12, 13, 31)}
    assert all("i3" not in left[1][i] for i in (1, 2)) and left[1][3] == "a b   c d e f g"
    assert left[12] == left[1] | {3: "a b short item c d e f g"}
    assert "i3" in left[13][1] and "i3" not in left[13][2] and left[13][2].endswith("a  , b c")
    assert all("i3" in left[31][i] for i in (1, 2))


def test_decontamination_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the LAZY dog near"), (2, "Hund am"), (3, None), (4, "!!"), (None, "x")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, bench).collect()}
    assert got[1].n_hit == 10
    assert got[1].item_ids == ["1"]
    assert got[2].n_hit == 2
    assert got[10].item_ids == [""]
    assert got[3].n_words == 0
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.remove_contamination(odd, bench, max_share=0.5)
    assert kept.columns == odd.columns
    left = {r.doc_id: r.text for r in kept.collect()}
    assert 1 not in left
    assert left[2] == "Der schnelle braune Fuchs springt über den faulen   alten Fluss."
    assert left[3] is None


# --- near duplicates

def brute_classes(texts, size, percent):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    comp = {i: i for i in texts}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 60)])
def test_similarity_classes(spark, size, percent):
    rng = random.Random(7)
    texts, i = {}, 0
    for words, copies in ((60, 40), (30, 25), (12, 20), (3, 8), (1, 5)):
        first = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            own = list(first)
            for _ in range(rng.randint(0, max(1, words // 12))):
                own[rng.randrange(len(own))] = f"w{rng.randint(0, 400)}"
            i += 1
            texts[i * 3 % 1009] = " ".join(own)
    texts |= {2000: "", 2001: None, 2002: " \n", 2003: "Common line of words\n" + texts[3], 2004: texts[3].upper()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, size, percent).collect()}
    assert got == brute_classes(texts, size, percent)


def test_long_lists_and_groups(spark, monkeypatch):
    """With short lists of two, most pairs come from stars and from the open lists."""
    monkeypatch.setattr(jaccard, "SHORT", 2)
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rng = random.Random(11)
    base = [f"a{k}" for k in range(40)]
    texts = {}
    for i in range(1, 90):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(40)] = f"b{rng.randint(0, 30)}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, 3, 70).collect()}
    assert got == brute_classes(texts, 3, 70)


def test_links_between_members_of_one_prefix(spark):
    """L, M1, M2 of one size and prefix; only M1 and M2 link, and no other leader (or one at a late place) shares the prefix."""
    order = sorted((f"k{i}" for i in range(2000)), key=lambda w: shingles.shingle_sets([w], 1)[0][0])
    texts = {}
    for g in range(16):
        prefix, tail = order[3 * g : 3 * g + 3], order[100 + 100 * g : 200 + 100 * g]
        own = (tail[:10], tail[10:20], tail[10:19] + tail[20:21])
        texts |= {10 * g + j: " ".join(prefix + words) for j, words in enumerate(own)}
        if g % 2:
            texts[10 * g + 3] = " ".join(prefix[2:] + tail[30:42])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(16, "doc_id")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, 1, 80).collect()}
    assert got == brute_classes(texts, 1, 80)
    assert all(got[10 * g + 2][1] == 10 * g + 1 for g in range(16))


def test_similarity_odd_rows(odd, none):
    rows = jaccard.similarity_classes(odd).collect()
    assert len(rows) == odd.count()
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert [r.component_id for r in rows if r.doc_id == 1] == [1, 1]
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in rows if r.doc_id in (3, 4, 5))
    assert jaccard.similarity_classes(none).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 11]
    assert kept.where("doc_id is null").count() == 2


def test_one_id_with_two_texts(spark):
    w, v = (" ".join(f"{c}{i}" for i in range(20)) for c in "wv")
    df = spark.createDataFrame([(3, w), (5, w), (5, v), (7, v), (7, v), (None, w)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.similarity_classes(df).collect() if r.doc_id is not None)
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (7, 5)]
    assert sorted((r.doc_id or 0, r.text[0]) for r in jaccard.keep_one(df).collect()) == [(0, "w"), (3, "w"), (5, "v")]


def test_long_list_of_unlike_documents(spark, monkeypatch):
    """Documents that share frequent shingles but do not link, and a few that do, in small slices."""
    monkeypatch.setattr(jaccard, "SLICE", 4)
    monkeypatch.setattr(jaccard, "SHORT", 2)
    rng = random.Random(21)
    common = [f"c{k}" for k in range(6)]
    texts = {}
    for i in range(60):
        own = common + [f"d{rng.randint(0, 40)}" for _ in range(rng.randint(2, 12))]
        rng.shuffle(own)
        texts[i] = " ".join(own)
        if i % 7 == 0:
            texts[100 + i] = " ".join([*own, "x"])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(df, 1, 70).collect()}
    assert got == brute_classes(texts, 1, 70)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (1, 5, 70, 900):
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate((a[: n // 2], rng.integers(-(2**62), 2**62, n))))
        x, y = jaccard.parity_bits(a), jaccard.parity_bits(b)
        assert jaccard.differing(x, y) <= len(np.setxor1d(a, b))
        assert jaccard.differing(jaccard.folded(x).tobytes(), jaccard.folded(y).tobytes()) <= jaccard.differing(x, y)


def test_shingles_are_sets():
    texts = ["a b c d a b c d", "A b C d", "a b", "", "é É", "x" * 100_000]
    assert [len(s) for s in shingles.shingle_sets(texts, 4)] == [4, 1, 1, 0, 1, 1]


# --- lines

def test_passage_inside_a_line(spark, odd, none):
    passage = " ".join(f"word{i}" for i in range(55)) + "."
    df = spark.createDataFrame([(1, f"Start here now. {passage}"), (2, f"Other text. {passage} More of it."), (3, "A clean text of its own.")], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup_substrings(df).collect()}
    assert passage in got[1].text
    assert "word30" not in got[2].text
    assert "More of it." in got[2].text
    assert got[3].n_removed == 0
    assert substrings.dedup_substrings(none).count() == 0
    rows = substrings.dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_removed == 0 for r in rows)


def brute_units(text, run=20, line_least=20):
    """Normalised lines, and runs of at least ``run`` words from sentence and line starts to sentence ends and line ends."""
    out, at = set(), 0
    starts, ends, stops, ended = [], [], [], True
    for line in text.split("\n"):
        parts = list(re.finditer(r"[^\s.!?]*[.!?]+|[^\s.!?]+", line))
        if not line.strip():
            if stops:
                ends.append(stops[-1])
        elif len(parts) >= line_least:
            out.add((at, at + len(line), " ".join(line.lower().split())))
        ended = True
        for m in parts:
            if ended:
                starts.append((at + m.start(), len(stops), at + len(line)))
            stops.append(at + m.end())
            if ended := m[0][-1] in ".!?":
                ends.append(at + m.end())
        at += len(line) + 1
    for a, k, line_end in starts:
        far = stops[k + run - 1] if len(stops) > k + run - 1 else None
        if far is None:
            continue
        whole = min(e for e in [*ends, stops[-1]] if e >= far)
        line_stop = max(s for s in stops if s <= line_end)
        for b in {whole, min(whole, line_stop)} if far <= line_stop else {whole}:
            words = " ".join(text[a:b].lower().split())
            if not any(x <= a and b <= y and w == words for x, y, w in out):
                out.add((a, b, words))
    return out


@pytest.mark.parametrize(("run", "line_least"), [(20, 20), (8, 1)])
def test_units_against_brute_force(docs, run, line_least):
    texts = [r.text for r in docs.limit(60).collect() if r.text]
    texts += ["One two. Three four five six seven eight nine\nten. 3.14 is more than 3 or so they say it!\n\n  Short\n a. b\n", "...so. " * 3 + "\nİ ΟΔΟΣ x" * 12]
    words = {}
    for t in texts:
        own = substrings.units(t, run, line_least)
        assert {u[:2] for u in own} == {u[:2] for u in brute_units(t, run, line_least)}
        digests = {u[:2]: u[2] for u in own}
        for a, b, w in brute_units(t, run, line_least):
            assert words.setdefault(w, digests[a, b]) == digests[a, b]
    assert len(set(words.values())) == len(words)


def brute_dedup(rows, run=20, line_least=20):
    """Spans and text left of (id, text), in the order of ids; letters of repeated units are struck one by one."""
    seen, out = set(), {}
    for i, text in rows:
        struck = set()
        for a, b, words in sorted(brute_units(text, run, line_least)):
            if words in seen:
                struck.update(range(a, b))
            seen.add(words)
        spans = [(k, next(e for e in range(k, len(text) + 1) if e not in struck)) for k in sorted(struck) if k - 1 not in struck]
        marked = "".join("" if k in struck and k - 1 in struck else "\0" if k in struck else c for k, c in enumerate(text))
        left = [line.replace("\0", "") for line in marked.split("\n") if "\0" not in line or line.replace("\0", "").strip()]
        out[i] = ",".join(f"{a}:{b}" for a, b in spans), "\n".join(left)
    return out


def test_dedup_against_brute_force(spark, docs, monkeypatch):
    rows = sorted((r.doc_id, r.text) for r in docs.limit(400).collect() if len(r.text) < 6000)
    rows += [(5000 + i, "\n".join(" ".join(t.split()[k : k + 9]) for k in range(0, len(t.split()), 9))) for i, t in rows[:80]]
    for hot in (10_000, 3):  # with and without digests that count as hot
        monkeypatch.setattr(substrings, "HOT_UNITS", hot)
        got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        want = brute_dedup(rows)
        assert {r.doc_id: (r.removed_spans, r.text) for r in got} == want
    assert sum(bool(s) for s, _ in want.values()) > 50


def test_common_short_lines_go_by_their_documents(spark):
    """A line of three words that five documents have goes from all but the first; one that two share, or one repeats, stays."""
    rows = [(i, f"Own text number {i}.\nShare this page\n" + ("By chance\n" if i < 2 else "") + ("twice here\ntwice here\n" * 4 if i == 3 else "") + "End.") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.dedup_substrings(df, common=5).collect()}
    assert got == {i: t if i == 0 else t.replace("Share this page\n", "").replace("\nEnd.", "") for i, t in rows}
    assert {r.doc_id: r.text for r in substrings.dedup_substrings(df, common=6).collect()} == dict(rows)
    assert {r.doc_id: r.text for r in substrings.dedup_substrings(df).collect()} == dict(rows)


def test_paragraph_breaks_stay():
    text = "First one.\n\nSecond one.\n\nGONE gone\n  \nmore GONE\nLast"
    at = text.index("GONE gone")
    assert substrings.without(text, []) == text
    assert substrings.without(text, [(at, at + 9)]) == "First one.\n\nSecond one.\n\n  \nmore GONE\nLast"
    assert substrings.without(text, [(at, at + 9), (text.index("GONE\nLast"), len(text) - 5)]) == "First one.\n\nSecond one.\n\n  \nmore \nLast"
    assert substrings.without(text, [(at, len(text) - 4)]) == "First one.\n\nSecond one.\n\nLast"
    assert substrings.without("a\nb", [(0, 3)]) == ""


def test_one_id_keeps_both_texts(spark):
    passage = " ".join(f"said{i}" for i in range(30)) + "."
    rows = [(1, f"{passage} More."), (2, f"{passage} Other."), (2, "completely different and unique words here at all"), (None, passage), (3, None), (2, f"{passage} Other.")]
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "id long, text string"), id_col="id").collect()
    assert Counter((r.id, r.text) for r in got) == Counter({(1, f"{passage} More."): 1, (2, " Other."): 2, (2, rows[2][1]): 1, (None, passage): 1, (3, None): 1})


def test_passages_meet_across_lines(spark):
    long = " ".join(f"only{i}" for i in range(24)) + "."
    wrapped = [" ".join(f"wrap{i}" for i in range(k, k + 15)) + "." for k in (0, 15, 30, 45)]
    words = " ".join(wrapped).split()
    rows = [
        (1, long),
        (2, f"Before it. {long} After it."),
        (3, "Head\n" + "\n".join(" ".join(words[i : i + 7]) for i in range(0, 60, 7))),
        (4, "Other\n" + "\n".join(" ".join(words[i : i + 11]) for i in range(0, 60, 11)) + " Tail."),
        (5, "\n".join(f"item{i}" for i in range(60)) + "\nfive"),
        (6, "six\n" + "\n".join(f"item{i}" for i in range(60)) + "\nseven"),
        (7, f"Early. {' '.join(f'in{i}' for i in range(20))}. Late."),
        (8, " ".join(f"in{i}" for i in range(20)) + "."),
        (9, "All rights reserved.\nOne text."),
        (10, "All rights reserved.\nAnother."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in substrings.dedup_substrings(df).collect()}
    assert "only" not in got[2] and "Before it." in got[2]
    assert "wrap15" not in got[4] and "wrap59" not in got[4] and "Tail." in got[4]
    assert got[8] == ""
    assert all(got[i] == t for i, t in rows if i in (1, 3, 5, 7, 9, 10))
    every_line = {r.doc_id: r.text for r in substrings.dedup_substrings(df, line_words=1).collect()}
    assert every_line[6] == "six\nseven"
    assert every_line[10] == "Another."


# --- pages

def test_articles(spark):
    import html

    rows = {r.page_id: r for r in Q.op7_main_text(spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", p.html, re.S)
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", m[1]))).split())
        assert rows[p.page_id].text == text
        assert rows[p.page_id].n_chars == len(text)


PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div>
<div class="wrap"><ul class="menu"><li><a href=x>Home</a></ul><div class="post"><h1>Title</h1><div class="post-body"><p>One <b>bo</b>ld &amp; two&nbsp;three
<p>Second paragraph &eacute; long enough to win the vote here<script>var x = "<p>no</p>"</script></div><div class="ad-slot">buy</div>
<section id="comments"><p>I like it a lot and so on and on</p></section><form><input><label>mail</label></form></div><aside>side</aside></div><div class="site-footer">foot</div>"""


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "http://h.example/a", PAGE), (2, None, None), (3, "odd", ""), (4, "http://h.example/b", "<p>short<!-- x"), (1, "http://h.example/a", PAGE)], "page_id long, url string, html string")
    rows = pages.main_text(df).collect()
    assert len(rows) == 5
    by = {r.page_id: r.text for r in rows}
    assert by[1] == "Title One bold & two three Second paragraph é long enough to win the vote here"
    assert by[2] == by[3] == ""
    assert by[4] == "short"
    assert pages.main_text(df.limit(0)).count() == 0


def test_article_text_is_kept(spark):
    html = """<body><nav>Home</nav><article><h1>Title</h1><p>Let <math><mi>x</mi></math> be <label>one</label>.</p><p class="story related">Kept para.</p>
    <div class="social"><a href=a>Tweet</a> <a href=b>Post</a></div><div class="discussion">A long discussion of the matter, <a href=c>see</a>.</div>
    <video>No video here.</video><noscript>Read <b>on</b>.</noscript><textarea>typed</textarea><svg><text>drawn</text></svg><canvas>painted</canvas>
    <form><textarea>gone</textarea></form><object>object text</object></article><aside>side</aside></body>"""
    text = pages.main_text(spark.createDataFrame([(1, "http://k.example/", html)], "page_id long, url string, html string")).first().text
    assert text == "Title Let x be one. Kept para. A long discussion of the matter, see. No video here. Read on. typed drawn painted object text"


def test_names_inside_an_article_only_raise_doubt(spark):
    """Parts of an article that are named like page furniture stay, unless they are links or named so and nothing else."""
    kept = {"privacy": '<section id="privacy">', "search": '<div id="search">', "menu": '<p class="menu">', "comments policy": '<section class="comments-policy">', "ad hoc": '<section class="ad-hoc">', "login": '<div class="login">', "form": '<div class="long form">'}
    gone = ['<div class="comments">', '<section id="comment-list">', '<div class="ad">', '<div class="ad-slot">', '<div class="sidebar">', '<div class="cookie-notice">', '<div class="post-comments">', '<div class="newsletter box">']
    close = lambda tag: f"</{tag[1:].split()[0]}>"
    body = "".join(f"{t}Text on {n} here.{close(t)}" for n, t in kept.items()) + "".join(f"{t}Dropped words.{close(t)}" for t in gone)
    page = f'<body><article><h1>Title</h1>{body}<div class="menu"><a href=a>Dropped</a> <a href=b>words</a></div></article></body>'
    text = pages.main_text(spark.createDataFrame([(1, "http://doubt.example/", page)], "page_id long, url string, html string")).first().text
    assert text == "Title " + " ".join(f"Text on {n} here." for n in kept)


def test_host_outvotes_a_page(spark, monkeypatch):
    """A page whose own best container is the wrong one gives the container that its host's pages agree on."""
    def page(i, body, extra):
        return i, "http://votes.example/p", f"<body><div class='stage{i}'><div class='prose'><h2>T{i}</h2><p>{body}</p></div><div class='stock'><p>{extra}</p></div></div></body>".replace(f"stage{i}", "stage")

    rows = [page(i, "a long story about things that took place " * 6, "short terms") for i in range(5)] + [page(9, "Brief item.", "Long stock text of the seller of the site in full " * 9)]
    rows += [(20, "http://alone.example/p", rows[-1][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for most in (50_000, 0):  # joined by broadcast, and by host and salt
        monkeypatch.setattr(pages, "BROADCAST_HOSTS", most)
        got = {r.page_id: r for r in pages.main_text(df).collect()}
        assert got[9].text == "T9 Brief item."
        assert got[9].path == got[1].path
        assert "Long stock" in got[20].text


def test_deep_pages_take_linear_time():
    import time

    began = time.time()
    deep = pages.Page("<div>" * 6000 + "<p>some words here</p>" + "</div>" * 6000)
    path = deep.best().path()
    assert deep.text(path) == ("some words here", path)
    assert time.time() - began < 2


# --- pipeline

def brute_redacted(text, spans):
    """The spans found, merged where they overlap, under the kind of the first; all base spans are among them."""
    from test_text_scans import base_pii

    own = [(int(a), pii.KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]
    assert set(base_pii(text)) <= set(own)
    parts, since, open_ = [], 0, None
    for a, k, b in [*sorted(own), (len(text) + 1, 0, 0)]:
        if open_ and a < open_[2]:
            open_ = (open_[0], open_[1], max(b, open_[2]))
            continue
        if open_:
            parts += (text[since : open_[0]], f"[{pii.KINDS[open_[1]].upper()}]")
            since = open_[2]
        open_ = (a, k, b)
    return "".join([*parts, text[since:]])


def test_pipeline(spark, odd):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, stages = docs, {}
    for name, stage in C.STAGES:
        before = C.settled(stage(spark, before, SF))
        stages[name] = before
        if name != "mixing sources":
            assert before.columns == docs.columns
    texts = {r.doc_id: r.text for r in stages["language id"].collect()}
    assert len(texts) == 1000
    kept = {r.doc_id for r in stages["n-gram jaccard join"].collect()}
    assert kept == {i for i, (_, c) in brute_classes(texts, 5, 80).items() if i == c}
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = stages["benchmark decontamination"].collect()
    assert not any(brute_hits(r.text, bench, 10)[1] for r in clean)
    assert len(clean) == sum(brute_hits(texts[i], bench, 10)[1] <= 0.5 * len(WORD.findall(texts[i])) for i in kept)
    redacted = {r.doc_id: r.text for r in stages["personal data"].collect()}
    before = stages["benchmark decontamination"]
    spans = {r.doc_id: r.spans for r in pii.find_pii(before, pii.fit(before)).collect()}
    assert redacted == {r.doc_id: brute_redacted(r.text, spans[r.doc_id]) for r in clean}
    source = {r.doc_id: r.source for r in clean}
    counts = brute_mix([(i, source[i], len(re.findall(r"[^\x20\x09-\x0D]+", t))) for i, t in redacted.items()])
    rows = stages["mixing sources"].collect()
    assert Counter(r.doc_id for r in rows) == Counter({r[0]: n for r, n in counts if n})
    for r in rows:
        assert redacted[r.doc_id] == r.text
        assert 1 <= r.copy <= 3
    assert C.personal_data(spark, odd, SF).count() == odd.count()
    assert C.decontamination(spark, odd, SF).count() == odd.count()
    whole = C.run(spark, SF)
    assert whole.exceptAll(stages["mixing sources"]).isEmpty() and whole.count() == len(rows)


def test_registered(spark):
    import __spark_entry__ as E

    names = list(E.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)
    assert pii.KINDS[:4] == pii.BASE


def test_frequent_shingles_are_picked_in_little_memory():
    """Only what is frequent is copied: counts of every shingle of a slice took three times its size."""
    import tracemalloc

    rng = np.random.default_rng(5)
    tokens = rng.integers(-(1 << 62), 1 << 62, 400_000)
    tokens[:3000] = np.repeat(tokens[:500], 6)
    want = {t: n for t, n in Counter(tokens.tolist()).items() if n >= jaccard.SEEN}
    tracemalloc.start()
    values, counts = jaccard.often(tokens)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == want
    assert peak < tokens.nbytes // 2
    assert [len(x) for x in jaccard.often(np.array([4, 4]))] == [0, 0] == [len(x) for x in jaccard.often(np.empty(0, np.int64))]
