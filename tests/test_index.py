"""Search for values and canaries by fingerprints, and masking of their forms."""

import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from veilmark.functions import forms
from veilmark.functions.winnow import fingerprints
from veilmark.operators import detect, index, mask, messages, naming, nested, policy, refs, shell
from veilmark.operators import vault as V
from veilmark.plans.capture import capture
from veilmark.sources import files

BLANKS = " \t\n\r\f\x0b"


@pytest.mark.parametrize(("gram", "window"), [(6, 3), (8, 9), (1, 1), (3, 1)])
def test_a_passage_shares_its_fingerprints(gram, window):
    rng = random.Random(1)
    for _ in range(150):
        texts = ["".join(rng.choice("abé😀") for _ in range(rng.randint(0, 50))) for _ in range(rng.randint(1, 5))]
        own, found, at = fingerprints(texts, gram, window)
        for i, t in enumerate(texts):
            mine = set(zip(found[own == i].tolist(), at[own == i].tolist(), strict=True))
            least = gram + window - 1
            assert bool(mine) == (len(t) >= least)
            if len(t) >= least:
                a = rng.randint(0, len(t) - least)
                _, part, off = fingerprints([t[a : rng.randint(a + least, len(t))]], gram, window)
                assert len(part)
                assert set(zip(part.tolist(), (off + a).tolist(), strict=True)) <= mine


def brute_spans(text, some):
    """The same by looking at every character: blanks skipped one by one, growth by one, all pairs of spans compared."""
    every = set()
    for f in some:
        form = f["form"]
        places = [i for i, c in enumerate(text) if not (f["tight"] and c in BLANKS)]
        seen, k = "".join(text[i] for i in places), 0
        while (k := seen.find(form, k)) >= 0:
            a, b = places[k], places[k + len(form) - 1] + 1
            if f["grows"]:
                letters = {"hex": "0123456789abcdefABCDEF", "base64": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=", "url": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"}[f["grows"]]
                while a and text[a - 1] in letters:
                    a -= 1
                while b < len(text) and text[b] in letters:
                    b += 1
            every.add((a - b, a, f["token"], b))
            k += len(form)
    kept = []
    for _, a, token, b in sorted(every):
        if all(b <= x or y <= a for x, y, _ in kept):
            kept.append((a, b, token))
    return sorted(kept)


def test_spans_equal_brute_force():
    rng = random.Random(2)
    hits = 0
    for _ in range(400):
        some = [{"form": "".join(rng.choice("abAB01") for _ in range(rng.randint(2, 5))), "tight": rng.random() < 0.6, "grows": None, "token": f"#{i}"} for i in range(rng.randint(1, 5))]
        for f in some:
            if f["tight"] and rng.random() < 0.4:
                f["grows"] = "hex" if set(f["form"]) <= set("abAB01") and rng.random() < 0.5 else "base64"
        text = "".join(rng.choice(["a", "b", "A", "B", "0", "1", " ", "\n", "é", "-"]) if rng.random() < 0.6 else rng.choice(some)["form"] for _ in range(40))
        assert forms.spans(text, some) == brute_spans(text, some)
        hits += len(forms.spans(text, some))
    assert hits > 500


VALUE = "S3cr3tValue+/xyzABCDEFGHIJKLMNOPQRSTUVWXYZ01"
B64, HEX = base64.b64encode(VALUE.encode()).decode(), VALUE.encode().hex()


@pytest.mark.parametrize(
    ("text", "masked", "hits"),
    [
        (f"x {B64[:50]} y", "x # y", 1),  # tail cut off
        (f"x {B64[9:]} y", "x # y", 1),  # head cut off
        (f"x {HEX[20:]} y", "x # y", 1),
        (f"x {HEX.upper()[:40]} y", "x # y", 1),
        (f"{B64.rstrip('=')} and then prose", "# and then prose", 1),
        ("\n".join(B64[i : i + 10] for i in range(0, len(B64), 10)) + " end", "# end", 1),
        (" \x0b".join(HEX), "#", 1),
        (f"{VALUE[:20]} {VALUE[20:]}", f"{VALUE[:20]} {VALUE[20:]}", 0),  # a raw value does not span blanks
        (f"{B64[:20]} {B64[20:23]}", f"{B64[:20]} {B64[20:23]}", 0),  # shorter than a window
        (f"{VALUE}{VALUE} é {VALUE}", "## é #", 3),
    ],
)
def test_wrapped_and_cut_encodings(spark, text, masked, hits):
    vault = spark.createDataFrame([("s", "v", VALUE)], "session_id string, name string, value string")
    rows = spark.createDataFrame([("s", text)], "session_id string, text string")
    assert tuple(mask.mask_values(rows, vault, "session_id", token="#").select("masked", "hits").first()) == (masked, hits)


def test_candidates_hold_every_value_that_a_text_holds(spark):
    rng = random.Random(3)
    values = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(8, 14))) for _ in range(300)})
    texts = [("s" if i % 3 else "t", "".join(rng.choice("abc ") for _ in range(rng.randint(0, 400)))) for i in range(80)] + [("s", "x " + values[0])] * 40 + [(None, values[0]), ("s", None), ("u", values[0])]
    vault = spark.createDataFrame([(s, f"n{i}", v, "prompt") for s in "st" for i, v in enumerate(values)], "session_id string, name string, value string, source string")
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "call_id long, session_id string, args string")
    got = {r.call_id: r.names for r in policy.literal_names(rows, vault).collect()}
    want = {i: sorted(f"n{k}" for k, v in enumerate(values) if v in (t or "")) for i, (s, t) in enumerate(texts) if s in ("s", "t")}
    assert got == {i: names for i, names in want.items() if names}
    assert len(got) > 50


def test_sweep_of_long_texts_and_odd_canaries(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("ab é") for _ in range(200_000))
    same = "ab" * 20_000
    rows = spark.createDataFrame([(1, long), (2, long), (3, same), (4, None), (5, ""), (6, "exact canary here")], "id long, text string")
    names = {"tail": long[-9:], "middle": long[100_000:100_200], "dense": "abababababababab", "whole": "exact canary here", "none": "no such canary at all", "short": "abc", "eight": "exact ca"}
    canaries = spark.createDataFrame([(v,) for v in [*names.values(), names["whole"], None]], "canary string")
    texts = [long, long, same, "", "", "exact canary here"]
    got = {r.canary: (r.leaks, r.examined, r.verdict) for r in files.leak_sweep(rows, canaries).collect()}
    assert got == {v: (None, 6, "not examined") if len(v) < 8 else (n, 6, "hit" if n else "clean") for v in names.values() for n in [sum(v in t for t in texts)]}
    places = {r.id: dict(zip(r.canaries, r.starts, strict=True)) for r in files.leak_places(rows, canaries, "text", ["id"]).collect()}
    assert places == {i + 1: {v: t.find(v) for v in names.values() if len(v) >= 8 and v in t} for i, t in enumerate(texts) if any(len(v) >= 8 and v in t for v in names.values())}


#: Names that operators have used for columns of their own.
MINE = "t low refs_ pem hits_ base values uris every texts forms done known found given bare shapes names twice own h k h2 tried string k_ m x whole digest kept lexed f n __t __low __m __v __key __hits __forms".split()


def test_columns_of_the_user_survive(spark):
    """Every operator gives back the columns it got, whatever their names, with their values."""
    rows = spark.createDataFrame([("s", "p", "password=hunter22abc AKIA" + "Q" * 16, "echo {{sec:v}}", *MINE)], "session_id string, path string, text string, command string, " + ", ".join(f"{c} string" for c in MINE))
    vault = spark.createDataFrame([("s", "v", "hunter22abc", "prompt", 1)], "session_id string, name string, value string, source string, seq long")
    done = {
        "findings": detect.with_findings(rows),
        "mask_shapes": mask.mask_shapes(rows),
        "mask_values": mask.mask_values(rows, vault, "session_id"),
        "scrub": mask.scrub(rows, vault, "session_id"),
        "scrub_columns": nested.scrub_columns(rows, ["text"], vault=vault),
        "expand_columns": nested.expand_columns(rows, ["command"], vault),
        "expand_refs": refs.expand_refs(rows, vault, "session_id", "command"),
        "classify": shell.classify(rows, vault, "session_id"),
        "environment": shell.environment(shell.classify(rows, vault, "session_id"), vault, "session_id"),
        "mask_or_redact": messages.mask_or_redact(rows, ["text"], F.lit(False)),
        "apply_capture": mask.apply_capture(rows.withColumn("items", F.array(F.struct(F.lit(9).alias("start"), F.lit(20).alias("end"), F.lit("hunter22abc").alias("value"), F.lit("v").alias("name"))))),
        "held_names": V.held_names(rows.drop("names"), vault, "text"),
        "capture": capture(rows, ["session_id"])[0],
        "with_places": index.with_places(rows, "text", spark.createDataFrame([("hunter22abc",)], "string string"), "places"),
        "findings_rows": detect.findings(rows, ["session_id", "f", "t"]),
        "suggest_names": naming.suggest_names(detect.findings(rows, ["session_id", "t"]), rows, ["session_id", "t"]),
    }
    for name, df in done.items():
        row = df.first()
        for c in set(MINE) & set(df.columns):
            assert row[c] == c, (name, c)
    assert {n: len(set(MINE) - set(df.columns)) for n, df in done.items() if n not in ("held_names", "findings_rows", "suggest_names")} == dict.fromkeys(set(done) - {"held_names", "findings_rows", "suggest_names"}, 0)


def test_no_postings_or_forms_are_broadcast(spark, tmp_path):
    """Estimates take what Python makes for no larger than the file it came from; only the bitmap, which is bounded, may go to the driver."""
    path = str(tmp_path / "rows")
    spark.range(50).select(F.lit("s").alias("session_id"), F.concat(F.lit("pw-"), F.sha2(F.col("id").cast("string"), 256)).alias("value"), F.lit("n").alias("name"), F.lit("x").alias("text")).write.parquet(path)
    rows = spark.read.parquet(path)
    by_value = mask.mask_values(rows, rows, "session_id")
    by_place = index.with_places(rows.select("text"), "text", rows.select(F.col("value").alias("string")), "places")
    for done in (by_value, by_place):
        plan = done._jdf.queryExecution().sparkPlan().toString().split("\n")
        met = [line for line in plan if "Join" in line and "gram" in line]
        assert met and all("SortMergeJoin" in line for line in met)
        assert all("word" in line or "Left" in line for line in plan if "BroadcastHashJoin" in line)


def test_small_files_with_dear_rows_are_dealt_out(spark):
    """A table of one small file is one partition as it is read, however many texts are made from it."""
    from veilmark.plans import catalogue

    assert catalogue.table(spark, "/root/testdata/sf0.01", "customer").rdd.getNumPartitions() == 1
    assert catalogue._customers(spark, "/root/testdata/sf0.01").rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism


def test_sweep_deals_out_no_places(spark, tmp_path):
    """A common short canary has a place in most texts: they are counted where they are read, and only strings with counts are shuffled."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(("lorem", "ipsum", "dolor", "sit", "amet")) for _ in range(60)) for _ in range(300)]
    canaries = sorted({t[a : a + n] for t in texts[:40] for a, n in ((rng.randint(0, 100), rng.randint(8, 97)) for _ in range(4))} | {"a" * n for n in (8, 9, 16, 33)})
    rows = spark.createDataFrame([(t,) for t in [*texts, "a" * 500, None, ""]], "text string").repartition(2)
    swept = files.leak_sweep(rows, spark.createDataFrame([(c,) for c in canaries], "canary string"))
    assert {r.canary: r.leaks for r in swept.collect()} == {c: sum(c in t for t in texts) + (c in "a" * 500) for c in canaries}
    assert "at#" not in swept._jdf.queryExecution().optimizedPlan().toString()


def test_sweep_is_exact_whatever_the_filter_lets_through(spark, monkeypatch):
    """With few bits and keys that agree nearly all windows pass; strings are compared all the same."""
    from veilmark.functions import windows

    texts = ["abcdefgh abcdefgi", "abcdefgi xbcdefgh", "abcdefghabcdefgh"]
    monkeypatch.setattr(index, "whole", lambda h, p, at, n: np.zeros(len(at), np.uint64))
    bits = np.full(1 << 15, 255, np.uint8)
    found = set(index._places_in(texts, 18, bits, {8: np.array([8])}))
    assert {(i, texts[i][a : a + n]) for i, a, n in found} == {(i, t[a : a + 8]) for i, t in enumerate(texts) for a in range(len(t) - 7)}
    assert len(windows.held(bits, 18, np.arange(5, dtype=np.uint64))) == 5


def test_masking_is_dealt_out_after_the_search(spark, tmp_path):
    """Copies of one text share a key and are few bytes: the exchange by key left all of them to one task."""
    path = str(tmp_path / "rows")
    spark.range(400).select("id", F.lit("s").alias("session_id"), F.lit("see hunter22abc").alias("text")).write.parquet(path)
    vault = spark.createDataFrame([("s", "v", "hunter22abc")], "session_id string, name string, value string")
    done = mask.mask_values(spark.read.parquet(path), vault, "session_id")
    sizes = done.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(sizes) > 2 * spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in sizes) <= 60


def test_names_search_their_context_once(spark):
    """The words around a value were searched for again at each use of what was found: hundreds of searches a row."""
    rows = spark.createDataFrame([(1, "the database password=hunter22abc of production")], "id long, text string")
    named = naming.suggest_names(detect.findings(rows, ["id"], tiers="evidenced"), rows, ["id"])
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("lower(substring") for line in plan.split("\n")) == 1


def shuffled(spark):
    """Bytes that each stage so far has written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_many_values_of_one_session_stay_apart(spark, monkeypatch):
    """Short grams of hexadecimal forms were shared by many values, each of which was tried in each text, and every form was dealt out with all its fingerprints."""
    n = 4000
    value = F.concat(F.lit("pw-"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 33))
    vault = spark.range(n).select(F.lit("s").alias("session_id"), F.concat(F.lit("v"), "id").alias("name"), value.alias("value"))
    code = F.upper(F.hex(F.col("value").cast("binary")))
    rows = vault.select("session_id", F.col("name").alias("of"), F.concat(F.lit("see "), "value", F.lit(" and "), F.substring(code, 31, 100)).alias("text"))
    tried, real = [], mask.with_forms_masked
    monkeypatch.setattr(mask, "with_forms_masked", lambda df, texts, forms, out: (tried.append(df.select(F.size(forms).alias("n"))), real(df, texts, forms, out))[1])
    before = shuffled(spark)
    wrong = mask.mask_values(rows, vault, "session_id", token=None).where("masked <> concat('see {{sec:', of, '}} and {{sec:', of, '}}') or hits <> 2")
    assert wrong.count() == 0
    assert 0 < sum(b for stage, b in shuffled(spark).items() if stage not in before) < 5000 * n
    assert tried[0].agg(F.max("n")).first()[0] < 20


def test_every_form_of_every_length_is_met(spark):
    """Values of 8 to 60 characters, some with blanks, as they are and in each encoding with blanks put in, whole and cut."""
    rng = random.Random(11)
    values, texts = [], []
    for n in (*range(8, 41), 60, 300):
        value = "".join(rng.choice("abcXYZ0189+/?>~é   ") if i % 5 else rng.choice("qrst") for i in range(n))
        raw = value.encode()
        b64, code = base64.b64encode(raw).decode(), raw.hex()
        values.append(value)
        forms_ = {b64, b64.rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("="), code, code.upper()}
        cut = {e[:a] if a else e[-26:] for e in (b64.rstrip("="), code.upper()) if len(e) >= 42 for a in (25, 0)}
        texts += [(value, f"é {value}!")] + [(value, "é " + " \n".join(e[i : i + 7] for i in range(0, len(e), 7)) + " !") for e in forms_] + [(value, f"é {e} !") for e in cut]
    vault = spark.createDataFrame([("s", f"n{i}", v) for i, v in enumerate(values)], "session_id string, name string, value string")
    rows = spark.createDataFrame([("s", v, t) for v, t in texts], "session_id string, value string, text string")
    done = mask.mask_values(rows, vault, "session_id", token="#").collect()
    assert len(done) == len(texts) > 200
    assert [(r.value, r.text, r.masked) for r in done if r.masked.replace(" !", "!") != "é #!" or r.hits != 1] == []


def test_keys_of_two_types_meet(spark):
    vault = spark.createDataFrame([(7, "v", "hunter22abc"), (8, "w", "other-value")], "session_id long, name string, value string")
    rows = spark.createDataFrame([(7, "see hunter22abc and other-value"), (9, "hunter22abc")], "session_id int, text string")
    assert {r.masked for r in mask.mask_values(rows, vault, "session_id", token="#").collect()} == {"see # and other-value", "hunter22abc"}


def test_values_of_their_own_sessions_are_dealt_out_as_numbers(spark):
    """Two short values a session, one inside the other: their forms went to two shuffles with each of their fingerprints, some 15 KB a session."""
    n = 3000
    short = F.concat(F.lit("zq"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 10))
    rows = spark.range(n).select(F.col("id").cast("string").alias("session_id"), F.concat(short, F.lit("-tail-99 then "), short, F.lit("-tail.")).alias("text"), short.alias("value"))
    vault = rows.select("session_id", F.lit("short").alias("name"), "value").union(rows.select("session_id", F.lit("long"), F.concat("value", F.lit("-tail-99"))))
    before = shuffled(spark)
    done = mask.mask_values(rows.select("session_id", "text"), vault, "session_id", token=None).groupBy("masked").count().collect()
    assert [tuple(r) for r in done] == [("{{sec:long}} then {{sec:short}}-tail.", n)]
    assert 0 < sum(b for stage, b in shuffled(spark).items() if stage not in before) < 4000 * n
