"""Publication in two phases, joins of stored spans, numbers in gaps."""

import random

import pytest
from pyspark.sql import functions as F
from veilmark.operators import intervals, mask, naming
from veilmark.sources import publish

ROWS = [(1, "password=hunter22abc"), (2, "plain"), (3, None)]


def masked(spark, rows=ROWS):
    return publish.Masked(mask.mask_shapes(spark.createDataFrame(rows, "id int, text string")).drop("text"))


def seen(store):
    return sorted((r.id, r.masked) for r in store.read().collect())


def test_a_batch_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    """Stopped between any two steps and run again: a reader finds the old batch or the new one, never none and never half of one."""
    store = publish.Snapshots(spark, str(tmp_path / "snap"))
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.publish(masked(spark), 0)
    old = seen(store)
    assert old == [(1, "password={{sec:redacted}}"), (2, "plain"), (3, None)]
    new = [(7, "token=abcdefgh12")]

    def stop(*_):
        raise KeyboardInterrupt

    for step, after in (("write", old), ("point", old), ("sweep", [(7, "token={{sec:redacted}}")])):
        with monkeypatch.context() as m:
            m.setattr(publish.Snapshots, step, stop)
            with pytest.raises(KeyboardInterrupt):
                store.publish(masked(spark, new), 1)
        assert seen(store) == after
    assert not store.publish(masked(spark, new), 1)
    assert store.publish(masked(spark, [*new, (8, "x")]), 2)
    assert seen(store) == [(7, "token={{sec:redacted}}"), (8, "x")]
    assert sorted(p.name for p in (tmp_path / "snap").iterdir() if not p.name.startswith(".")) == ["CURRENT", "batch-00000000000000000002"]


def test_rows_past_the_mask_stop_the_write(spark, tmp_path):
    store = publish.Snapshots(spark, str(tmp_path / "snap"))
    store.publish(masked(spark).then(lambda d: d.withColumn("more", F.lit(1))))
    leak = spark.createDataFrame([(9, "password=hunter22abc", 0)], "id int, masked string, hits int")
    for step in (lambda d: d.unionByName(leak), lambda d: d.where("id = 1")):
        with pytest.raises(publish.UnmaskedRows):
            store.publish(masked(spark).then(step), 1)
        assert [r[0] for r in seen(store)] == [1, 2, 3]
        assert not (tmp_path / "snap" / "batch-00000000000000000001").exists()


def test_a_stream_publishes_its_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(i, "token=abcdefgh12")], "id int, text string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = publish.publish_stream(source, lambda d: mask.mask_shapes(d).drop("text"), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    store = publish.Snapshots(spark, str(tmp_path / "out"))
    assert store.current() == "batch-00000000000000000002"
    assert [r.masked for r in store.read().collect()] == ["token={{sec:redacted}}"]


def test_interval_joins_equal_brute_force(spark):
    rng = random.Random(5)
    spans = [(rng.randrange(3), a, a + rng.randint(0, 30)) for a in (rng.randrange(400) for _ in range(200))] + [(None, 1, 2), (1, None, 3), (1, 4, None)]
    regions = [(rng.randrange(3), a, a + rng.choice([0, 1, 5, 90, 300])) for a in (rng.randrange(400) for _ in range(25))] + [(None, 0, 99), (1, None, 3)]
    left = spark.createDataFrame([(*s, "b") for s in spans], "doc long, start int, end int, bucket string")
    right = spark.createDataFrame(regions, "doc long, start int, end int")
    for inside in (False, True):
        def meet(s, r):
            if None in s or None in r or s[0] != r[0]:
                return False
            return s[1] > r[1] and s[2] <= r[2] and s[2] > s[1] if inside else s[1] < r[2] and r[1] < s[2]

        for size in (8, 1024):
            got = intervals.overlapping(left, right, ["doc"], size, inside)
            assert sorted((r.doc, r.start, r.end, r.other_start, r.other_end) for r in got.collect()) == sorted((*s, *r[1:]) for s in spans for r in regions if meet(s, r))
            assert {r.bucket for r in got.collect()} == {"b"}
            kept = intervals.excluded(left, right, ["doc"], size, inside)
            assert sorted(map(str, ((r.doc, r.start, r.end) for r in kept.collect()))) == sorted(str(s) for s in spans if not any(meet(s, r) for r in regions))


def test_a_document_with_very_many_spans(spark):
    spans = spark.range(100_000).select(F.lit(1).alias("doc"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("end"))
    regions = spark.range(1000).select(F.lit(1).alias("doc"), (F.col("id") * 1000).alias("start"), (F.col("id") * 1000 + 95).alias("end"))
    assert intervals.excluded(spans, regions, ["doc"]).count() == 90_000


def test_many_values_of_one_base_and_a_name_asked_for_twice(spark):
    new = spark.range(100_000).select(F.lit("s").alias("id"), F.lit("key").alias("base"), (F.col("id") + 1).cast("int").alias("rank"))
    taken = spark.range(2, 50_000, 2).select(F.lit("s").alias("id"), F.concat(F.lit("key-"), "id").alias("name"))
    names = naming.numbered(new, ["id"], taken)
    assert names.count() == names.select("name").distinct().count() == 100_000
    assert names.join(taken, "name", "left_semi").isEmpty()
    assert names.where("name in ('key', 'key-3', 'key-49999', 'key-124999')").count() == 4
    found = spark.createDataFrame([(1, 0, 5, "v1", "key"), (1, 9, 14, "v2", "key"), (1, 20, 25, "v1", "key")], "id int, start int, end int, value string, hint string")
    texts = spark.createDataFrame([(1, "x" * 30)], "id int, text string")
    stale = spark.createDataFrame([(1, "old", "v1"), (1, "old", "v2")], "id int, name string, value string")
    assert [r.name for r in naming.suggest_names(found, texts, ["id"], taken=stale).orderBy("start").collect()] == ["old", "key", "old"]
