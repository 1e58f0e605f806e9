"""Conversations as they go out, and the vault of a session in a stream."""

import hashlib
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from veilmark.operators import context
from veilmark.operators import vault as V
from veilmark.streaming import session, stream

TURN = "conv_id long, turn long, text string"


def lists(rows, changes):
    """The list that each request sends, by looking at the vault turn by turn."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((t, text) for c, t, text in rows if c == conv)
        for request, _ in own:
            held = {}
            for _, _, name, value in sorted((t, c, n, v or "") for c, t, n, v in changes if c == conv and t <= request):
                held[name] = value
            for t, text in own:
                if t <= request:
                    for name, value in sorted(held.items(), key=lambda x: -len(x[1])):
                        text = text.replace(value, f"{{{{sec:{name}}}}}") if value and text else text
                    out[(conv, request, t)] = text
    return out


def test_each_request_masks_what_is_known_then(spark):
    rng = random.Random(1)
    words = [f"value-{i}-{hashlib.sha256(str(i).encode()).hexdigest()[:9]}" for i in range(6)]
    rows = [(c, t, " ".join(rng.choice([*words, "plain", "text"]) for _ in range(6)) if rng.random() < 0.9 else None) for c in range(12) for t in range(rng.randint(1, 8))]
    changes = [(c, rng.randint(0, 7), f"n{i}", w if rng.random() < 0.8 else None) for c in range(12) for i, w in enumerate(words) for _ in range(rng.randint(0, 2))]
    changes = list({(c, t, n): (c, t, n, v) for c, t, n, v in changes}.values())
    messages = spark.createDataFrame(rows, TURN).withColumn("forms", F.lit("mine"))
    versions = context.vault_versions(spark.createDataFrame(changes, "conv_id long, turn long, name string, value string"))
    out = context.outgoing(messages, versions)
    requests = messages.select("conv_id", F.col("turn").alias("request"))
    got = {(r.conv_id, r.request, r.turn): r.masked for r in context.sent(requests, out).collect()}
    assert got == lists(rows, changes)
    assert {r.forms for r in out.collect()} == {"mine"}
    each = [(r.conv_id, r.turn, r.sent_from) for r in out.collect()]
    assert len(each) == len(set(each))


def test_a_value_met_in_turn_three_is_masked_from_there_on(spark):
    rows = [(1, 0, "try Zk9-hidden-x1 now"), (1, 1, "well"), (1, 3, "token=Zk9-hidden-x1"), (1, 4, "again Zk9-hidden-x1"), (2, 0, "Zk9-hidden-x1")]
    messages = spark.createDataFrame(rows, TURN)
    out = context.outgoing(messages, context.vault_versions(context.met_values(messages)))
    got = {(r.conv_id, r.turn, r.sent_from, r.sent_to): (r.masked, r.hits) for r in out.collect()}
    assert got == {
        (1, 0, 0, 3): ("try Zk9-hidden-x1 now", 0),
        (1, 0, 3, None): ("try {{sec:token}} now", 1),
        (1, 1, 1, None): ("well", 0),
        (1, 3, 3, None): ("token={{sec:token}}", 1),
        (1, 4, 4, None): ("again {{sec:token}}", 1),
        (2, 0, 0, None): ("Zk9-hidden-x1", 0),
    }


@pytest.fixture
def keyed(spark):
    key, value = session.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    yield spark
    spark.conf.set(key, before)


EVENT = "session_id string, seq long, text string, ended boolean, reason string"


def run(spark, tmp_path, batches, **options):
    """What the stream gives for ``batches`` of rows, one trigger each, and the names it leaves in order."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.json(str(folder / f"b{i}"))
        time.sleep(0.01)
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(folder / "*"))
    found = session.session_stream(source, **options)
    q = found.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.session_id, r.name, r.digest) for r in spark.read.schema(session.OUTPUT).parquet(str(out)).collect())


def digest(value):
    return hashlib.sha256(value.encode()).hexdigest()


def test_stream_equals_batch_adoption(keyed, tmp_path):
    spark, rng = keyed, random.Random(2)
    rows = [(rng.choice("abc"), i, f"token=aaaa{rng.randint(0, 60)}bbbb and password: zz{rng.randint(0, 9)}zzzzzz", False, None) for i in range(60)]
    stored = spark.createDataFrame([("a", "token", "aaaa1bbbb", "output", 1), ("a", "token-3", "other-value", "prompt", 2), ("b", "first", "aaaa2bbbb", "prompt", 1), ("b", "second", "aaaa2bbbb", "output", 2)], "session_id string, name string, value string, source string, seq long")
    got = run(spark, tmp_path, [rows[:20], rows[20:45], rows[45:]], stored=stored, cap=9)
    batch = spark.createDataFrame(rows, EVENT)
    hits = batch.select("session_id", "seq", F.explode(stream.shape_hits(F.col("text"))).alias("h")).select("session_id", "seq", "h.start", "h.value", "h.kind", "h.hint")
    named = V.adopt(hits, stored, 9).where("name is not null").join(stored.select("session_id", "value"), ["session_id", "value"], "left_anti")
    want = sorted((r.session_id, r.name, digest(r.value)) for r in named.collect())
    assert got == want
    assert len(want) == 3 * 9 - 2


def test_end_wipes_and_reload_keeps(keyed, tmp_path):
    one, two = ("token=valuenumber1", digest("valuenumber1")), ("token=valuenumber2", digest("valuenumber2"))
    batches = [
        [("kept", 1, one[0], True, "reload"), ("gone", 1, one[0], True, "quit"), ("plain", 1, one[0], None, None)],
        [("kept", 2, two[0], False, None), ("gone", 2, two[0], False, None), ("plain", 2, one[0], None, None), ("both", 3, one[0], False, None), ("both", 2, two[0], True, None), ("both", 1, one[0], False, None)],
    ]
    assert run(keyed, tmp_path, batches, end_col="ended", reason_col="reason") == sorted([
        ("kept", "token", one[1]), ("kept", "token-2", two[1]),
        ("gone", "token", one[1]), ("gone", "token", two[1]),
        ("plain", "token", one[1]),
        ("both", "token", one[1]), ("both", "token-2", two[1]), ("both", "token", one[1]),
    ])


class Entries(dict):
    """A map state, or with the key None a value state, in memory."""

    def containsKey(self, key):
        return key in self

    def updateValue(self, key, value):
        self[key] = value

    def exists(self):
        return None in self

    def get(self):
        return self[None]

    def update(self, value):
        self[None] = value


class Handle:
    def __init__(self):
        self.states, self.timers, self.now = {}, [], 0
        self.getMapState = self.getValueState = lambda name, *_: self.states.setdefault(name, Entries())
        self.listTimers, self.deleteTimer, self.registerTimer = (lambda: iter(self.timers)), self.timers.remove, self.timers.append
        self.getCurrentProcessingTimeInMs = lambda: self.now


def test_a_timer_wipes_a_silent_session():
    handle = Handle()
    vault = session.SessionVault(idle_ms=100)
    vault.init(handle)
    rows = [pd.DataFrame([(2, 0, "d1", "token"), (1, 0, "d2", "token")], columns=["seq", "start", "digest", "base"])]
    named = lambda: [tuple(r) for out in vault.handleInputRows(("s",), iter(rows), handle) for r in out.itertuples(index=False)]
    assert named() == [("s", "d2", "token"), ("s", "d1", "token-2")]
    handle.now = 60
    assert named() == []
    assert handle.timers == [160]
    assert [len(out) for out in vault.handleExpiredTimer(("s",), handle, None)] == [0]
    assert not any(handle.states.values())
    assert len(named()) == 2
