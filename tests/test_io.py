"""Files, streams and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F
from veilmark.operators import refs
from veilmark.plans import catalogue, functions
from veilmark.sources import files
from veilmark.streaming import stream

SF = "/root/testdata/sf0.01"


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.env").write_text("X=1\n")
    (tmp_path / "d" / "b.env").write_text("Y=é\n")
    (tmp_path / "bin").write_bytes(b"a\x00b")
    (tmp_path / "big").write_text("x" * 100)
    rows = files.text_files(spark, str(tmp_path), max_bytes=50).collect()
    assert sorted(r.text for r in rows) == ["X=1\n", "Y=é\n"]
    names = [(r.name, r.folder) for r in files.listing(spark, str(tmp_path)).collect()]
    assert names == [("..", True), ("d", True), ("a.env", False), ("big", False), ("bin", False)]
    assert [r.name for r in files.listing(spark, str(tmp_path), "b").collect()] == ["big", "bin"]
    assert [r.name for r in files.listing(spark, str(tmp_path), ".").collect()] == []


def test_sweep(spark):
    texts = spark.createDataFrame([("a canary-1 b",), (None,), ("clean",)], "text string")
    canaries = spark.createDataFrame([("canary-1",), ("canary-2",)], "canary string")
    assert {(r.canary, r.leaks) for r in files.leak_sweep(texts, canaries).collect()} == {("canary-1", 1), ("canary-2", 0)}
    assert {r.verdict for r in files.leak_sweep(texts, canaries).collect()} == {"hit", "clean"}
    assert {r.verdict for r in files.leak_sweep(texts.limit(0), canaries).collect()} == {"nothing examined"}


def test_receipts_hold_no_value(spark, tmp_path):
    rows = spark.createDataFrame([("s", "n", "topsecretvalue", "prompt")], "session_id string, name string, value string, source string")
    files.append_receipts(rows, str(tmp_path / "r"))
    got = spark.read.parquet(str(tmp_path / "r"))
    assert "value" not in got.columns
    assert not any("topsecret" in str(r) for r in got.collect())


def test_streams(spark, tmp_path):
    batch = spark.createDataFrame([("s", "password=hunter22abc"), ("s", "password=hunter22abc and token: zzzzzzzzz1"), ("t", "none")], "session_id string, text string")
    batch.coalesce(1).write.json(str(tmp_path / "in"))
    source = spark.readStream.schema("session_id string, text string").json(str(tmp_path / "in"))
    for name, df, mode in (("masked_rows", stream.mask_stream(source), "append"), ("adopted_rows", stream.adopt_stream(source), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination()
    masked = {r.masked for r in spark.table("masked_rows").collect()}
    assert masked == {r.masked for r in stream.mask_stream(batch).collect()}
    assert {(r.session_id, r.name) for r in spark.table("adopted_rows").collect()} == {("s", "password"), ("s", "token")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def test_sql_functions(spark):
    functions.register_functions(spark)
    functions.register_functions(spark)
    row = "veil_entropy('abcdefgh'), veil_entropy(''), veil_entropy(NULL), veil_is_digest(repeat('A', 40)), veil_is_digest('x'), veil_is_name('a-1'), veil_is_name('A'), veil_ref('n'), veil_mask_formats(NULL)"
    assert tuple(spark.sql(f"SELECT {row}").first()) == (3.0, 0.0, None, True, False, True, False, "{{sec:n}}", None)
    assert [tuple(r) for r in spark.sql("SELECT * FROM veil_refs('é {{sec:one}}{{sec:two}} {{sec:No}}') ORDER BY start").collect()] == [("one", 2), ("two", 13)]
    assert spark.sql("SELECT * FROM veil_formats(NULL)").isEmpty()
    plan = spark.sql("SELECT f.* FROM VALUES ('x') AS t(text), LATERAL veil_formats(text) f")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_typed_prefix(spark):
    rows = spark.createDataFrame([("use {{sec:ab-",), ("{{sec:",), ("{{sec:a}} ",), ("{{sec:A",), (None,)], "text string")
    got = [r[0] and tuple(r[0]) for r in rows.select(refs.typed_prefix(F.col("text"))).collect()]
    assert got == [("{{sec:ab-", "ab-"), ("{{sec:", ""), None, None, None]
    vault = spark.createDataFrame([("s", "ab-1", "v", "prompt", 0, 1), ("s", "b", "v", "prompt", 0, 2)], "session_id string, name string, value string, source string, added_at long, seq long")
    assert [(r.text, r.names) for r in refs.completions(rows.withColumn("session_id", F.lit("s")), vault, "session_id").orderBy("text").collect() if r.names] == [("use {{sec:ab-", ["ab-1"]), ("{{sec:", ["ab-1", "b"])]


def test_entry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_against_sql(spark, duck, name):
    query, sql = catalogue.QUERIES[name]
    df = query(spark, SF)
    cols = sorted(df.columns)
    near = lambda v: round(v, 6) if isinstance(v, float) else v
    ours = sorted((tuple(near(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(sql)
    theirs = sorted((tuple(near(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=repr)
    assert ours == theirs
