"""Sources and streams."""

import json

from pyspark.sql import functions as F

from leafloom.operators import records as O
from leafloom.sources import files, paged
from leafloom.streaming import messages


def test_text_sources(spark, tmp_path):
    (tmp_path / "kv").write_text("a=b=c\nnone\n k = v \n")
    assert sorted(tuple(r) for r in files.key_values(spark, str(tmp_path / "kv")).collect()) == [("a", "b=c"), ("k", "v")]
    (tmp_path / "allow").write_text("# all\nX # why\n\nX\n Y \n")
    assert sorted(r.engine for r in files.allowed(spark, str(tmp_path / "allow")).collect()) == ["X", "Y"]


def test_frames(spark, tmp_path):
    one = files.framed(b'{"id": "1", "action": "ping"}') + files.framed(b'{"payload": {"x": 1}}') + files.framed(b"not json")
    (tmp_path / "a.bin").write_bytes(one)
    (tmp_path / "b.bin").write_bytes(files.framed(b"{}") + b"\xff\xff\xff\xff")
    (tmp_path / "c.bin").write_bytes(b"\x09\0\0\0abc")
    (tmp_path / "d.bin").write_bytes(b"")
    rows = files.frames(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    got = sorted((r.path[-5], r.seq, r.error is None) for r in rows.collect())
    assert got == [("a", 0, True), ("a", 1, True), ("a", 2, True), ("b", 0, True), ("b", 1, False), ("c", 0, False)]
    asked = {r.seq: r for r in files.requests(rows.filter("path like '%a.bin'")).collect()}
    assert (asked[0].id, asked[0].action, asked[0].ok) == ("1", "ping", True)
    assert (asked[1].id, asked[1].ok, asked[1].payload) == ("", False, '{"x":1}') and not asked[2].ok


def test_paged_source(spark, tmp_path):
    rows = [{"rule": f"r{i}", "n": i} for i in range(25)]
    for p in range(3):
        (tmp_path / f"p{p + 1}.json").write_text(json.dumps({"total": 25, "rows": rows[p * 10 : p * 10 + 10]}))
    paged.register(spark)
    read = lambda **o: spark.read.format("paged_json").schema("rule string, n int, gone string").options(url=f"file://{tmp_path}/p{{page}}.json", size="10", **o).load()
    df = read()
    assert df.rdd.getNumPartitions() == 3 and sorted(r.n for r in df.collect()) == list(range(25)) and df.first().gone is None
    assert sorted(r.n for r in read(most="12").collect()) == list(range(12))


def test_chunk_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "id string, chunk_index int, chunk_count int, data string"
    parts = messages.framed(spark.createDataFrame([("m", "x" * 300), ("n", "y" * 200), ("open", "z" * 300)], "id string, body string"), whole=0, chunk=100).collect()
    first = [r for r in parts if r.chunk_index % 2] + [next(r for r in parts if r.id == "m" and r.chunk_index == 1)]
    second = [r for r in parts if not r.chunk_index % 2 and (r.id != "open" or r.chunk_index)] + [("bad", 7, 2, "x")]
    source = tmp_path / "in"
    for k, rows in enumerate((first, second)):
        spark.createDataFrame([tuple(r) for r in rows], schema).coalesce(1).write.mode("append").json(str(source / f"b={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    out = messages.assembling(stream.select("id", "chunk_index", "chunk_count", "data"))
    q = out.writeStream.format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.body for r in spark.table("whole").collect()} == {"m": "x" * 300, "n": "y" * 200}


def test_latency_stream(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT timestamp'2024-01-01 00:50:00', 'a', 3.0D UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'b', 5.0D")
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    q = messages.latency(stream).writeStream.format("memory").queryName("lat").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.mean_value) for r in spark.table("lat").collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_numbers_of_texts_and_documents(spark):
    assert spark.range(1).select(O.first_number(F.lit("x"), F.lit(None).cast("string"), F.lit("12"))).first()[0] == 12
    issues = spark.createDataFrame([(1, "r", "p:a.cs", "MAJOR", None, "m", 3, None, None, None), (2, None, "p:b.cs", None, None, None, None, None, None, None), (3, "r", "p:dir/", None, None, None, None, None, None, None), (4, "s", "p:c.cs", None, [("low",)], "", None, (2, 2, 5, 1), "h", None)], f"seq int, {O.ISSUE}")
    out = O.sarif_results(issues, "p").orderBy("seq").collect()
    assert [(r.rule_id, r.rule_index, r.level, r.message, r.uri) for r in out] == [("r", 0, "warning", "m", "a.cs"), ("s", 1, "note", "s", "c.cs")]
    assert out[0].region.startLine == 3 and out[1].region.startColumn == 6 and out[1].region.endColumn is None
    assert '"ruleId":"r"' in O.sarif_document(O.sarif_results(issues, "p")).first().sarif
