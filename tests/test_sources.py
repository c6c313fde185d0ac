import hashlib
import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from waymark.operators.digests import ordered_digest
from waymark.sources import jsonl, models
from waymark.sources.arrays import array_elements
from waymark.streaming.online import crossings


def test_round_trip_and_guards(spark, tmp_path):
    path = str(tmp_path / "out")
    jsonl.write_jsonl(spark.createDataFrame([(1, "ü", None)], "b int, a string, c string"), path)
    assert jsonl.read_jsonl(spark, path, "a string, b int, c string").collect()[0].asDict() == {"a": "ü", "b": 1, "c": None}
    with pytest.raises(Exception, match="exist"):
        jsonl.write_jsonl(spark.range(1), path)
    with pytest.raises(FileExistsError):
        jsonl.guard_outputs(path)
    with pytest.raises(FileExistsError):
        jsonl.guard_stored(spark, path)
    jsonl.guard_stored(spark, path + "-new")
    jsonl.append_log(spark.createDataFrame([(2, "x", "y")], "b int, a string, c string"), path)
    assert jsonl.read_jsonl(spark, path, "b int").count() == 2


def test_strict_and_lenient(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n')
    path = str(tmp_path / "x.jsonl")
    assert jsonl.read_jsonl(spark, path, "a int", strict=False).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, path, "a int").collect()


def test_tree_scan_and_harvest(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_text(json.dumps({"x": [{"question": "q1", "deep": {"question": "q2"}}], "question": {"question": "q3"}}))
    (tmp_path / "b.jsonl").write_text('{"question": "q4"}\nbroken\n{"question": "lost"}\n')
    (tmp_path / "c.txt").write_text('{"question": "no"}')
    got = {r.question for r in jsonl.harvest_key(jsonl.scan_json_tree(spark, str(tmp_path))).collect()}
    assert got == {"q1", "q2", "q3", "q4"}
    digest = jsonl.tree_digest(spark, str(tmp_path))
    (tmp_path / "c.txt").write_text("other")
    assert digest != jsonl.tree_digest(spark, str(tmp_path))


def test_tree_scan_in_splits(spark, tmp_path):
    lines = [json.dumps({"question": f"q{k}", "pad": "x" * 40}) for k in range(200)]
    (tmp_path / "whole.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "cut.jsonl").write_text("\n".join([*lines[:120], "{broken", *lines[120:160], "{again", *lines[160:]]) + "\n")
    (tmp_path / "bytes.jsonl").write_bytes(b'{"question": "\xff"}\x0c{"question": "second"}\n')
    (tmp_path / "bad.json").write_text("{")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = [(r.path.rsplit("/", 1)[1], r.question) for r in jsonl.harvest_key(jsonl.scan_json_tree(spark, str(tmp_path))).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [("whole.jsonl", f"q{k}") for k in range(200)] + [("cut.jsonl", f"q{k}") for k in range(120)]
    assert sorted(got) == sorted(want)


def test_keys_sorted_at_every_depth(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.sql("SELECT named_struct('z', 1, 'a', array(named_struct('y', 2, 'b', 3), NULL)) AS s, map('k', 1, 'c', 2) AS m, CAST(NULL AS STRUCT<q: INT, p: INT>) AS n")
    jsonl.write_jsonl(df, path)
    assert [r.value for r in spark.read.text(path).collect()] == ['{"m":{"c":2,"k":1},"n":null,"s":{"a":[{"b":3,"y":2},null],"z":1}}']


def test_verified_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"_id": "1"}, {"_id": "2"}]')
    digest = jsonl.file_digests(spark, str(path)).first()["sha256"]
    assert jsonl.read_json_array(spark, str(path), "_id string", digest, 2).count() == 2
    with pytest.raises(ValueError, match="digest"):
        jsonl.read_json_array(spark, str(path), "_id string", "0" * 64)
    with pytest.raises(ValueError, match="rows"):
        jsonl.read_json_array(spark, str(path), "_id string", digest, 3)


def test_lines_end_where_the_reference_ends_them(spark, tmp_path):
    odd = "a\u2028b\u0085c\x1dd\u2029"
    (tmp_path / "sep.jsonl").write_text(json.dumps({"question": odd}, ensure_ascii=False) + "\r\n" + json.dumps({"question": "next"}) + "\r\u2003\n[1]", "utf-8")
    (tmp_path / "bad.jsonl").write_bytes(b'{"question": "kept"}\n{"question": "\xff"}\n{"question": "lost"}\n')
    (tmp_path / "bad.json").write_bytes(b'{"question": "\xff"}')
    rows = jsonl.scan_json_tree(spark, str(tmp_path)).collect()
    got = sorted((r.path.rsplit("/", 1)[1], json.loads(r.value)["question"]) for r in rows if r.value != "[1]")
    assert got == [("bad.jsonl", "kept"), ("sep.jsonl", odd), ("sep.jsonl", "next")] and len(rows) == 4


def test_strict_lines_are_objects(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n  {"a": 2}\n')
    assert [r.a for r in jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()] == [1, 2]
    for bad in ('[{"a": 1}, {"a": 2}]', "[]", "3", '"x"', '{"a": 1', "null"):
        (tmp_path / "x.jsonl").write_text('{"a": 1}\n' + bad + "\n")
        with pytest.raises(Exception, match="(?i)malformed"):
            jsonl.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()


def odd_array(n=400):
    bits = ['"', "\\", "{", "}", "[", "]", ",", "\\\"", "ü", "\u2028", "x" * 50, "},{", "\n", "😀"]
    rng = random.Random(3)
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    return [{"_id": str(i), "s": text(), "deep": [{"k": text()}, [text()]], "e": {}} for i in range(n)]


@pytest.mark.parametrize("size", ["300b", "4k", "100m"])
def test_arrays_are_read_in_splits(spark, tmp_path, size):
    values = odd_array()
    for name, options in (("plain", {}), ("tight", {"separators": (",", ":")}), ("wide", {"indent": 2, "ensure_ascii": False})):
        (tmp_path / f"{name}.json").write_text(("\ufeff" if name == "wide" else "") + json.dumps(values, **options) + "\n", "utf-8")
    (tmp_path / "empty.json").write_text("[ \n]")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name in ("plain", "tight", "wide"):
            df = array_elements(spark, str(tmp_path / f"{name}.json"))
            got = sorted((json.loads(r.element) for r in df.collect()), key=lambda v: int(v["_id"]))
            assert got == values
            if size == "300b":
                assert spark.read.option("lineSep", "}").text(str(tmp_path / f"{name}.json")).rdd.getNumPartitions() > 50
        assert array_elements(spark, str(tmp_path / "empty.json")).count() == 0
        rows = jsonl.read_json_array(spark, str(tmp_path / "plain.json"), "_id string, s string", expected_rows=400)
        assert sorted((r._id, r.s) for r in rows.collect()) == sorted((v["_id"], v["s"]) for v in values)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


@pytest.mark.parametrize("text", ["", " ", "{}", '{"a": [1]}', "[1", '["a', "[1]]", "[1] 2", "[1] [2]", "[1,]", "[,1]", "[1,,2]", '"x"', "[{]}", '[{"a": 1}} ', "3"])
def test_what_is_no_array_is_an_error(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        jsonl.read_json_array(spark, str(tmp_path / "x.json"), "a int").collect()


def test_elements_are_objects(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, [2]]')
    with pytest.raises(Exception, match="no object"):
        jsonl.read_json_array(spark, str(tmp_path / "x.json"), "a int").collect()


def test_harvest_goes_as_deep_as_the_text(spark):
    deep = '{"question": ' * 1500 + '"at the bottom"' + "}" * 1500
    wide = json.dumps({"question": "a", "x": [{"question": ["no", {"question": "b"}]}, {"question": None}], "y": {"question": "c"}})
    values = spark.createDataFrame([("deep", deep), ("wide", wide), ("none", "[]"), ("null", None)], "path string, value string")
    got = [(r.path, r.question) for r in jsonl.harvest_key(values).collect()]
    assert sorted(got) == [("deep", "at the bottom"), ("wide", "a"), ("wide", "b"), ("wide", "c")]
    values.createOrReplaceTempView("harvest_values")
    sql = "SELECT path, h.value FROM harvest_values v, LATERAL harvest_strings(v.value, 'question') h WHERE path = 'wide'"
    assert [r.value for r in spark.sql(sql).collect()] == ["a", "b", "c"]


def test_digests_are_streams(spark, tmp_path, monkeypatch):
    (tmp_path / "t/deep er").mkdir(parents=True)
    want = {}
    for name, size in (("t/a.bin", 0), ("t/b.bin", 1), ("t/deep er/c ü%20.bin", 100_000)):
        content = bytes(i * 7 % 251 for i in range(size))
        (tmp_path / name).write_bytes(content)
        want[name.removeprefix("t/")] = hashlib.sha256(content).hexdigest()
    monkeypatch.setattr(jsonl, "READ_BYTES", 4096)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in jsonl.file_digests(spark, str(tmp_path / "t")).collect()}
    assert sorted(b for b, _ in got.values()) == [0, 1, 100_000] and {d for _, d in got.values()} == set(want.values())
    with open(tmp_path / "large", "wb") as f:  # beyond what one cell of a table holds; sparse on disk
        f.truncate((2 << 30) + 5)
    monkeypatch.setattr(jsonl, "READ_BYTES", 8 << 20)
    assert jsonl.file_digests(spark, str(tmp_path / "large")).first().bytes == (2 << 30) + 5


def test_ordered_digests(spark):
    rows = [(g, i, f"id{i}") for g, n in (("a", 1), ("b", 500)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i long, id string").repartition(7)
    got = {r.g: (r.n, r.sha256) for r in ordered_digest(df, "id", ["i"], ["g"]).collect()}
    assert got == {g: (n, hashlib.sha256("\n".join(f"id{i}" for i in range(n)).encode()).hexdigest()) for g, n in (("a", 1), ("b", 500))}
    assert ordered_digest(df.where("false"), "id", ["i"]).count() == 0
    assert ordered_digest(df, "id", ["i", "g"], head="{", join=",", tail="}").first().n == 501
    with pytest.raises(Exception, match="missing"):
        ordered_digest(df.withColumn("id", F.lit(None).cast("string")), "id", ["i"]).collect()


def test_reports_go_where_spark_writes(spark, tmp_path):
    report = {"b": {"x": 1.5, "a": "ü"}, "a": [1, None]}
    for session in (None, spark):
        for name in ("r.json", "r.md"):
            (tmp_path / name).unlink(missing_ok=True)
            (tmp_path / f".{name}.crc").unlink(missing_ok=True)
        jsonl.write_report(report, str(tmp_path / "r.json"), session)
        jsonl.write_markdown(report, str(tmp_path / "r.md"), "T", session)
        assert json.loads((tmp_path / "r.json").read_text("utf-8")) == report
        assert (tmp_path / "r.md").read_text("utf-8") == "# T\n- a: [1, None]\n\n## b\n\n- a: ü\n- x: 1.5\n"
    with pytest.raises(ValueError):
        jsonl.write_report({"x": float("nan")}, str(tmp_path / "r.json"), spark)


def test_named_sources():
    assert jsonl.named_sources(["a=x", "b=y=z"]) == {"a": "x", "b": "y=z"}
    with pytest.raises(ValueError):
        jsonl.named_sources(["a=x", "a=y"])


def test_streamed_crossings(spark, tmp_path):
    src = str(tmp_path / "s")
    spark.sql("select 1L question_id, 1L state_index, 0.9D score, timestamp'2024-01-01' ts union all select 1L, 0L, 0.1D, timestamp'2024-01-01' union all select 1L, 2L, 0.95D, timestamp'2024-01-01'").write.parquet(src)
    stream = spark.readStream.schema("question_id long, state_index long, score double, ts timestamp").parquet(src)
    q = crossings(stream, 0.8).writeStream.outputMode("complete").format("memory").queryName("crossed").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("crossed").collect()] == [(1, 1)]


def test_models_as_sources(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, "boom"), (3, None)], "id int, prompt string")

    def client():
        def ask(prompt):
            if prompt == "boom":
                raise TimeoutError("late")
            return prompt.upper()

        return ask

    got = models.completed(rows, "prompt", client)
    assert sorted((r.id, r.raw, r.error) for r in got.collect()) == [(1, "AB", None), (2, None, "TimeoutError:late"), (3, None, None)]
    assert [r.id for r in models.failed(got).collect()] == [2]
    scored = models.scored(rows.where("prompt is not null"), "prompt", lambda: lambda prompts: [(len(p) / 2, p[::-1]) for p in prompts], batch=1)
    assert sorted((r.id, r.score, r.completion) for r in scored.collect()) == [(1, 1.0, "ba"), (2, 2.0, "moob")]
    with pytest.raises(Exception, match="scores for"):
        models.scored(rows, "prompt", lambda: lambda prompts: []).collect()


def test_chat_client():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            sent = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            body = json.dumps({"choices": [{"message": {"content": sent["messages"][0]["content"] + sent["model"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    assert models.chat_client(f"http://127.0.0.1:{server.server_port}", "-m", 5)("ü") == "ü-m"
    server.shutdown()
