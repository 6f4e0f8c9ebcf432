"""Sources, sinks and streams by round trip."""

import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshelf.sources import files, sinks, web
from lakeshelf.streaming import inbox


def test_audio_scan_skips_hidden_and_other_files(spark, tmp_path):
    for name in ("a/x.mp3", "a/y.txt", "a/.h/z.mp3", "logs/q.flac", "b/w.FLAC"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"1")
    found = [r["path"].rsplit("/", 2)[-2:] for r in files.audio_files(spark, str(tmp_path)).collect()]
    assert found == [["a", "x.mp3"], ["b", "w.FLAC"]]


def test_tolerant_columns(spark):
    schema = T.StructType([T.StructField("filepath", T.StringType()), T.StructField("bpm", T.DoubleType())])
    got = files.tolerant(spark.createDataFrame([("p",)], "path string"), schema, {"filepath": "path"})
    assert [tuple(r) for r in got.collect()] == [("p", None)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert sorted(r["a"] for r in files.json_lines(spark, str(tmp_path / "q.jsonl"), schema).collect()) == [1, 2]
    (tmp_path / "s.json").write_text(json.dumps({"items": {"7": {"status": "ok"}}}))
    assert [tuple(r) for r in files.json_items(spark, str(tmp_path / "s.json"), "status STRING").collect()] == [("7", "ok")]


def test_path_values_at_any_depth(spark):
    rows = spark.createDataFrame([(json.dumps({"a": [{"filepath": "x"}], "filepath": "y"}),)], "j string")
    got = {(r["value"], r["location"]) for r in files.path_values(rows, "j", ["filepath"]).collect()}
    assert got == {("x", "$.a[0].filepath"), ("y", "$.filepath")}


def test_path_values_in_deep_nesting(spark):
    deep = {"filepath": "z"}
    for _ in range(12):
        deep = {"a": [deep]}
    rows = spark.createDataFrame([(json.dumps(deep),), ("no json",), (None,)], "j string")
    assert [(r["value"], r["location"]) for r in files.path_values(rows, "j", ["filepath"]).collect()] == [("z", "$" + ".a[0]" * 12 + ".filepath")]


def test_probe(spark):
    doc = json.dumps({"streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "mp3", "bit_rate": "320000"}], "format": {"bit_rate": "1"}})
    assert tuple(spark.createDataFrame([(doc,)], "j string").select(files.probe(F.col("j")).alias("p")).first()["p"]) == ("mp3", 320)


def test_anchors_are_distinct(spark):
    page = spark.createDataFrame([(1, '<a href="/label/x/12">X</a><a href="/label/x/12">again</a><a href="/o">o</a>')], "page_id long, html string")
    assert [(r["url"], r["number"]) for r in web.anchors(page).collect()] == [("/label/x/12", 12)]


def test_playlist_sink_keeps_order(spark, tmp_path):
    rows = spark.createDataFrame([("p", k, f"/f{k}", "a", "t", 10.0) for k in (3, 1, 2)], "playlist string, position int, filepath string, artist string, title string, duration_sec double")
    sinks.playlists(rows, str(tmp_path / "m3u"))
    lines = "".join(p.read_text() for p in (tmp_path / "m3u" / "playlist=p").glob("part-*")).splitlines()
    assert lines[0] == "#EXTM3U" and [x for x in lines if x.startswith("/")] == ["/f1", "/f2", "/f3"]


def test_csv_xml_and_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, ["x", "y"])], "id long, tags array<string>")
    sinks.csv(rows, str(tmp_path / "c"), ["id", "tags"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["tags"] == "x | y"
    t = spark.createDataFrame([(1, "t", "a", "g", 120.0, "8A", 61.0, "/f")], "id long, title string, artist string, genre string, bpm double, key_camelot string, duration_sec double, filepath string")
    sinks.collection_xml(t, str(tmp_path / "x"))
    assert 'AverageBpm="120.00"' in "".join(p.read_text() for p in (tmp_path / "x").glob("part-*"))
    changed = sinks.tag_changes(t, t.withColumn("genre", F.lit(None).cast("string")), "id", ["title", "genre"])
    assert [tuple(r) for r in changed.collect()] == [(1, "genre", "g", None)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(k, k % 2, "2026-01-01 00:00:%02d" % (k * 3)) for k in range(10)], "id long, folder long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = inbox.events(spark, str(tmp_path / "in"), rows.schema)
    inbox.run_once(inbox.counts_per(stream, "ts", "folder"), str(tmp_path / "out"), str(tmp_path / "cp"), "append").awaitTermination()
    seen = inbox.first_seen(inbox.events(spark, str(tmp_path / "in"), rows.schema), ["folder"], "ts")
    inbox.run_once(seen, str(tmp_path / "first"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "first")).count() == 2
