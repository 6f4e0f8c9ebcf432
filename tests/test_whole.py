"""Files that appear whole or not at all; their queries are held against SQL with all others."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lakeshelf.sources import whole


def test_a_document_is_one_json_object(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k} \"é\"", None if k % 2 else [k]) for k in range(500)], "id long, name string, more array<long>").repartition(7)
    path = str(tmp_path / "doc.json")
    for n in (500, 3, 0):  # a shorter one replaces it as a whole
        whole.json_document(rows.where(f"id < {n}"), "id", path)
        with open(path, encoding="utf-8") as file:
            found = json.load(file)
        assert list(found) == [str(k) for k in range(n)] and all(found[str(k)] == ({"name": f"v{k} \"é\""} | ({} if k % 2 else {"more": [k]})) for k in range(n))
    assert [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["doc.json"]


def test_a_failure_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "a.txt")
    whole.whole_file(spark.createDataFrame([("old",)], "value string"), path, foot="\n")
    with pytest.raises(Exception, match="bad"):
        whole.whole_file(spark.range(10).select(F.when(F.col("id") == 9, F.raise_error(F.lit("bad")).cast("string")).otherwise("x").alias("value")), path)
    with open(path) as file:
        assert file.read() == "old\n"
    assert [x for x in os.listdir(tmp_path) if not x.endswith(".crc")] == ["a.txt"]


def test_playlist(spark, tmp_path):
    rows = [(2, "/lib/b.mp3", None, "", None), (1, "/lib/a.mp3", "Ann", "Night", 61.9), (3, "/lib/c", "", None, 0.0)]
    path = str(tmp_path / "x.m3u")
    whole.playlist(spark.createDataFrame(rows, "position int, filepath string, artist string, title string, duration_sec double"), path)
    with open(path) as file:
        assert file.read() == "#EXTM3U\n#EXTINF:61,Ann - Night\n/lib/a.mp3\n#EXTINF:-1,Unknown - b\n/lib/b.mp3\n#EXTINF:-1,Unknown - c\n/lib/c\n"


def test_report(spark, tmp_path):
    path, rows = str(tmp_path / "r.txt"), spark.createDataFrame([("b",), ("a",)], "value string")
    whole.report([("ONE", rows), ("TWO", rows.where("false"))], path, "T")
    with open(path) as file:
        assert file.read().split("\n") == ["=" * 70, "T", "=" * 70, "", "ONE", "-" * 70, "  a", "  b", "", "TWO", "-" * 70, ""]


def test_pages(spark):
    rows = spark.range(1001).repartition(5)
    got = whole.paged(rows, ["id"], 100).collect()
    assert all((r["page"], r["line"]) == (r["id"] // 100 + 1, r["id"] % 100 + 1) for r in got) and len(got) == 1001
    assert whole.paged(rows.where("false"), ["id"], 100).count() == 0
