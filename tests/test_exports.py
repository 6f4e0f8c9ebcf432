"""Genres of a controlled set and what an export takes, by literal cases; their queries are held against SQL with all others."""

import pytest
from pyspark.sql import functions as F

from lakeshelf.operators import exports

CASES = {
    "Afro House": "Afro House", "afro-house": "Afro House", "Deep House Classic": "Deep House", "Afro Gospel House": "Afro House", "House Reprise": "Deep House", "Gospel House": "Soulful House", "Gospel": "Other",
    "Progressive Afro House": "Afro House", "Progressive House Afro House": "Progressive House", "Melodic House; Other": "Melodic House", "hard_techno": "Techno", "Old School Hip-Hop": "Hip Hop", "Contemporary R&B": "R&B", "R&B Classics": "R&B",
    "Nu-Disco": "Nu Disco", "Jazz": "Other", "beatport": "", "8A": "", "x": "", "": "", None: "",
}


def test_canonical_genres(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(CASES)], "k int, genre string")
    assert [r["x"] for r in rows.select("k", exports.canonical_genre(F.col("genre")).alias("x")).orderBy("k").collect()] == list(CASES.values())


def test_another_set(spark):
    known = exports.Genres(aliases=(("polka", "Folk"),), phrases=(("jazz", "Jazz"),), modifiers=("hot",))
    rows = spark.createDataFrame([("Hot Polka",), ("Free Jazz",), ("House",)], "genre string")
    assert [r["x"] for r in rows.select(exports.canonical_genre(F.col("genre"), known).alias("x")).collect()] == ["Folk", "Jazz", "Other"]


def test_phrases_are_no_case_each(spark):
    rows = spark.createDataFrame([("House",)], "genre string").select(exports.canonical_genre(F.col("genre")))
    assert rows._jdf.queryExecution().optimizedPlan().toString().upper().count("CASE WHEN") < 10


def test_located(spark):
    tracks = spark.createDataFrame([(1, "/a/x.mp3"), (2, "/a/Y.mp3"), (3, "/a/z.mp3"), (4, None)], "id long, filepath string")
    files = spark.createDataFrame([("/a/x.mp3",), ("/a/x.mp3",), ("/c/y.MP3",), ("/b/y.mp3",), (None,)], "filepath string")
    got = {r["id"]: (r["place"], r["found"]) for r in exports.located(tracks, files).collect()}
    assert got == {1: ("/a/x.mp3", "ok"), 2: ("/b/y.mp3", "recovered"), 3: (None, "unresolved"), 4: (None, "unresolved")}


@pytest.mark.parametrize(
    ("row", "found", "artist", "title", "reasons"),
    [
        (("/a/Ann - Night.mp3", None, "", 120.0, "8a", "House"), "ok", "Ann", "Night", []),
        (("/a/Ann - Night.mp3", "VA", "Day", 120.0, "8A", "House"), "ok", "Ann", "Day", []),
        (("/a/night.mp3", "va", "", 300.0, "8A", "beatport"), "ok", "va", "", ["[MISSING_METADATA] missing title (filename fallback failed)", "[MISSING_METADATA] missing/unknown artist: 'va' (filename fallback failed)", "[BAD_PATH] BPM out of range: 300.0", "[MISSING_METADATA] junk/missing genre: 'beatport'"]),
        (("/a/night.mp3", "Ann", "Day", None, "13A", None), "ok", "Ann", "Day", ["[MISSING_ANALYSIS] missing BPM", "[MISSING_ANALYSIS] missing/invalid Camelot key: '13A'", "[MISSING_ANALYSIS] junk/missing genre: ''"]),
        (("/z/none.mp3", "Ann", "Day", 120.0, "8A", "House"), "unresolved", "Ann", "Day", ["[STALE_DB] file not found"]),
        (("/a/Unknown (1).mp3", "Ann", "Day", 120.0, "8A", "House"), "junk", "Ann", "Day", ["[JUNK_PLACEHOLDER] filename matches known junk pattern"]),
    ],
)
def test_resolved(spark, row, found, artist, title, reasons):
    tracks = spark.createDataFrame([(1, *row)], "id long, filepath string, artist string, title string, bpm double, key_camelot string, genre string")
    files = spark.createDataFrame([("/a/Ann - Night.mp3",), ("/a/night.mp3",), ("/a/Unknown (1).mp3",)], "filepath string")
    r = exports.resolved(tracks, files).first()
    assert (r["found"], r["artist"], r["title"], r["reasons"]) == (found, artist, title, reasons)
