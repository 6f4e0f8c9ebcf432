"""Record labels by literal cases; their queries are held against SQL with all others."""

from pyspark.sql import functions as F

from lakeshelf.functions import text
from lakeshelf.operators import labels
from lakeshelf.plans import registry

FIELDS = "id long, filepath string, organization string, grouping string, comment string, albumartist string, album string"


def texts(spark, values, column):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in rows.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_junk_reasons(spark):
    cases = {
        "Defected": None, "8A -": "Camelot/musical key", "https://x": "URL or domain prefix", "pool.net": "domain name", "The DJCity Pool": "source junk ('djcity')", "[ ]": "empty after normalization", "(x)": "single character",
        "[ VA ]": "exact junk value", "Deep -- House": "genre word", "ABC001": "junk pattern", "A001": "junk pattern", "000": "junk pattern", "!?#": "empty after normalization", "##": "junk pattern", "Ærø": None, " ": "empty", "": "empty", None: "empty",
    }
    cases["!?#"] = "single character"  # only the sign # is left
    assert texts(spark, cases, labels.junk_reason) == list(cases.values())


def test_keys(spark):
    cases = {"Defected Records": "defected", "Defected Recordings!": "defected", "  Sub  Underground ": "sub underground", "Music Factory": "music factory", "Deep Music Group": "deep", "Records": "", "Ann's Label": "ann s", None: ""}
    assert texts(spark, cases, labels.label_key) == list(cases.values())
    assert text.label_key is not labels.label_key


def test_names_in_files(spark):
    cases = {
        "[Toolroom] Ann - Night": ("Toolroom", 0.7), "(Sub) Ann - Night": ("Sub", 0.7), "Ann - Night (Some Records)": ("Some Records", 0.65), "Ann - Night (Dub Mix)": None, "Label Co__Ann": ("Label Co", 0.6), "Ann - Night [Deep Music]": ("Deep Music", 0.6),
        "[12] Ann - Night": None, "[A] Ann - Night": None, "Ann": None, None: None,
    }
    got = texts(spark, cases, labels.named_in_file)
    assert [x and (x["label"], x["confidence"]) for x in got] == list(cases.values())


def test_the_best_field_decides(spark):
    rows = [
        (1, "/x.mp3", "Defected", "Other", None, None, None), (2, "/x.mp3", "8A", "Toolroom", None, None, None), (3, "/x.mp3", "promo", "va", "Deep", None, None), (4, "/x.mp3", None, None, None, "Ann", "Night Sounds"),
        (5, "/x.mp3", None, None, None, "Ann Music", "Night Sounds"), (6, "/[Sub] Ann - Night.mp3", None, "", None, "Ann", "Night"), (7, "/x.mp3", "000", None, None, "www.x.de", "Night"), (8, None, None, None, None, None, None),
    ]
    got = {r["id"]: (r["label"], r["source"], r["confidence"], r["action"], r["junk_count"], r["writable"]) for r in labels.detected(spark.createDataFrame(rows, FIELDS)).collect()}
    assert got == {
        1: ("Defected", "embedded_tag", 0.95, "kept", 0, True), 2: ("Toolroom", "fallback_tag", 0.75, "filled", 1, False), 3: ("Deep", "fallback_tag", 0.6, "filled", 2, False), 4: ("Night Sounds", "fallback_tag", 0.45, "filled", 0, False),
        5: ("Ann Music", "fallback_tag", 0.5, "filled", 0, False), 6: ("Sub", "filename", 0.7, "filled", 0, False), 7: (None, "unresolved", 0.0, "unresolved", 2, False), 8: (None, "unresolved", 0.0, "unresolved", 0, False),
    }


def test_one_spelling_for_the_corpus(spark):
    names = ["DEFECTED RECORDINGS", "Defected", "defected records", "Defected Records", "DEEP", "Records", "DEEP MUSIC"]
    found = labels.detected(spark.createDataFrame([(k, "/x.mp3", v, None, None, None, None) for k, v in enumerate(names)], FIELDS))
    got = [r["canonical"] for r in labels.with_canonical(found).orderBy("id").collect()]
    assert got == ["defected records"] * 4 + ["DEEP MUSIC", "Records", "DEEP MUSIC"]
    assert {r["key"]: r["n_spellings"] for r in labels.spellings(found).collect()} == {"defected": 4, "deep": 2}
    assert labels.label_summary(found.where("id < 0")).first()["total"] == 0


def test_labels_are_counted_in_one_pass(spark):
    """Rules run once a row for the counts and once for each use of the rows, however results are filtered."""
    for name, uses in (("top_labels", 1), ("detected_labels", 2), ("label_summary", 1)):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("source junk (") == uses, name
    names = ["Deep", "DEEP MUSIC", "Deep Music", "Records", "Music", "Music", "va", None]
    found = labels.detected(spark.createDataFrame([(k, "/x.mp3", v, None, None, None, None) for k, v in enumerate(names)], FIELDS))
    assert [tuple(r) for r in labels.top_labels(found, 3).collect()] == [("Deep Music", 3), ("Music", 2), ("Records", 1)]
    track = spark.createDataFrame([(1, "/x.mp3", "Defected", "Other", "a", "b", "c")], FIELDS)
    plan = labels.detected(track).where("writable AND label <> 'x' AND key <> ''")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("source junk (") == 1
