"""Artist credits and repairs by literal cases; their queries are held against SQL with all others."""

import pytest
from pyspark.sql import functions as F

from lakeshelf.functions import artists, parsing, text
from lakeshelf.operators import artists as repairing


def texts(spark, values, column):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in rows.select("k", column(F.col("v")).alias("x")).orderBy("k").collect()]


def test_spelling(spark):
    cases = {
        "MAPHORISA": "Maphorisa", "ACRAZE": "ACRAZE", "DJ LAG M.E. (SA)": "DJ Lag M.E. (SA)", "BLACK COFFEE": "Black Coffee", "&ME": "&ME", "Black COFFEE": "Black COFFEE", "ÉTOILE NOIRE": "Étoile Noire",
        "A feat.Toshi": "A feat. Toshi", "A ft. ft. B": "A feat. B", "A Featuring B": "A feat. B", "Soft Left": "Soft Left", "Ann – ‘Hal’ @ 128 BPM": "Ann - 'Hal'", "Ann [Extended Mix]": "Ann", "  Ann   Lee ": "Ann Lee", "": "", None: None,
    }
    assert texts(spark, cases, artists.normalised) == list(cases.values())
    once = [v for v in cases.values() if v]
    assert texts(spark, once, artists.normalised) == once  # what is normal stays


@pytest.mark.parametrize(
    ("artist", "title", "main", "guest", "separator", "confidence"),
    [
        ("AC Slater, Chris Lorenzo & Fly With Us", "", ["AC Slater", "Chris Lorenzo", "Fly With Us"], "", "nested", 1.0),
        ("Ann, , Bob", None, ["Ann", "Bob"], "", "comma", 1.0),
        ("Ann & Bob x Cy", "", ["Ann", "Bob x Cy"], "", "ampersand", 1.0),
        ("Ann x Bob", "", ["Ann", "Bob"], "", "x", 0.95),
        ("Ann vs. Bob", "", ["Ann", "Bob"], "", "vs", 1.0),
        ("Above and Beyond", "", ["Above", "Beyond"], "", "and", 0.9),
        ("Ann and 8A", "", ["Ann and 8A"], "", "none", 1.0),
        ("Ann feat. feat. Bob", "", ["Ann"], "Bob", "none", 1.0),
        ("Ann feat. Bob", "Song (feat. Bob)", ["Ann feat. Bob"], "", "none", 1.0),
        ("Éx x Ån", "", ["Éx", "Ån"], "", "x", 0.95),
        ("Éxå", "", ["Éxå"], "", "none", 1.0),
        ("Ann,", "", ["Ann"], "", "comma", 1.0),
        (" ", "", [], "", "none", 0.0),
        (None, None, [], "", "none", 0.0),
    ],
)
def test_parts(spark, artist, title, main, guest, separator, confidence):
    rows = spark.createDataFrame([(artist, title, 1)], "artist string, title string, parts int")
    r = artists.with_parts(rows).first()
    assert (r["parsed"]["main"], r["parsed"]["guest"], r["parsed"]["separator"], r["parsed"]["confidence"]) == (main, guest, separator, confidence) and r["parts"] == 1


def test_a_credit_is_one_narrow_plan(spark):
    rows = artists.with_parts(spark.createDataFrame([("a", "b")], "artist string, title string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 25


def test_persons(spark):
    cases = {
        "Mark Francis Aaron K Gray": ("Mark Francis", "Aaron K Gray"), "Mark Francis Adri Block": ("Mark Francis", "Adri Block"), "Keinemusik Aaron K Gray": ("Keinemusik", "Aaron K Gray"),
        "Adri Block Hosh SBCR": None, "Ivy Jones The Band": None, "Ann Lee Bob": None, "Ann Lee Bob Fly Cy Dee Eve": None, "DJ Lag Ann Lee": None, "": None, None: None,
    }
    assert texts(spark, cases, lambda c: F.struct(artists.persons(c)["left"], artists.persons(c)["right"])) == [tuple(v) if v else (None, None) for v in cases.values()]


def test_merge_places(spark):
    cases = {"African RootsLebo": [13], "AfricanGroove": [], "Ann McBee": [], "Some MusiQ": [], "Some MusiQ, Naak": [], "A, RootsLebo": [], "Deep RootsLebo SoulKoki": [10, 19], "": [], None: []}
    assert texts(spark, cases, lambda c: repairing.merge_places(F.coalesce(c, F.lit("")))) == list(cases.values())


def test_repairs(spark):
    known = repairing.known_artists(spark.createDataFrame([("African Roots",), ("Lebo",), (None,), ("X",)], "name string"), spark.createDataFrame([("Ann Lee / Koki-Mo feat. Zed",)], "artist string"))
    assert {r["key"] for r in known.collect()} == {"african roots", "lebo", "ann lee", "koki-mo", "kokimo", "zed"}
    rows = [(1, "African RootsLebo"), (2, "African RootsBob (IT)"), (3, "Ann Lee/KokiMo"), (4, "Ann Lee | Bob"), (5, "AC/DC"), (6, "Ab/Cde"), (7, "Some SoleOther Way"), (8, None), (9, "Plain"), (10, "Deep AfricanRoots SoulLebo/Lebo")]
    got = {r["id"]: (r["proposed"], r["confidence"], r["reason"], r["blocked"]) for r in repairing.repairs(spark.createDataFrame(rows, "id long, artist string"), known).collect()}
    assert got == {
        1: ("African Roots, Lebo", 0.85, "camelcase_merge_detected; known_sides=both", False),
        2: ("African Roots, Bob (IT)", 0.65, "camelcase_merge_detected; known_sides=left", True),
        3: ("Ann Lee, KokiMo", 0.85, "slash_separator_repair; known_sides=all", False),
        4: ("Ann Lee, Bob", 0.65, "pipe_separator_repair; known_sides=some", True),
        7: ("Some Sole, Other Way", 0.45, "camelcase_merge_detected; known_sides=none", True),
        10: ("Deep AfricanRoots SoulLebo, Lebo", 0.65, "slash_separator_repair; known_sides=some", True),
    }
    assert repairing.repairs(spark.createDataFrame([], "id long, artist string"), known).count() == 0


def test_comparison_forms_know_accents(spark):
    cases = {"Beyoncé": "beyoncé", "Sigur Rós": "sigur rós", "Ané": "ané", "Anö": "anö", "The Müller's A": "müllers", "a_b - C": "a_b c", "the an": "", None: ""}
    assert texts(spark, cases, parsing.compare_form) == list(cases.values())
    assert texts(spark, ["éxå & Bo x Cy"], parsing.artist_list) == [["éxå", "bo", "cy"]]
    assert texts(spark, ["é", None], text.composed) == ["é", None]


def test_rules_are_read_whole(spark, monkeypatch):
    rows = spark.createDataFrame([("phrases", "bad", " luck")], "field string, value string, unless string")
    config = parsing.from_rows(rows)
    assert texts(spark, ["bad luck x", "bad x"], lambda c: parsing.sanitised(c, config)) == ["bad luck x", "x"]
    monkeypatch.setattr(parsing, "MOST_RULES", 0)
    with pytest.raises(ValueError):
        parsing.from_rows(rows)
