"""Rules of tag fields by literal cases; the queries are held against SQL with all others."""

import pytest
from pyspark.sql import functions as F

from lakeshelf.operators import cleaning


def chain(spark, rules, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").select("k", cleaning.chained(F.col("v"), rules).alias("x"))
    return [(r["x"]["value"], r["x"]["reasons"][0] if r["x"]["reasons"] else "") for r in rows.orderBy("k").collect()]


def test_titles(spark):
    cases = {
        "1 | Title": ("Title", "title_prefix_removed"), "003. Title": ("Title", "title_prefix_removed"), "***2 – Title": ("Title", "title_prefix_removed"), "01 Luftballons": ("Luftballons", "title_bare_number_stripped"),
        "2 Sada": ("Sada", "title_bare_number_stripped"), "4 You": ("4 You", ""), "15 Minutes": ("15 Minutes", ""), "3 13th Friday": ("3 13th Friday", ""), "5 A": ("5 A", ""), "7 Rings": ("Rings", "title_bare_number_stripped"),
        "Night (hulkshare.com) x": ("Night x", "title_domain_token_stripped"), "Night 128": ("Night", "title_trailing_bpm_stripped"), "Night 161": ("Night 161", ""), "128": ("128", ""), "Night (Xumba Recordings)122": ("Night", "title_trailing_bpm_stripped"),
        "Night (Xumba Recordings)": ("Night", "title_label_suffix_stripped"), "Night (Music Club Mix)": ("Night (Music Club Mix)", ""), "Night (Shockit)": ("Night", "title_label_suffix_stripped"), "(Some Records)": ("(Some Records)", ""), "Night (Musical)": ("Night (Musical)", ""),
        "Night (Feat. Bo)": ("Night (feat. Bo)", "title_feat_normalized"), "A -  - B": ("A - B", "title_separator_fixed"), "A [ ] B": ("A B", "title_spacing_fixed"), "A (B": ("A", "title_parentheses_fixed"), "A(B)": ("A (B)", "title_spacing_fixed"),
        "A  B": ("A B", "title_spacing_fixed"), " A": ("A", "title_domain_token_stripped"), "Né  é": ("Né é", "title_spacing_fixed"), "": ("", ""), None: ("", ""),
    }
    assert chain(spark, cleaning.TITLE, cases) == list(cases.values())


def test_artists_labels_and_codes(spark):
    artists = {"Ann www.x.y": ("Ann", "artist_url_removed"), "Ann pool.com": ("Ann", "artist_url_removed"), "Ann ft. Bo": ("Ann feat. Bo", "artist_feat_normalized"), "Ann ft. ": ("Ann ft.", "artist_url_removed"), "Ann, , Bo": ("Ann, Bo", "artist_spacing_fixed"), "Soft.": ("Soft.", "")}
    assert chain(spark, cleaning.ARTIST, artists) == list(artists.values())
    labels = {"a@b.de": ("", "label_junk_email"), " VA ": ("", "label_junk_placeholder"), "??": ("", "label_junk_placeholder"), "Va Records": ("Va Records", ""), "A  B": ("A B", "label_spacing_fixed"), "—": ("", "label_junk_placeholder")}
    assert chain(spark, cleaning.LABEL, labels) == list(labels.values())
    codes = {"USRC17607839": ("USRC17607839", ""), "us-rc1-76-07839": ("us-rc1-76-07839", ""), "USRC1760783": ("", "invalid_isrc"), " GBAYE0601498 ": (" GBAYE0601498 ", ""), "12RC17607839": ("", "invalid_isrc"), "": ("", "")}
    assert chain(spark, cleaning.CODE, codes) == list(codes.values())


@pytest.mark.parametrize(
    ("album", "value", "reason"),
    [("a@b.de x", "", "album_junk_email"), ("www.x.com", "", "album_junk_url"), ("Night http://x.y", "Night", "album_url_stripped"), ("/home", "", "album_junk_path_fragment"), ("C:\\x", "", "album_junk_path_fragment"), ("His/Hers", "His/Hers", None),
     ("Future...Past", "Future...Past", None), ("a.....b", "", "album_junk_excessive_dots"), ("pool.com", "", "album_junk_domain"), ("Promo Only", "", "album_junk_promo"), ("Night [djcity]", "Night", "album_promo_stripped"), ("", "", None), (None, "", None)],
)
def test_albums(spark, album, value, reason):
    x = spark.createDataFrame([(album,)], "v string").select(cleaning.clean_album(F.col("v")).alias("x")).first()["x"]
    assert (x["value"], x["reasons"]) == (value, [reason] if reason else [])


def test_changes_of_a_file_are_one_row(spark):
    one = "array<string>"
    rows = [("a", ["Night (Dub"], ["Ann", "Bo"], None, [], ["x@y.de"]), ("b", ["Night"], ["Ann"], ["Sun"], ["USRC17607839"], [None]), ("c", None, None, [""], ["bad"], [])]
    df = spark.createDataFrame(rows, f"file string, title {one}, artist {one}, album {one}, isrc {one}, organization {one}")
    got = {r["file"]: ([(c["field"], c["new"], c["reason"]) for c in r["changes"]], r["skipped"]) for r in cleaning.tag_changes(df, "file").collect()}
    assert got == {"a": ([("title", "Night", "title_parentheses_fixed"), ("organization", "", "label_junk_email")], ["artist: skipped_multi_value_artist"]), "c": ([("isrc", "", "invalid_isrc")], [])}


def test_proposals(spark):
    rows = [(1, "Ann", "Night AlbumVersion"), (2, "Ann", "big BIG big night"), (3, "Ann [djcity]", "Night"), (4, "Ann", "Night  Day"), (5, "Ann", "so so"), (6, "fordjonly.com", "Night"), (7, None, None), (8, "A|B", "X MaciaDownloads"), (9, " Ann ", "Night")]
    got = {r["id"]: (r["artist"]["proposed"], r["title"]["proposed"], r["confidence"], r["reason"], r["flags"]) for r in cleaning.sanitation_proposals(spark.createDataFrame(rows, "id long, artist string, title string")).collect()}
    assert got == {
        1: ("Ann", "Night", "LOW", "manual review required; ambiguous version cleanup", ["ambiguous_version_cleanup"]),
        2: ("Ann", "big night", "MEDIUM", "duplicated word cleanup", ["duplicated_word_cleanup"]),
        3: ("Ann", "Night", "LOW", "source/piracy token removed", ["source_token_removed"]),
        4: ("Ann", "Night Day", "HIGH", "whitespace corruption normalized", []),
        8: ("A - B", "X", "HIGH", "junk suffix removed safely", ["junk_suffix_removed"]),
    }


def test_field_states(spark):
    rows = spark.createDataFrame([("Approved", "a", "b"), ("odd", "a", None), (None, None, "b")], "s string, c string, p string")
    got = [r["x"].asDict() for r in rows.select(cleaning.field_state(F.col("c"), F.col("p"), F.col("s")).alias("x")).collect()]
    assert [x["status"] for x in got] == ["approved", "pending", "pending"] and got[0]["original_proposed"] == "b" and not got[0]["edited"]


def test_a_filter_does_not_multiply_the_chain(spark):
    rows = cleaning.sanitation_proposals(spark.createDataFrame([(1, "a", "b")], "id long, artist string, title string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 300
