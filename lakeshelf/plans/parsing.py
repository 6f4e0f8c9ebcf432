"""Queries of the text and name rules with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.functions import parsing, text
from lakeshelf.plans.catalogue import query
from lakeshelf.plans.views import view

ADS = parsing.DEFAULT
ENDS, VALID_ENDS = "|".join(ADS.domain_ends), "|".join(e for e in ADS.domain_ends if e != "co")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def each(values) -> str:
    return ", ".join(map(quoted, values))


def replaced(expr: str, pattern: str, new: str = "", options: str = "g") -> str:
    return f"regexp_replace({expr}, {quoted(pattern)}, {quoted(new)}, '{options}')"


def sanitised_sql(source: str, column: str, name: str) -> str:
    """CTEs that end in `name`: the rows of source with the sanitised column as `clean`. RE2 has no look-ahead, so an exempt word is marked first."""
    pieces = f"regexp_extract_all({replaced(replaced(column, r'^[^\w\s]*(?:\d+|[A-Za-z])\s*\|\s*'), r'([\[(])\s*([^\s\[\]()]+)\s*([\])])', r'\1\2\3')}, '[\\[\\]()]|\\s+|[^\\s\\[\\]()]+')"
    bare = replaced(replaced("v", r"(?i)(?:\bhttps?|ftp://|\bwww\.)\S+"), rf"(?i)^([^\w/]*)[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?\.(?:{ENDS})(?:/[^,;|]*)?([^\w.]*)$", r"\1\2")
    alone = r"p[k-1] IN ('[','(') AND p[k+1] IN (']',')') AND regexp_matches(v, '(?i)^[a-z0-9][\w-]*\.[a-z]{2,6}(?:/\S*)?$')"
    clean = f"array_to_string(list_transform(p, lambda v, k: CASE WHEN {alone} THEN '' ELSE {bare} END), '')"
    for pattern, unless in ADS.phrases:
        if unless:
            clean = replaced(clean, rf"(?i)\b(exc)(lusive{unless})", "\\1\x01\\2")
        clean = replaced(clean, f"(?i){pattern}")
        if unless:
            clean = replaced(clean, "\x01")
    clean = replaced(f"translate({clean}, {quoted(ADS.symbols)}, '')", r"[\[(]\s*[\])]")
    clean = replaced(replaced(replaced(clean, r"(?:\s*[-|]){2,}\s*", " - "), " {2,}", " "), r"^[\s|,;:-]+|[\s|,;:-]+$")
    return f"{name}_p AS (SELECT *, {pieces} AS p FROM {source}), {name} AS (SELECT * EXCLUDE (p), {clean} AS clean FROM {name}_p)"


def same_separators_sql(x: str) -> str:
    return f"trim({replaced(replaced(replaced(x, '[‐‑–—−]', '-'), r'\s*\|\s*', ' - '), r'\s+', ' ')})"


class Template(str):
    """SQL of an expression, with § where its argument stands."""

    def of(self, argument: str) -> str:
        return self.replace("§", argument)


KIND = Template("CASE " + " ".join(f"WHEN regexp_matches(§, {quoted(p)}) THEN '{k}'" for k, p in parsing.PREFIXES) + " END")
UNPREFIXED = Template("CASE " + " ".join(f"WHEN regexp_matches(§, {quoted(p)}) THEN trim(regexp_replace(§, {quoted(p)}, ''))" for k, p in parsing.PREFIXES) + " ELSE § END")
NUMBER = r"^(\d{1,4})(?:[\s._]*[-–—]\s*|[.\s_]+)([^\d\s–—._-])"
NUMBER_OF, UNNUMBERED = Template(f"regexp_extract(§, '{NUMBER}', 1)"), Template(f"trim(regexp_replace(§, '{NUMBER}', '\\2'))")
BRACKET = Template(f"list_filter(regexp_extract_all(§, '[(\\[][^)\\]]*[)\\]]'), lambda b: regexp_matches(lower(b), '{'|'.join(parsing.VERSION_WORDS)}') AND NOT regexp_matches(lower(b), '{'|'.join(parsing.SOURCE_WORDS)}'))[1]")
UNVERSIONED = Template(f"trim(CASE WHEN {BRACKET} IS NULL THEN § ELSE §[:instr(§, {BRACKET})-1] || §[instr(§, {BRACKET})+length({BRACKET}):] END)")
VERSION = Template(f"coalesce(trim({BRACKET}[2:-2]), '')")
VALID_TITLE = Template(r"coalesce(regexp_matches(§, '[^\s\-–—#_.]'), false)")
VALID_ARTIST = Template(rf"""(length(trim(coalesce(§,''))) >= 2 AND regexp_matches(§, '\p{{L}}') AND NOT regexp_matches(trim(§), '(?i)^(?:1[0-2]|[1-9])[ab]$') AND NOT regexp_matches(trim(§), '^\[.*\]$|^\(.*\)$')
  AND NOT regexp_matches(trim(§), '^\d+(?:\.|\s*[-–—])\s') AND NOT regexp_matches(trim(§), '(?i)^(?:https?|www)|(?:https?|ftp)[:/\s_]|www\.') AND NOT regexp_matches(trim(§), '(?i)^[a-z0-9][a-z0-9-]*\.(?:{VALID_ENDS})\s*$'))""")
COMPARED = Template(f"array_to_string(list_filter(string_split({replaced(replaced('lower(coalesce(§, chr(0)))', "['’`]s([^\\p{L}\\p{N}_]|$)", 's\\1'), '[^\\p{L}\\p{N}_]+', ' ')}, ' '), lambda w: w NOT IN ('', {each(parsing.ARTICLES)})), ' ')")


def parsed_sql(source: str, column: str, name: str) -> str:
    """CTEs that end in `name`: source's rows with artist, title, version and number of the column."""
    parts = "string_split_regex(n, '\\s+-\\s+')"
    rest = f"CASE WHEN len({parts}) > 1 THEN trim(regexp_replace(n, '^.*?\\s+-\\s+', '')) ELSE n END"
    return f"""{name}_a AS (SELECT *, {same_separators_sql(f"coalesce({column}, '')")} AS sep FROM {source}), {sanitised_sql(f'{name}_a', 'sep', f'{name}_b')},
  {name}_c AS (SELECT *, trim({UNPREFIXED.of('clean')}) AS m FROM {name}_b), {name}_d AS (SELECT *, {NUMBER_OF.of('m')} <> '' AND regexp_matches({UNNUMBERED.of('m')}, '\\s-\\s') AS has_number FROM {name}_c),
  {name}_e AS (SELECT *, CASE WHEN has_number THEN {UNNUMBERED.of('m')} ELSE m END AS n FROM {name}_d), {name}_f AS (SELECT *, {parts} AS parts, {rest} AS t FROM {name}_e),
  {name} AS (SELECT * EXCLUDE (parts, t, n, m, sep), CASE WHEN trim(clean) <> '' AND len(parts) > 1 THEN trim(parts[1]) ELSE '' END AS a1, CASE WHEN trim(clean) = '' THEN trim({column}) ELSE {UNVERSIONED.of('t')} END AS t1,
    CASE WHEN trim(clean) = '' THEN '' ELSE {VERSION.of('t')} END AS v1, CASE WHEN has_number AND trim(clean) <> '' THEN CAST({NUMBER_OF.of('m')} AS INT) END AS k1 FROM {name}_f)"""


def names(spark, sf_dir):
    return view(spark, sf_dir, "names")


@query(f"+ {sanitised_sql('v_names', 'stem', 's')} SELECT id, clean AS title FROM s", "names")
def sanitized_text(spark, sf_dir):
    return names(spark, sf_dir).select("id", parsing.sanitised(F.col("stem")).alias("title"))


@query(f"SELECT id, {KIND.of('stem')} AS kind, {UNPREFIXED.of('stem')} AS rest, try_cast({NUMBER_OF.of('stem')} AS INT) AS number, {UNNUMBERED.of('stem')} AS numberless FROM v_names", "names")
def name_prefixes(spark, sf_dir):
    stem = F.col("stem")
    return names(spark, sf_dir).select(
        "id", parsing.prefix_kind(stem).alias("kind"), parsing.without_prefix(stem).alias("rest"), parsing.track_number(stem).alias("number"), parsing.without_track_number(stem).alias("numberless")
    )


@query(f"SELECT id, {UNVERSIONED.of('stem')} AS title, {VERSION.of('stem')} AS version, trim(CASE WHEN {VERSION.of('stem')} = '' OR contains(lower(album), lower({VERSION.of('stem')})) THEN album ELSE album || ' (' || {VERSION.of('stem')} || ')' END) AS combined FROM v_names", "names")
def title_versions(spark, sf_dir):
    title, version = parsing.title_and_version(F.col("stem"))
    return names(spark, sf_dir).select("id", title.alias("title"), version.alias("version"), parsing.combined_title(F.col("album"), version).alias("combined"))


@query(f"SELECT id, coalesce({VALID_ARTIST.of('artist')}, false) AS artist_ok, {VALID_TITLE.of('album')} AS title_ok FROM v_names", "names")
def valid_names(spark, sf_dir):
    return names(spark, sf_dir).select("id", parsing.is_valid_artist(F.col("artist")).alias("artist_ok"), parsing.is_valid_title(F.col("album")).alias("title_ok"))


@query(f"+ {parsed_sql('v_names', 'stem', 'x')} SELECT id, a1 AS artist, t1 AS title, v1 AS version, k1 AS track_number FROM x", "names")
def parsed_stems(spark, sf_dir):
    return names(spark, sf_dir).select("id", parsing.parsed_stem(F.col("stem")).alias("x")).select("id", "x.*")


NOISE = quoted(parsing.NOISE)
SCORED = f"""+ r AS (SELECT id, trim(stem) AS raw, {same_separators_sql('trim(stem)')} AS same FROM v_names), j AS (SELECT *, {replaced('same', r'(?:\s*-){2,}\s*', ' - ')} AS joined FROM r),
  m AS (SELECT *, {UNPREFIXED.of('joined')} AS marked, {KIND.of('joined')} IS NOT NULL AS prefixed FROM j), u AS (SELECT *, {NUMBER_OF.of('marked')} <> '' AND contains({UNNUMBERED.of('marked')}, ' - ') AS numbered FROM m),
  w AS (SELECT *, CASE WHEN numbered THEN {UNNUMBERED.of('marked')} ELSE marked END AS name FROM u), {parsed_sql('w', 'name', 'x')},
  l AS (SELECT *, CASE WHEN NOT contains(name, ' - ') AND length({replaced('name', '[^-]')}) = 1 THEN string_split_regex(name, '\\s*-\\s*') END AS lone FROM x),
  y AS (SELECT *, trim(lone[1]) AS lft, trim(lone[2]) AS rgt FROM l), y2 AS (SELECT *, {UNVERSIONED.of('rgt')} AS rt, {VERSION.of('rgt')} AS rv FROM y),
  z AS (SELECT *, coalesce((a1 = '' OR t1 = '') AND length(lft) >= 2 AND length(rgt) >= 2 AND (length(lft) >= 3 OR length(rgt) >= 3) AND {VALID_ARTIST.of('lft')} AND {VALID_TITLE.of('rt')}, false) AS single FROM y2),
  o AS (SELECT *, CASE WHEN single THEN lft ELSE a1 END AS artist, CASE WHEN single THEN rt ELSE t1 END AS longer, CASE WHEN single AND rv <> '' THEN rv ELSE v1 END AS version FROM z),
  t AS (SELECT *, trim({replaced('longer', r'(?i)(?:\s*[-–—]\s*gold\s*)+$')}) AS title FROM o),
  g AS (SELECT *, list_filter([CASE WHEN same <> raw THEN 'separator_normalized' END, CASE WHEN joined <> same THEN 'malformed_separator_normalized' END, CASE WHEN prefixed THEN 'prefix_marker_removed' END,
    CASE WHEN numbered THEN 'track_prefix_removed' END, CASE WHEN single THEN 'single_separator_normalized' END, CASE WHEN title <> longer THEN 'suffix_junk_stripped' END], lambda q: q IS NOT NULL) AS reasons FROM t),
  p AS (SELECT *, 100 - CASE WHEN contains(name, ' - ') OR single THEN 0 ELSE 60 END - CASE WHEN single THEN 45 ELSE 0 END - CASE WHEN numbered THEN 15 ELSE 0 END - CASE WHEN prefixed THEN 15 ELSE 0 END - CASE WHEN joined <> same THEN 20 ELSE 0 END - CASE WHEN title <> longer THEN 15 ELSE 0 END AS points,
    artist = '' OR title = '' OR NOT coalesce({VALID_ARTIST.of('artist')}, false) OR NOT {VALID_TITLE.of('title')} OR regexp_matches(artist, {quoted(parsing.FOLDER_NAMES.format('|music|tracks?|set'))}) OR regexp_matches(title, {quoted(parsing.FOLDER_NAMES.format(''))})
    OR regexp_matches(artist, {NOISE}) OR regexp_matches(title, {NOISE}) OR regexp_matches(raw, {NOISE}) AS low FROM g),
  c AS (SELECT *, CASE WHEN low THEN 'LOW' WHEN points >= 80 THEN 'HIGH' WHEN points >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p)
  SELECT id, artist, title, version, confidence, array_to_string(reasons, ',') AS reasons, confidence <> 'LOW' AS accepted FROM c"""


@query(SCORED, "names")
def scored_parses(spark, sf_dir):
    rows = names(spark, sf_dir).select("id", parsing.scored_parse(F.col("stem")).alias("x")).select("id", "x.*")
    return rows.withColumn("reasons", F.array_join("reasons", ","))


GENRES, LABELS = ["deep house", "afro house", "techno", "house"], ["promo", "unknown label"]


@query(f"+ f AS (SELECT id, {', '.join(f'''lower(trim({replaced(f'''coalesce({c}, '')''', r'\\s+', ' ')})) AS {c}''' for c in ('artist', 'album'))} FROM v_names) SELECT id, "
       + ", ".join(f"{c} IN ({each((*ADS.sources, *LABELS, *GENRES))}) OR {' OR '.join(f'contains({c}, {quoted(p)})' for p in ADS.source_parts)} AS junk_{c}" for c in ("artist", "album")) + " FROM f", "names")
def junk_metadata(spark, sf_dir):
    return names(spark, sf_dir).select("id", *[parsing.is_junk(F.col(c), GENRES, LABELS).alias(f"junk_{c}") for c in ("artist", "album")])


LETTERS, CAPITALS, ALBUM = ("length(regexp_replace(trim(album), '[^\\p{L}]', '', 'g'))", "length(regexp_replace(trim(album), '[^\\p{Lu}]', '', 'g'))", "trim(album)")


@query(f"""SELECT id, regexp_matches(coalesce(artist,''), '&[A-Z]{{2,}}[a-z]') OR len(regexp_extract_all(coalesce(artist,''), '[a-z][A-Z]')) >= 2 OR (contains(coalesce(artist,''), ' ') AND len(list_filter(string_split(artist, ' '), lambda w: regexp_matches(w, '^.{{2,}}[a-z][A-Z]'))) > 0) AS glued,
  {ALBUM} <> '' AND (regexp_matches({ALBUM}, '(?i)https?:|www\\.|\\.(?:com|net|org)\\b|traxcrate|0day|zippy|tukillas|maismusicapro|(?:^|[^\\p{{L}}\\p{{N}}_])download(?:$|[^\\p{{L}}\\p{{N}}_])|blogspot|soundcloud\\s*rip|\\bmp3\\b') OR length(regexp_replace({ALBUM}, '[^.]', '', 'g')) > 2 OR regexp_matches({ALBUM}, '[/\\\\]')
    OR ({CAPITALS} > {LETTERS} * 0.8 AND regexp_matches({ALBUM}, '[._-]') AND {LETTERS} > 0)) AS junk_album,
  id % 20 IN (0, 1, 2) AS placeholder FROM v_names""", "names")  # fmt: skip
def odd_names(spark, sf_dir):
    path = F.concat(F.lit("/in/"), F.when(F.col("id") % 20 == 0, ".x.mp3").when(F.col("id") % 20 == 1, "Unknown (2).mp3").when(F.col("id") % 20 == 2, "unknown.aiff").when(F.col("id") % 20 == 3, "unknown x.mp3").otherwise("a.mp3"))
    return names(spark, sf_dir).select(
        "id", parsing.is_glued_artist(F.coalesce("artist", F.lit(""))).alias("glued"), parsing.is_junk_album(F.col("album")).alias("junk_album"), parsing.is_placeholder(path).alias("placeholder")
    )


EDGE = r"(^|[^\p{L}\p{N}_])"  # RE2's word boundary knows ASCII only, so separators that are words become commas where nothing joins them
COMMAS = replaced(replaced("coalesce(artist, '')", rf"(?i){EDGE}(?:feat|ft|vs|x)([^\p{{L}}\p{{N}}_]|$)", r"\1,\2"), "&", ",")
ARTISTS = f"list_transform(list_filter(string_split({COMMAS}, ','), lambda w: trim(w, ' .') <> ''), lambda w: {COMPARED.of('w')})"
MATCHED = replaced(replaced(replaced("trim(stem)", r"(?i)\s*[(\[][^)\]]*\b(?:records?|music(?:al)?|entertainment|digital|audio|label)\b[^)\]]*[)\]]"), r"(?i)\s*\b\d{2,3}\s*bpm\b\s*$"), r"\s+(?:[6-9]\d|1\d{2}|200)\s*$")


@query(f"SELECT id, {COMPARED.of('stem')} AS compared, array_to_string({ARTISTS}, '|') AS artists, trim({replaced(MATCHED, r'\s+', ' ')}) AS matched FROM v_names", "names")
def match_forms(spark, sf_dir):
    return names(spark, sf_dir).select(
        "id", parsing.compare_form(F.col("stem")).alias("compared"), F.array_join(parsing.artist_list(F.col("artist")), "|").alias("artists"), parsing.title_for_match(F.col("stem")).alias("matched")
    )


MONTH = Template("lpad(CAST(list_position([" + each(parsing.MONTHS) + "], lower(substr(§, 1, 3))) AS VARCHAR), 2, '0')")
DATE = f"""CASE WHEN regexp_matches(trim(released), '^\\d{{4}}(?:-\\d{{2}}){{0,2}}$') THEN trim(released)
  WHEN lower(substr(split_part(released, ' ', 2), 1, 3)) IN ({each(parsing.MONTHS)}) THEN split_part(released, ' ', 3) || '-' || {MONTH.of("split_part(released, ' ', 2)")} || '-' || lpad(split_part(released, ' ', 1), 2, '0')
  WHEN lower(substr(released, 1, 3)) IN ({each(parsing.MONTHS)}) THEN split_part(released, ' ', 2) || '-' || {MONTH.of('released')} ELSE trim(released) END"""


@query(f"""SELECT id, CASE WHEN lower(trim(artist)) NOT IN ({each(parsing.NULL_WORDS)}) THEN trim(artist) END AS artist, {DATE} AS released,
  round(length(regexp_replace(stem, '[\\p{{L}}\\p{{N}}\\s]', '', 'g')) / CAST(length(stem) AS DOUBLE), 9) AS density, len(list_filter(string_split_regex(stem, '[\\s,./\\\\_-]+'), lambda w: w <> '')) AS tokens,
  substr('MOCK' || lpad(CAST(list_sum(list_transform(string_split(stem, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ord(c) END)) % 10000000000 AS VARCHAR), 10, '0'), 1, 12) AS code FROM v_names""", "names")  # fmt: skip
def text_measures(spark, sf_dir):
    stem = F.col("stem")
    return names(spark, sf_dir).select(
        "id", parsing.without_null_words(F.col("artist")).alias("artist"), parsing.partial_date(F.col("released")).alias("released"), F.round(parsing.punctuation_density(stem), 9).alias("density"),
        parsing.token_count(stem).alias("tokens"), parsing.code_sum_id(stem).alias("code"),
    )


@query("SELECT id, p_size AS size, p_name AS name FROM v_noise", "noise")
def noisy_json(spark, sf_dir):
    rows = view(spark, sf_dir, "noise").select("id", parsing.json_in(F.col("answer"), "size int, name string").alias("x"))
    return rows.select("id", "x.size", "x.name")
