"""Catalogue views over the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshelf.operators.resolution import spread

TRACKS = """SELECT p_partkey AS id,
  concat('/lib/', substr(p_brand,7,1), '/', p_brand, '/', p_name, ' ', CAST(p_partkey % 400 AS VARCHAR(10)),
    CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' WHEN 2 THEN '.wav' ELSE '.m4a' END) AS filepath,
  CASE p_partkey % 17 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Unknown Artist' WHEN 3 THEN concat(p_brand, ' feat. Guest') ELSE p_brand END AS artist,
  CASE p_partkey % 23 WHEN 0 THEN NULL ELSE concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' (Original Mix)' WHEN 1 THEN ' (Extended Mix)' WHEN 2 THEN ' [djcity.com]' ELSE '' END) END AS title,
  CASE p_size % 9 WHEN 0 THEN 'Afro House' WHEN 1 THEN 'deep-house' WHEN 2 THEN 'Tech House' WHEN 3 THEN 'TECHNO' WHEN 4 THEN 'Amapiano' WHEN 5 THEN 'Drum and Bass' WHEN 6 THEN 'Melodic House; Other' WHEN 7 THEN 'beatport' ELSE NULL END AS genre,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 8e0 + ((p_partkey * 37) % 2500) / 10e0 END AS bpm,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE concat(CAST(1 + p_partkey % 12 AS VARCHAR(2)), CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END) END AS key_camelot,
  CAST(20 + (p_partkey * 53) % 600 AS DOUBLE) AS duration_sec,
  CASE p_partkey % 5 WHEN 0 THEN 96 WHEN 1 THEN 128 WHEN 2 THEN 192 WHEN 3 THEN 256 ELSE 320 END AS bitrate_kbps,
  CAST(p_retailprice * 1000 AS BIGINT) AS filesize_bytes,
  CASE WHEN p_partkey % 29 = 0 THEN 'error' WHEN p_partkey % 31 = 0 THEN 'needs_review' WHEN p_partkey % 37 = 0 THEN 'stale' ELSE 'ok' END AS status,
  CASE p_partkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'HIGH' END AS parse_confidence
FROM part"""

STATES = """SELECT event_id AS id,
  CASE event_type WHEN 'view' THEN 'metadata-sanitize' WHEN 'click' THEN 'artist-intelligence' WHEN 'signup' THEN 'metadata-enrich-online' WHEN 'purchase' THEN 'filename-normalize' ELSE 'library-organize' END AS stage,
  user_id AS track_id,
  CASE event_id % 7 WHEN 0 THEN 'stale' WHEN 1 THEN 'error' ELSE 'success' END AS status,
  ts AS processed_at, value AS file_size
FROM events"""

SETS = """SELECT o_orderkey AS id, concat('set_', CAST(o_orderkey AS VARCHAR(20))) AS name, o_orderdate AS created_at, o_totalprice AS duration_sec FROM orders"""

#: Positions in a set are numbered anew, as (order, line) isn't unique in the source.
SET_TRACKS = """SELECT l_orderkey AS set_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position,
  l_partkey AS track_id, CASE l_returnflag WHEN 'A' THEN 'warmup' WHEN 'N' THEN 'peak' ELSE 'outro' END AS phase, l_quantity AS play_sec
FROM lineitem"""

REVIEWS = """SELECT doc_id AS item_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'approved' ELSE 'deferred' END AS review_status FROM labels"""
FILES = """SELECT doc_id AS id, md5(text) AS content_hash, n_chars AS size, lang, source FROM documents"""
PLAYED = """SELECT conv_id AS session_id, turn AS position, role, length(text) AS n FROM conversations"""
INBOX = """SELECT event_id AS id, user_id AS folder, ts, event_type FROM events"""

#: File names without extension, with the prefixes, separators, versions and advertising that names come with.
NAMES = """SELECT p_partkey AS id, concat(
  CASE p_partkey % 16 WHEN 0 THEN '01 - ' WHEN 1 THEN '55. ' WHEN 2 THEN '8A - ' WHEN 3 THEN 'A - ' WHEN 4 THEN '# - ' WHEN 5 THEN '2 | ' WHEN 6 THEN '003_' WHEN 7 THEN 'www.pool.com ' WHEN 8 THEN '12b_ ' ELSE '' END,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'Folder Music' WHEN 2 THEN '[watermark]' WHEN 3 THEN concat(p_brand, ', Guest & Friend') ELSE p_brand END,
  CASE p_partkey % 9 WHEN 0 THEN '-' WHEN 1 THEN ' – ' WHEN 2 THEN ' | ' WHEN 3 THEN ' - - ' ELSE ' - ' END,
  p_name,
  CASE p_partkey % 17 WHEN 0 THEN ' (Original Mix)' WHEN 1 THEN ' [Extended Mix]' WHEN 2 THEN ' (fordjonly.com)' WHEN 3 THEN ' (djcity Remix)' WHEN 4 THEN ' [ www.x.org ]' WHEN 5 THEN ' - gold' WHEN 6 THEN ' Free Download'
    WHEN 7 THEN ' https___pool.net' WHEN 8 THEN ' ™ Exclusive' WHEN 9 THEN ' Exclusive Mix' WHEN 10 THEN ' (Live) (Club Edit) 2' WHEN 11 THEN ' pool.net/x, For DJs Only' WHEN 12 THEN ' httpspool.pro#' WHEN 13 THEN ' (Toolroom Records) 128bpm' ELSE '' END) AS stem,
  CASE p_partkey % 13 WHEN 0 THEN 'KaybeeShimzaBlack' WHEN 1 THEN 'AdilDJ feat. Sue' WHEN 2 THEN '&MERampa' WHEN 3 THEN '8B' WHEN 4 THEN 'N/A' WHEN 5 THEN 'DJCity' WHEN 6 THEN 'The Ray''s x Ben vs. Cy' WHEN 7 THEN '55. Bo' WHEN 8 THEN 'x.com' WHEN 9 THEN NULL WHEN 10 THEN 'Beyoncé, Ané & Éxå' WHEN 11 THEN 'Sigur Rós ft. Müller x Möller' ELSE p_brand END AS artist,
  CASE p_partkey % 8 WHEN 0 THEN 'DJ.POOL.UP' WHEN 6 THEN 'Downloaded Memories' WHEN 7 THEN 'Night (download)' WHEN 1 THEN 'a/b' WHEN 2 THEN 'www.site.com' WHEN 3 THEN '' WHEN 4 THEN 'Deep House' ELSE p_name END AS album,
  CASE p_partkey % 5 WHEN 0 THEN '2024-04-15' WHEN 1 THEN '5 Apr 2024' WHEN 2 THEN 'December 2023' WHEN 3 THEN ' 2020 ' ELSE 'soon' END AS released
FROM part"""

#: Credits of one to four artists in many spellings, with titles that may name a guest.
CREDITS = """SELECT p_partkey AS id, CASE p_partkey % 24 WHEN 0 THEN concat(p_brand, ', Ann Lee & Bob Fly') WHEN 1 THEN concat(p_brand, ' & Ann') WHEN 2 THEN concat(p_brand, ' x Bob') WHEN 3 THEN concat(p_brand, ' vs. Cy')
    WHEN 4 THEN concat(p_brand, ' and Dee') WHEN 5 THEN concat(p_brand, ' and 8A') WHEN 6 THEN concat(p_brand, ' ft. Eve') WHEN 7 THEN concat(p_brand, ' featuring feat. Fay & Gus') WHEN 8 THEN 'MAPHORISA' WHEN 9 THEN 'DJ LAG M.E. (SA)'
    WHEN 10 THEN 'ACRAZE' WHEN 11 THEN concat(p_brand, ' – ‘Hal’ 128 BPM') WHEN 12 THEN concat(p_brand, ' (Original Mix)') WHEN 13 THEN 'Mark Francis Aaron K Gray' WHEN 14 THEN 'Adri Block Hosh SBCR' WHEN 15 THEN 'Ivy Jones The Band'
    WHEN 16 THEN concat('African Roots', p_brand, ' Lee') WHEN 17 THEN 'Deep RootsLebo Koki (IT)' WHEN 18 THEN 'Ann Lee/Bob Fly | Koki Mo' WHEN 19 THEN 'AC/DC' WHEN 20 THEN 'Ann McBee, Some MusiQ' WHEN 21 THEN '  ' WHEN 22 THEN NULL ELSE 'Beyoncé, , Sigur Rós' END AS artist,
  CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ' (feat. Zoe)') WHEN 1 THEN NULL ELSE p_name END AS title FROM part"""

#: Tracks as an export reads them, and files of which some lie elsewhere.
EXPORTS = """SELECT p_partkey AS id, concat('/lib/', CASE p_partkey % 31 WHEN 0 THEN 'Unknown (3).mp3' WHEN 1 THEN '.x.mp3' ELSE concat(CASE p_partkey % 4 WHEN 0 THEN p_name ELSE concat(p_brand, ' - ', p_name) END, ' ', CAST(p_partkey AS VARCHAR(20)), '.mp3') END) AS filepath,
  CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' VA ' ELSE p_brand END AS artist, CASE p_partkey % 7 WHEN 0 THEN '' ELSE p_name END AS title, CASE p_partkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 0e0 WHEN 2 THEN 231.5e0 ELSE 120e0 + p_partkey % 9 END AS bpm,
  CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN '13A' ELSE concat(CAST(1 + p_partkey % 12 AS VARCHAR(2)), 'b') END AS key_camelot,
  CASE p_partkey % 23 WHEN 0 THEN 'Deep House Classic' WHEN 1 THEN 'Afro Gospel House' WHEN 2 THEN 'afro-tech' WHEN 3 THEN 'beatport' WHEN 4 THEN NULL WHEN 5 THEN 'House Reprise' WHEN 6 THEN 'Minimal Techno; x' WHEN 7 THEN 'Jazz' WHEN 8 THEN 'classic gospel' WHEN 9 THEN 'Old School Hip-Hop'
    WHEN 10 THEN 'R&B' WHEN 11 THEN '8A' WHEN 12 THEN 'Progressive Afro House' WHEN 13 THEN 'Gospel House' WHEN 14 THEN 'UK Garage' ELSE 'tech_house' END AS genre FROM part"""

#: Fields and file names that may hold a record label, in several spellings of each.
LABELLED = """SELECT p_partkey AS id, concat('/lib/', CASE p_partkey % 9 WHEN 0 THEN '[Toolroom] Ann - Night' WHEN 1 THEN '(Sub Label) Ann - Night' WHEN 2 THEN 'Ann - Night (Some Records)' WHEN 3 THEN 'Some_Label__Ann__Night' WHEN 4 THEN 'Label Co__Ann' WHEN 5 THEN 'Ann - Night [Deep Music]' WHEN 6 THEN '[8A] Ann - Night' ELSE 'Ann - Night' END, '.mp3') AS filepath,
  CASE p_partkey % 13 WHEN 0 THEN concat(p_brand, ' Records') WHEN 1 THEN upper(concat(p_brand, ' recordings')) WHEN 2 THEN p_brand WHEN 3 THEN '8A -' WHEN 4 THEN 'www.pool.com' WHEN 5 THEN 'pool.net' WHEN 6 THEN 'Deep House' WHEN 7 THEN '[ va ]' WHEN 8 THEN 'ABC001' WHEN 9 THEN 'Records' WHEN 10 THEN concat(p_brand, '  Music  Group') ELSE NULL END AS organization,
  CASE p_partkey % 7 WHEN 0 THEN concat(p_brand, '!') WHEN 1 THEN 'x' WHEN 2 THEN 'promo only' ELSE '' END AS grouping, CASE p_partkey % 11 WHEN 0 THEN 'Beyoncé Records' WHEN 1 THEN '??' ELSE NULL END AS comment,
  CASE p_partkey % 5 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Ann Music' WHEN 2 THEN 'djcity music' ELSE NULL END AS albumartist, CASE p_partkey % 3 WHEN 0 THEN 'Night Sounds' WHEN 1 THEN '000' ELSE 'Night' END AS album FROM part"""

#: Actions of a plan with every fault, approvals of some, and ledger rows.
ACTIONS = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'delete_file' WHEN 2 THEN 'mark_orphan_candidate' WHEN 3 THEN 'update_queue_reference' WHEN 4 THEN 'update_queue_reference' ELSE 'update_path_reference' END AS action,
  CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN concat('/out/', CAST(p_partkey AS VARCHAR(20))) ELSE concat('/lib/', CASE p_partkey % 2 WHEN 0 THEN './' ELSE '' END, CAST(p_partkey AS VARCHAR(20))) END AS old_path,
  CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN '/elsewhere' ELSE concat('/lib/new/', CAST(p_partkey % 500 AS VARCHAR(20))) END AS new_path, CAST(NULL AS VARCHAR(9)) AS filepath,
  CASE p_partkey % 7 WHEN 0 THEN 'WEAK_MATCH' WHEN 1 THEN 'REVIEW_CAREFULLY' WHEN 2 THEN 'ODD' WHEN 3 THEN NULL ELSE 'AUTO_SAFE_CANDIDATE' END AS review_tier, CASE p_partkey % 5 WHEN 0 THEN 'REVIEW_REQUIRED' WHEN 1 THEN 'HIGH' WHEN 2 THEN NULL ELSE 'LOW' END AS risk,
  CASE p_partkey % 6 WHEN 0 THEN '1.5' WHEN 1 THEN 'much' WHEN 2 THEN NULL ELSE '0.9' END AS confidence, p_partkey % 31 = 0 AS report_only, p_partkey % 4 = 0 AS unresolved, CASE p_partkey % 3 WHEN 0 THEN concat('a', CAST(p_partkey AS VARCHAR(20))) ELSE NULL END AS action_id,
  CAST(NULL AS VARCHAR(9)) AS ledger_id, CAST(NULL AS VARCHAR(9)) AS queue_file, p_partkey % 41 = 0 AS approved, CASE p_partkey % 37 WHEN 0 THEN 'Approved' ELSE NULL END AS review_status FROM part"""
LEDGERS = """SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN '' ELSE concat('l', CAST(p_partkey AS VARCHAR(20))) END AS ledger_id, '2024-01-01' AS created_at, CASE p_partkey % 12 WHEN 0 THEN NULL ELSE 'update' END AS operation_type, 'applied' AS status,
  CASE p_partkey % 5 WHEN 0 THEN '/gone' WHEN 1 THEN NULL ELSE '/lib' END AS root, CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '/lib/none' ELSE concat('/lib/', CAST(p_partkey AS VARCHAR(20))) END AS old_path, CASE p_partkey % 8 WHEN 0 THEN '/lib/none' ELSE '' END AS new_path,
  CASE p_partkey % 7 WHEN 0 THEN '["tracks", " "]' WHEN 1 THEN '"tracks"' WHEN 2 THEN 'tracks, states,' WHEN 3 THEN '' WHEN 4 THEN concat(chr(123), '"a": 1', chr(125)) WHEN 5 THEN '[]' ELSE NULL END AS affected_tables,
  CASE p_partkey % 4 WHEN 0 THEN concat(chr(123), '"a": 1', chr(125)) WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE '[1]' END AS before_values_json, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '1' ELSE concat(chr(123), '"a": ', chr(125)) END AS after_values_json FROM part"""

#: Frames of a track's features, two a second: as many as it has order lines.
FRAMES = """SELECT l_partkey AS id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 AS frame, l_quantity / 50e0 AS level, l_discount * 10e0 AS bass, l_tax * 12e0 AS flux FROM lineitem"""

#: Tags of files with all faults that cleaning knows; every 17th has several artists.
TAGS = """SELECT p_partkey AS id, p_partkey % 17 = 0 AS several, CASE p_partkey % 26 WHEN 0 THEN concat('02 | ', p_name) WHEN 1 THEN concat('3 ', p_name) WHEN 2 THEN concat('4 You ', p_name) WHEN 3 THEN concat('15 ', p_name) WHEN 4 THEN concat(p_name, ' (fordjonly.com) x')
    WHEN 5 THEN concat(p_name, ' 128') WHEN 6 THEN concat(p_name, ' 200') WHEN 7 THEN concat(p_name, ' (Xumba Recordings)122') WHEN 8 THEN concat(p_name, ' (Music Club Mix)') WHEN 9 THEN concat(p_name, ' (Feat. Ann)') WHEN 10 THEN concat(p_name, ' -  - x')
    WHEN 11 THEN concat(p_name, ' [] y') WHEN 12 THEN concat(p_name, ' (Dub') WHEN 13 THEN concat(p_name, '(Dub)') WHEN 14 THEN concat('  ', p_name, '   z ') WHEN 15 THEN concat(p_name, ' (Techno and Chill)') WHEN 16 THEN '99' WHEN 17 THEN concat('***2 – ', p_name) WHEN 18 THEN NULL
    WHEN 19 THEN concat(p_name, ' big BIG big') WHEN 20 THEN concat(p_name, ' AlbumVersion') WHEN 21 THEN concat(p_name, ' MaciaDownloads') WHEN 22 THEN concat(p_name, ' | ', p_name) WHEN 23 THEN concat(p_name, ' djcity.com') ELSE p_name END AS title,
  CASE p_partkey % 11 WHEN 0 THEN concat(p_brand, ' www.x.org') WHEN 1 THEN concat(p_brand, ' ft. Bo') WHEN 2 THEN concat(p_brand, ' featuring Bo ft.') WHEN 3 THEN concat(p_brand, ', , Cy') WHEN 4 THEN concat(p_brand, '  Dee ') WHEN 5 THEN 'pool.com' WHEN 6 THEN NULL WHEN 7 THEN concat(p_brand, ' [zippy]') ELSE p_brand END AS artist,
  CASE p_partkey % 12 WHEN 0 THEN 'mail ann@pool.com' WHEN 1 THEN 'www.pool.com' WHEN 2 THEN 'Night http://x.y/z' WHEN 3 THEN '/home/x' WHEN 4 THEN 'C:/music' WHEN 5 THEN 'Wait.....what' WHEN 6 THEN 'pool.net' WHEN 7 THEN 'Promo Only' WHEN 8 THEN 'Night [djcity]' WHEN 9 THEN '' WHEN 10 THEN NULL ELSE p_name END AS album,
  CASE p_partkey % 6 WHEN 0 THEN 'USRC17607839' WHEN 1 THEN 'us-rc1-76-07839' WHEN 2 THEN 'USRC1760783' WHEN 3 THEN ' GBAYE 0601498 ' WHEN 4 THEN NULL ELSE 'none' END AS isrc,
  CASE p_partkey % 7 WHEN 0 THEN 'me@x.org' WHEN 1 THEN ' White Label ' WHEN 2 THEN '??' WHEN 3 THEN 'Some  Records' WHEN 4 THEN NULL WHEN 5 THEN 'Promo Records' ELSE p_brand END AS organization FROM part"""

#: Answers with one JSON object somewhere in their text.
NOISE = """SELECT p_partkey AS id, p_size, p_name, concat(CASE p_partkey % 3 WHEN 0 THEN 'Here: ```json ' WHEN 1 THEN 'I think ' ELSE '' END, chr(123), '"size": ', CAST(p_size AS VARCHAR(9)), ', "name": "', p_name, '"', chr(125),
  CASE p_partkey % 3 WHEN 0 THEN concat(' ``` ', chr(123)) WHEN 1 THEN ' fits.' ELSE '' END) AS answer FROM part"""

#: A file's old and new name, which differ in nothing, a version, a leading number or the artists.
PAIRS = """SELECT p_partkey AS id, concat('/lib/', p_brand, ' - ', p_name, CASE p_partkey % 4 WHEN 0 THEN ' (Original Mix)' WHEN 1 THEN ' Re Edit' ELSE '' END, '.mp3') AS old_path,
  concat('/new/', p_brand, CASE p_partkey % 7 WHEN 0 THEN ', Ann & Bob' WHEN 1 THEN ' feat. Ann' ELSE '' END, ' - ', CASE p_partkey % 5 WHEN 0 THEN '7 ' ELSE '' END, p_name,
    CASE p_partkey % 3 WHEN 0 THEN ' (Original Mix)' WHEN 1 THEN ' (Re-Edit)' ELSE '' END, CASE p_partkey % 11 WHEN 0 THEN '.wav' ELSE '.mp3' END) AS new_path,
  CASE p_partkey % 6 WHEN 0 THEN 0.79e0 WHEN 1 THEN 0.9e0 ELSE 0.97e0 END AS score, CASE p_partkey % 8 WHEN 0 THEN 0.8e0 ELSE 1e0 END AS overlap,
  CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN 0.05e0 ELSE 0.001e0 END AS off
FROM part"""

#: Queue entries of tracks with what is proposed for them, and candidates from elsewhere with similarities.
QUEUE = """SELECT p_partkey * 10 AS item_id, CASE p_partkey % 23 WHEN 0 THEN NULL WHEN 1 THEN p_partkey + 1 WHEN 2 THEN p_partkey + 100000000 ELSE p_partkey END AS track_id,
  CASE p_partkey % 19 WHEN 0 THEN '' ELSE concat(CASE p_partkey % 5 WHEN 0 THEN '' ELSE '/lib' END, '/', substr(p_brand,7,1), '/', p_brand, '/', p_name, ' ', CAST(p_partkey % 400 AS VARCHAR(10)),
    CASE p_partkey % 4 WHEN 0 THEN '.mp3' WHEN 1 THEN '.flac' WHEN 2 THEN '.wav' ELSE '.m4a' END) END AS filepath,
  CASE p_partkey % 3 WHEN 0 THEN 'MEDIUM' WHEN 1 THEN 'high' ELSE 'HIGH' END AS confidence, CASE p_partkey % 8 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' WHEN 2 THEN 'applied' ELSE 'approved' END AS status,
  CASE p_partkey % 29 WHEN 0 THEN '4A' WHEN 1 THEN '' ELSE p_brand END AS proposed_artist, p_name AS proposed_title, CASE p_partkey % 2 WHEN 0 THEN 'Deep House' ELSE NULL END AS proposed_genre,
  CASE p_partkey % 4 WHEN 0 THEN 'wrong track' ELSE NULL END AS reason FROM part"""
CANDIDATES = """SELECT l_orderkey AS track_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS candidate,
  CASE l_partkey % 3 WHEN 0 THEN 'Night (Original Mix)' ELSE 'Night' END AS title, CASE l_suppkey % 4 WHEN 0 THEN 'Night (Original Mix)' WHEN 1 THEN 'Night [Dub]' ELSE 'Night' END AS c_title,
  CASE l_partkey % 41 WHEN 0 THEN 'ab1' ELSE '' END AS isrc, CASE l_partkey % 2 WHEN 0 THEN ' AB1' ELSE NULL END AS c_isrc,
  CASE WHEN l_quantity > 20 THEN 1e0 ELSE 0.9e0 END AS title_sim, CASE WHEN l_suppkey % 7 = 0 THEN 0.82e0 ELSE 0.95e0 END AS artist_sim, CASE WHEN l_partkey % 5 = 0 THEN 0e0 ELSE 1e0 END AS version_sim,
  CASE WHEN l_partkey % 6 = 0 THEN 0.8e0 ELSE 0.3e0 END AS label_sim, l_partkey % 10 = 0 AS same_alias FROM lineitem"""
JOBS = """SELECT event_id AS id, user_id AS job, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'signup' THEN 'succeeded' WHEN 'purchase' THEN 'failed' ELSE 'other' END AS state, ts AS since FROM events"""

VIEWS = {
    "frames": (FRAMES, ["lineitem"]), "actions": (ACTIONS, ["part"]), "ledgers": (LEDGERS, ["part"]), "labelled": (LABELLED, ["part"]), "exports": (EXPORTS, ["part"]), "tags": (TAGS, ["part"]), "credits": (CREDITS, ["part"]), "queue": (QUEUE, ["part"]), "candidates": (CANDIDATES, ["lineitem"]), "jobs": (JOBS, ["events"]),
    "pairs": (PAIRS, ["part"]), "noise": (NOISE, ["part"]), "names": (NAMES, ["part"]),
    "tracks": (TRACKS, ["part"]), "states": (STATES, ["events"]), "sets": (SETS, ["orders"]), "set_tracks": (SET_TRACKS, ["lineitem"]),
    "reviews": (REVIEWS, ["labels"]), "files": (FILES, ["documents"]), "played": (PLAYED, ["conversations"]), "inbox": (INBOX, ["events"]),
}

#: Views whose rows go through long chains of rules: readers deal a small file to one task or two, however long its rules take.
RULED = ("labelled", "exports", "tags", "credits", "pairs", "names", "actions", "ledgers", "queue")

#: Tables whose rows a view and its readers sort by a key, and about how many of them one task holds, which bounds its memory.
KEYED, TASK_ROWS = {"frames": {"lineitem": "l_partkey"}}, 1 << 18


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its tables are referred to as arguments, so no temporary view is left behind."""
    text, tables = VIEWS[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if name in RULED:  # as generated rows, since a filter by a rule's result would be moved before the spreading otherwise
        rows = {t: spread(df).select(F.inline_outer(F.array(F.struct("*")))) for t, df in rows.items()}
    for t, key in KEYED.get(name, {}).items():
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows[t].count() // TASK_ROWS))
        rows[t] = rows[t].repartition(tasks, key)
    return spark.sql(text, **rows)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL over views (named v_<name>) as a WITH clause."""
    return "WITH " + ", ".join(f"v_{n} AS ({VIEWS[n][0]})" for n in names) + ("," if sql.lstrip().startswith("+") else "") + " " + sql.lstrip().lstrip("+")
