"""Queries that write a named file and read it again, with SQL of what it has to hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeshelf.plans.catalogue import query, tracks
from lakeshelf.plans.views import view
from lakeshelf.sources import whole


@query("SELECT item_id, review_status FROM v_reviews", "reviews")
def json_document(spark, sf_dir):
    path = whole.shared_folder(spark, "reviews.json")
    whole.json_document(view(spark, sf_dir, "reviews"), "item_id", path)
    lines = spark.read.text(path).where(F.col("value").startswith('"'))
    entry = F.from_json(F.concat(F.lit("{"), F.regexp_replace("value", ",$", ""), F.lit("}")), "map<string, struct<review_status: string>>")
    return lines.select(F.explode(entry).alias("item_id", "x")).select(F.col("item_id").cast("long").alias("item_id"), "x.review_status")


LINE = "'#EXTINF:' || CAST(trunc(CASE WHEN coalesce(duration_sec, 0) = 0 THEN -1 ELSE duration_sec END) AS BIGINT) || ',' || coalesce(nullif(artist, ''), 'Unknown') || ' - ' || coalesce(nullif(title, ''), regexp_extract(filepath, '([^/]*)\\.[^./]*$', 1))"


@query(f"SELECT value, count(*) AS n FROM (SELECT '#EXTM3U' AS value UNION ALL SELECT {LINE} FROM v_tracks WHERE status = 'ok' UNION ALL SELECT 'X:' || filepath FROM v_tracks WHERE status = 'ok') GROUP BY 1", "tracks")
def playlist_file(spark, sf_dir):
    path = whole.shared_folder(spark, "all.m3u")
    whole.playlist(tracks(spark, sf_dir).where("status = 'ok'"), path, "id", F.concat(F.lit("X:"), "filepath"))
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query(f"""SELECT value, count(*) AS n FROM (SELECT unnest([repeat('=', 70), 'LIBRARY', repeat('=', 70), '', 'ERRORS', repeat('-', 70), '', 'REVIEW', repeat('-', 70)]) AS value
  UNION ALL SELECT '  ' || filepath FROM v_tracks WHERE status IN ('error', 'needs_review')) GROUP BY 1""", "tracks")  # fmt: skip
def report_file(spark, sf_dir):
    path, rows = whole.shared_folder(spark, "report.txt"), tracks(spark, sf_dir)
    whole.report([(name, rows.where(F.col("status") == status).select(F.col("filepath").alias("value"))) for name, status in (("ERRORS", "error"), ("REVIEW", "needs_review"))], path, "LIBRARY")
    return spark.read.text(path).groupBy("value").agg(F.count("*").alias("n"))


@query("SELECT id, (row_number() OVER (ORDER BY id) - 1) // 150 + 1 AS page, (row_number() OVER (ORDER BY id) - 1) % 150 + 1 AS line FROM v_tracks", "tracks")
def paged_rows(spark, sf_dir):
    return whole.paged(tracks(spark, sf_dir).select("id"), ["id"], 150)


@query("SELECT page, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY id) - 1) // 150 + 1 AS page FROM v_tracks) GROUP BY 1", "tracks")
def paged_files(spark, sf_dir):
    folder = whole.shared_folder(spark, "pages")
    whole.paged_files(tracks(spark, sf_dir), ["id"], 150, folder, F.coalesce("title", F.lit("")))
    return spark.read.text(folder).groupBy(F.col("page").cast("long").alias("page")).agg(F.count("*").alias("n"))
