"""Sinks: CSV, JSON lines, playlists, collection XML, and plans of changes to files and tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str], joiner: str = " | ", mode: str = "overwrite") -> None:
    """A header and the columns in order; arrays are joined."""
    shown = [F.array_join(c, joiner).alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    df.select(*shown).write.mode(mode).option("header", True).csv(path)


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def playlists(rows: DataFrame, path: str, root: str = "") -> None:
    """One folder a playlist with M3U lines; rows: playlist, position, filepath, artist, title, duration_sec.

    Entries are sorted within their playlist's own file, which a task writes from sorted rows: no list is collected.
    """
    line = F.concat(
        F.lit("#EXTINF:"), F.coalesce(F.floor("duration_sec"), F.lit(-1)), F.lit(","), F.concat_ws(" - ", "artist", "title"), F.lit("\n"), F.lit(root), F.col("filepath"),
    )
    body = rows.select("playlist", "position", line.alias("value"))
    head = rows.select("playlist").distinct().select("playlist", F.lit(-1).cast("long").alias("position"), F.lit("#EXTM3U").alias("value"))
    both = head.unionByName(body.withColumn("position", F.col("position").cast("long")))
    both.repartition("playlist").sortWithinPartitions("playlist", "position").select("playlist", "value").write.mode("overwrite").partitionBy("playlist").text(path)


def collection_xml(tracks: DataFrame, path: str) -> None:
    """TRACK elements with attributes, by Spark's XML writer."""
    shown = {"_TrackID": F.col("id"), "_Name": F.col("title"), "_Artist": F.col("artist"), "_Genre": F.col("genre"), "_AverageBpm": F.format_string("%.2f", "bpm"), "_Tonality": F.col("key_camelot"), "_TotalTime": F.floor("duration_sec"), "_Location": F.col("filepath")}
    tracks.select(*[c.alias(n) for n, c in shown.items()]).write.mode("overwrite").format("xml").option("rowTag", "TRACK").option("rootTag", "COLLECTION").save(path)


def tag_changes(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, old, new) of every field that differs, null-safely: what a tag writer has to do."""
    b = after.select(F.col(key).alias("__key"), *[F.col(c).cast("string").alias(f"__{c}") for c in fields])
    rows = before.join(b, F.col(key) == F.col("__key"))
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old"), F.col(f"__{c}").alias("new")) for c in fields])
    changed = F.filter(each, lambda x: ~x["old"].eqNullSafe(x["new"]))
    return rows.select(F.col(key), F.explode(changed).alias("c")).select(key, "c.*")
