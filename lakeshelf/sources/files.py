"""File, JSON, text and catalogue sources. All reading goes through Spark, so any store that Spark knows will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Suffixes of audio files, and folders that scans leave out.
AUDIO = ("mp3", "flac", "wav", "aiff", "aif", "m4a", "ogg", "opus")
SKIPPED = ("_quarantine", "_rejected", "logs", "duplicates")


def audio_files(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED, hidden: bool = False, limit: int | None = None) -> DataFrame:
    """(path, length, modificationTime) of audio files below root, ordered by path; no file content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    rows = rows.where(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*AUDIO))
    parts = F.split("path", "/")
    if not hidden:
        rows = rows.where(~F.exists(parts, lambda p: p.isin(*skip) | p.startswith(".")))
    rows = rows.dropDuplicates(["path"]).orderBy("path")
    return rows.limit(limit) if limit else rows


def unanalysed(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Files without a track, or whose track has no tempo or no key."""
    t = tracks.select(F.col("filepath").alias("path"), "id", "bpm", "key_camelot")
    return files.join(t, "path", "left").where("id IS NULL OR bpm IS NULL OR key_camelot IS NULL").select(files.columns)


def tolerant(df: DataFrame, schema: StructType, aliases: dict[str, str] | None = None) -> DataFrame:
    """df with exactly the columns of schema: absent ones are typed nulls, aliases name older columns."""
    have = set(df.columns)

    def pick(name: str) -> Column:
        old = (aliases or {}).get(name)
        return F.col(name) if name in have else F.col(old) if old in have else F.lit(None)

    return df.select(*[pick(f.name).cast(f.dataType).alias(f.name) for f in schema])


def json_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """One object a line; broken lines are dropped, or fail the read if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """(key, item fields) of documents {"items": {key: item}}; item is a DDL struct body."""
    docs = spark.read.schema(f"items MAP<STRING, STRUCT<{item}>>").option("multiLine", True).json(path)
    return docs.select(F.explode("items").alias("key", "item")).select("key", "item.*")


def newest(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """Rows of the file with the greatest name among those that match; times in names sort as text."""
    rows = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("__file", F.col("_metadata.file_path"))
    last = rows.agg(F.max("__file").alias("__last"))
    return rows.join(F.broadcast(last), F.col("__file") == F.col("__last")).drop("__file", "__last")  # one row


def known_values(spark: SparkSession, path: str) -> DataFrame:
    """(value): distinct lower-case lines without comments."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("value")).where("value <> '' AND NOT startswith(value, '#')").distinct()


def copies_from_report(spark: SparkSession, path: str) -> DataFrame:
    """(original, duplicate) of a duplicate finder's CSV with columns type, prehash, is_original, path."""
    rows = spark.read.option("header", True).csv(path).where("type = 'duplicate_file'")
    first = F.min_by("path", F.struct(F.when(F.lower("is_original") == "true", 0).otherwise(1), F.col("path")))
    originals = rows.groupBy("prehash").agg(first.alias("original"))
    return rows.join(originals, "prehash").where("path <> original").select("original", F.col("path").alias("duplicate"))


def path_values(rows: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """(field, value, location) of string values under given keys anywhere in a JSON column.

    One pass for each level of nesting, as long as a level has values; the number of passes is the deepest nesting.
    """
    spark = rows.sparkSession
    level, found = rows.select(F.expr(f"try_parse_json({json_col})").alias("v"), F.lit("$").alias("location")), []
    place = "concat(location, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END)"
    while not found or not level.isEmpty():
        level = spark.sql(f"SELECT e.key, e.value AS v, {place} AS location FROM {{level}} AS l, LATERAL variant_explode(l.v) AS e", level=level)
        found.append(level.where(F.col("key").isin(keys)).select(F.col("key").alias("field"), F.expr("try_variant_get(v, '$', 'string')").alias("value"), "location"))
    return reduce(DataFrame.unionByName, found).where("value IS NOT NULL")


def probe(json_col: Column) -> Column:
    """struct<codec, kbps> of a media probe's JSON: the first audio stream; its own bit rate before the container's."""
    kind = "STRUCT<streams: ARRAY<STRUCT<codec_type: STRING, codec_name: STRING, bit_rate: STRING>>, format: STRUCT<bit_rate: STRING>>"
    p = F.from_json(json_col, kind)
    audio = F.get(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(0))
    rate = F.coalesce(audio["bit_rate"].try_cast("long"), p["format"]["bit_rate"].try_cast("long"))
    return F.struct(audio["codec_name"].alias("codec"), F.floor(rate / 1000).cast("int").alias("kbps"))


def folders(files: DataFrame, path_col: str, depth: int) -> DataFrame:
    """(folder, n): files below every folder down to a depth."""
    parts = F.split(F.regexp_extract(path_col, r"^/?(.*)/[^/]*$", 1), "/")
    each = F.transform(F.sequence(F.lit(1), F.least(F.lit(depth), F.size(parts))), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return files.select(F.explode(each).alias("folder")).groupBy("folder").agg(F.count("*").alias("n"))
