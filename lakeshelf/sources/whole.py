"""Sinks of one named file: documents, playlists and reports that readers see whole or not at all, and paged details.

Executors write the lines as parts of a folder beside the file. The parts are joined by streams of the file system, a
buffer at a time, into a second file that takes the name in one rename, so an old file stays until the new one is
complete, and a failure leaves it as it was.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeshelf.operators.mixing import kept

RULE = 70


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place in the folder that spark.checkpoint.dir names; a session in one process may do without that."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{place or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def whole_file(lines: DataFrame, path: str, head: str = "", foot: str = "", between: str = "\n") -> None:
    """The lines (value), in their order, with `between` between them, as one file at path; head and foot are written as they are.

    A file that was there is replaced at once. lines have to be sorted as a whole where order matters; null lines are
    left out, and no lines give head and foot alone.
    """
    spark = lines.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop, io = jvm.org.apache.hadoop.fs, jvm.org.apache.commons.io.IOUtils
    parts, new, target = (hadoop.Path(f"{path}{x}") for x in (f".parts-{uuid.uuid4().hex}", f".new-{uuid.uuid4().hex}", ""))
    files = target.getFileSystem(conf)
    try:
        lines.where("value IS NOT NULL").select("value").write.option("lineSep", between).text(parts.toString())
        found = sorted((s.getPath().toString(), s.getLen()) for s in files.listStatus(parts) if s.getLen() and s.getPath().getName().startswith("part-"))
        out = files.create(new, True)
        try:
            out.write(bytearray(head.encode()))
            for k, (name, size) in enumerate(found):
                into = files.open(hadoop.Path(name))
                # what stands between lines follows the last one too
                io.copyLarge(into, out, 0, size - len(between.encode()) * (k + 1 == len(found)))
                into.close()
            out.write(bytearray(foot.encode()))
        finally:
            out.close()
        over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(target.toUri(), conf).rename(files.makeQualified(new), files.makeQualified(target), over)
    finally:
        files.delete(parts, True)
        files.delete(new, False)


def json_document(rows: DataFrame, key: str, path: str) -> None:
    """One JSON object of all rows by their key, in its order, an entry a line; fields that are null are left out. Keys have to be unique."""
    entry = F.concat(F.to_json(F.array(F.col(key).cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(key).cast("string")))) - 2), F.lit(": "), F.to_json(F.struct(*[c for c in rows.columns if c != key])))
    lines = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), entry.alias("value")).orderBy("__key")
    whole_file(lines, path, "{\n", "\n}\n", ",\n")


def track_lines(place: Column) -> Column:
    """A playlist's two lines of a track: its length, artist and title, and where it is."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.regexp_extract("filepath", r"([^/]*?)(?:\.[^./]*)?$", 1))
    seconds = F.when(F.coalesce("duration_sec", F.lit(0)) == 0, -1).otherwise(F.col("duration_sec")).cast("long")
    return F.concat(F.lit("#EXTINF:"), seconds, F.lit(","), F.coalesce(F.nullif(F.col("artist"), F.lit("")), F.lit("Unknown")), F.lit(" - "), title, F.lit("\n"), place)


def playlist(rows: DataFrame, path: str, order: str = "position", place: Column | None = None) -> None:
    """An M3U file of rows (order, filepath, artist, title, duration_sec); place: where a track is, by default its filepath."""
    lines = rows.select(order, track_lines(F.col("filepath") if place is None else place).alias("value")).orderBy(order)
    whole_file(lines, path, "#EXTM3U\n", "\n")


def report(sections: list[tuple[str, DataFrame]], path: str, title: str) -> None:
    """A text report: its title, and for each section (name, rows (value)) a heading, a rule and its lines in the order of value."""
    shown = []
    for k, (name, rows) in enumerate(sections):
        heading = rows.sparkSession.createDataFrame([(k, -1, ""), (k, 0, name), (k, 1, "-" * RULE)], "section int, part int, value string")
        shown += [heading, rows.select(F.lit(k).alias("section"), F.lit(2).alias("part"), F.concat(F.lit("  "), "value").alias("value"))]
    lines = reduce(DataFrame.unionByName, shown).orderBy("section", "part", "value")
    whole_file(lines, path, f"{'=' * RULE}\n{title}\n{'=' * RULE}\n", "\n")


def paged(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with page and line, both from 1: `size` rows a page in the given order, which should be total.

    Ranges of the order are counted, one row a range, so no task holds more than its range.
    """
    ranged = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = [(r["__range"], r["n"]) for r in ranged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()]
    starts = [(r, sum(n for _, n in counts[:k])) for k, (r, _) in enumerate(counts)]
    starts = rows.sparkSession.createDataFrame(starts, "__range int, __start long")
    place = F.col("__start") + F.col("__at") - (F.col("__range").cast("long") * F.lit(1 << 33))
    return ranged.join(F.broadcast(starts), "__range").withColumns({"page": (place / size).cast("long") + 1, "line": place % size + 1}).drop("__range", "__at", "__start")


def paged_files(rows: DataFrame, order: list[str], size: int, folder: str, line: Column) -> DataFrame:
    """Writes text pages of `size` lines below folder (page=<n>) and returns their summary (page, n)."""
    pages = kept(paged(rows, order, size).select("page", "line", line.alias("value")))
    pages.repartition("page").sortWithinPartitions("page", "line").select("page", "value").write.mode("overwrite").partitionBy("page").text(folder)
    return pages.groupBy("page").agg(F.count("*").alias("n"))
