"""Exact duplicates with a heavy-hitter split.

A Misra-Gries sketch (Spark's mergeable frequent-items sketch) over the digests of all rows proposes the few digests
that many rows share. Their exact sizes and winners are counted with map-side combination, broadcast, and applied
where the rows lie, so a group that holds a third of the corpus never meets in one task. All other digests take the
ordinary shuffle. Whether a digest is proposed changes the route of its rows only, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import keyed_text, stored

#: Digests that can be broadcast (about 100 bytes each), counters of a sketch, and the least rows of a heavy digest.
MOST_HEAVY, COUNTERS, LEAST_ROWS = 1000, 8192, 64
SPACE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of a text without ASCII white space."""
    return F.unhex(F.sha2(F.translate(text, SPACE, "").cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars, row_no); n_chars in code points of the whole text."""
    rows = keyed_text(docs, id_col, text_col)
    return rows.select(
        "doc_id",
        digest(F.col("text")).alias("digest"),
        F.char_length("text").alias("n_chars"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def heavy_candidates(rows: DataFrame, most: int = MOST_HEAVY, counters: int = COUNTERS, least: int = LEAST_ROWS) -> DataFrame:
    """(digest_key): at most `most` 64-bit keys that the merged Misra-Gries sketches estimate at `least` rows or more."""
    parts = rows.select(F.xxhash64("digest").alias("k"), (F.spark_partition_id() % 64).alias("part"))
    sketches = parts.groupBy("part").agg(F.expr(f"approx_top_k_accumulate(k, {counters})").alias("s"))
    # a grouped aggregate: Spark's combine fails on the empty buffer that a global one takes from an empty partition
    merged = sketches.groupBy(F.col("part") < 0).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s"))
    top = merged.select(F.explode(F.expr(f"approx_top_k_estimate(s, {most})")).alias("top"))
    return top.where(F.col("top.count") >= least).select(F.col("top.item").alias("digest_key"))


def winners(rows: DataFrame, candidates: DataFrame | None = None, least: int = LEAST_ROWS) -> DataFrame:
    """(digest, group_size, keep_id, keep_row) of candidates, or of all digests, with exact sizes; smaller groups are left out.

    Sizes and winners are combined in each task before they are shuffled, so a group of any size is a row for each task.
    """
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("less_id"), (-F.col("row_no")).alias("less_row")))
    if candidates is not None:
        rows = rows.join(F.broadcast(candidates), F.xxhash64("digest") == F.col("digest_key"), "left_semi")
    found = rows.groupBy("digest").agg(F.count("*").alias("group_size"), best.alias("best")).where(F.col("group_size") >= least)
    return found.select("digest", "group_size", (-F.col("best.less_id")).alias("keep_id"), (-F.col("best.less_row")).alias("keep_row"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts agree after all of [\\x20\\x09-\\x0D] is deleted; the one with the most code points,
    then the smallest doc_id stays. A null text counts as empty, so null, empty and blank texts form one group. A null
    doc_id loses against any other. Of rows that repeat in full, exactly one is kept. An empty table gives no rows.
    Only the id and text columns are read, so others may have any names. Of a very long text only its digest and length
    go on.
    """
    rows = stored(digests(docs, id_col, text_col), "digests")
    heavy = stored(winners(rows, heavy_candidates(rows)), "heavy")  # at most MOST_HEAVY rows
    others = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")

    def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, "digest").select("doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "digest")

    by_map, by_shuffle = judged(rows, F.broadcast(heavy)), judged(others, winners(others, least=1))
    return by_map.unionByName(by_shuffle).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that exact_dedup keeps: one of each group of equal texts.

    Rows that repeat an id and an equal text are one row, and any of them may stand for it.
    """

    def key(id_column: Column, digest_column: Column) -> Column:
        return F.concat(F.coalesce(id_column.cast("long").cast("string"), F.lit("-")).cast("binary"), digest_column)

    kept = exact_dedup(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.unhex("text_sha256")).alias("key"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), key(F.col(id_col), digest(F.coalesce(F.col(text_col), F.lit("")))).alias("key"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  sha256(regexp_replace(coalesce(text, ''), '[ \\t-\\r]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id,
  count(*) OVER (PARTITION BY h) AS group_size FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, h AS text_sha256 FROM r
"""
