"""Secrets with corpus-wide ownership frequency, in SQL expressions only.

Three kinds of base match are found in every whole text, and besides them long mixed tokens as mere candidates. The
hashes of all candidate values are aggregated over the corpus by distinct repositories and owners. Values that several
owners have are widely copied examples, those that one owner has in many repositories are its own samples, and a value
of one owner in few repositories looks live. Mixed tokens that look live and that no base match covers are added as
spans of kind `owned`; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import stored
from lakeshelf.llm.spans import blocks, bound, spans

#: Kind: (a cheap test of the whole text, pattern, group that holds the candidate, its least length).
#: Where a match is one run of characters, its least length is in the pattern; for assign it can't be, as a short match
#: uses up its text.
KINDS = {
    "assign": (r"(?i)password|passwd|secret|token|api_?key", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA", r"AKIA[A-Z0-9]{12,}", 0, 16),
    "hex": (r"[0-9a-f]{32}", r"[0-9a-f]{32,}", 0, 32),
    "owned": (r"[A-Za-z0-9_+/=-]{20}", r"[A-Za-z0-9_+/=-]{20,}", 0, 20),
}
BASE = ("assign", "access", "hex")
#: Owners from which on a value counts as copied; repositories of one owner up to which it looks live; distinct
#: characters of a mixed token without small and capital letters, as words and counters run together have few.
COPIED_OWNERS, LIVE_REPOSITORIES, LEAST_CHARACTERS = 2, 20, 12

FOUND = "array<struct<start:bigint,rank:int,end:bigint,kind:string,h:bigint>>"


def varied(value: Column) -> Column:
    """Small and capital letters and digits, or many distinct characters, as random values have."""
    return (value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")) | (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_CHARACTERS)


def matches(text: Column) -> Column:
    """All matches of all kinds as FOUND, ordered by start and kind; h is the hash of the candidate value."""

    def of_kind(rank: int, kind: str) -> Column:
        test, pattern, group, least = KINDS[kind]
        found = F.filter(spans(text, pattern, group), lambda m: F.char_length(m["part"]) >= least)
        if kind == "owned":
            found = F.filter(found, lambda m: m["part"].rlike("[0-9]") & m["part"].rlike("[A-Za-z]") & varied(m["part"]))
        shaped = F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.xxhash64(m["part"]).alias("h")))
        return F.when(text.rlike(test), shaped).otherwise(F.array().cast(FOUND))

    return F.array_sort(F.concat(*(of_kind(rank, kind) for rank, kind in enumerate(KINDS))))


def without_covered(found: Column) -> Column:
    """Candidates that overlap no base match, and all base matches; found is ordered by start.

    A candidate is compared with the range of each block of base matches, and with the matches of those it touches.
    """

    def apart(base: Column) -> Column:
        ranged = F.transform(blocks(base), lambda b: F.struct(F.array_min(F.transform(b, lambda m: m["start"])).alias("start"), F.array_max(F.transform(b, lambda m: m["end"])).alias("end"), b.alias("all")))
        return bound(ranged, lambda parts: F.filter(found, lambda m: (m["kind"] != "owned") | ~F.exists(parts, lambda p: overlap(p, m) & F.exists(p["all"], lambda b: overlap(b, m)))))

    def overlap(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    return bound(F.filter(found, lambda m: m["kind"] != "owned"), lambda base: F.when(F.size(base) > 0, apart(base)).otherwise(found))


def ownership(rows: DataFrame) -> DataFrame:
    """(h, repositories, owners): distinct repositories and owners that have a candidate value, over rows (repo, owner, found)."""
    seen = rows.select("repo", "owner", F.explode(F.array_distinct(F.transform("found", lambda m: m["h"]))).alias("h"))
    by_owner = seen.groupBy("h", "owner").agg(F.count_distinct("repo").alias("n"))
    return by_owner.groupBy("h").agg(F.sum("n").alias("repositories"), F.count("owner").alias("owners"))


def shown(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda m: F.concat_ws(":", m["kind"], m["start"], m["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, found array<struct<start, rank, end, kind, h, repositories, owners>> by start, then kind.

    repo_col names the repository of a row (the id if None). Owners that are null own nothing: a value that only such
    rows have has 0 owners and counts as neither copied nor owned. Null and empty texts have no matches, repeated rows
    each get their row but count as one repository, an empty table gives no rows, and only the named columns are read.
    Positions are code points of the whole text, end exclusive. Equal matches at one place are ordered by kind. A very
    long text is scanned whole; its matches are one row.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.monotonically_increasing_id().alias("row_no"),
        F.col(repo_col or id_col).alias("repo"),
        F.col(owner_col).alias("owner"),
        bound(matches(F.coalesce(F.col(text_col), F.lit(""))), without_covered).alias("found"),
    )
    rows = stored(rows, "matches")
    some = rows.where(F.size("found") > 0)
    each = some.select("row_no", F.explode("found").alias("m")).withColumn("h", F.col("m.h"))
    judged = each.join(ownership(some), "h").select(
        "row_no", F.struct("m.start", "m.rank", "m.end", "m.kind", "h", F.col("repositories"), F.col("owners")).alias("m")
    )
    judged = judged.groupBy("row_no").agg(F.array_sort(F.collect_list("m")).alias("judged"))
    kind = judged.schema["judged"].dataType
    with_matches = some.select("doc_id", "row_no").join(judged, "row_no").select("doc_id", F.col("judged").alias("found"))
    return with_matches.unionByName(rows.where(F.size("found") == 0).select("doc_id", F.array().cast(kind).alias("found")))


def summary(scanned: DataFrame) -> DataFrame:
    """Counts and span lists of scanned rows; an `owned` candidate counts as a span only where it looks live."""

    def live(m: Column) -> Column:
        return (m["owners"] == 1) & (m["repositories"] <= LIVE_REPOSITORIES)

    found = F.filter("found", lambda m: (m["kind"] != "owned") | live(m))
    rows = scanned.select("doc_id", found.alias("found")).withColumn("base", F.filter("found", lambda m: m["kind"] != "owned"))

    def count(test) -> Column:
        return F.size(F.filter("found", test)).cast("long")

    return rows.select(
        "doc_id",
        *[F.size(F.array_remove(F.transform("found", lambda m: m["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS],
        count(lambda m: (m["kind"] != "owned") & live(m)).alias("n_live"),
        count(lambda m: (m["kind"] != "owned") & (m["owners"] == 1) & (m["repositories"] > LIVE_REPOSITORIES)).alias("n_samples"),
        count(lambda m: (m["kind"] != "owned") & (m["owners"] >= COPIED_OWNERS)).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("found", lambda m: m["repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )


def _sql() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT r, '{k}' AS kind, {rank} AS rank, {least} AS least, regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS c FROM d WHERE regexp_matches(t, '{test}')"
        for rank, (k, (test, p, group, least)) in enumerate((k, (a, b.replace("'", "''"), g, n)) for k, (a, b, g, n) in KINDS.items())
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({kinds}),
u AS (SELECT r, kind, rank, c[i] AS c, length(v[i]) AS n, least,
  list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS s
  FROM a, unnest(range(1, len(v) + 1)) AS q(i)),
m AS (SELECT r, kind, rank, c, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM u WHERE length(c) >= least
  AND (kind <> 'owned' OR (regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Za-z]') AND (regexp_matches(c, '[a-z]') AND regexp_matches(c, '[A-Z]') OR len(list_distinct(string_split(c, ''))) >= {LEAST_CHARACTERS})))),
k AS (SELECT * FROM m WHERE kind <> 'owned' OR NOT EXISTS (SELECT 1 FROM m b WHERE b.r = m.r AND b.kind <> 'owned' AND b.s < m.e AND m.s < b.e)),
o AS (SELECT c, source, count(DISTINCT doc_id) AS repos FROM k JOIN d USING (r) GROUP BY ALL),
f AS (SELECT c, count(source) AS owners, CAST(sum(repos) AS BIGINT) AS repositories FROM o GROUP BY c),
x AS (SELECT r, kind, rank, s, e, owners, repositories, owners = 1 AND repositories <= {LIVE_REPOSITORIES} AS live FROM k JOIN f USING (c) WHERE kind <> 'owned' OR (owners = 1 AND repositories <= {LIVE_REPOSITORIES})),
z AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  count(*) FILTER (kind = 'owned') AS n_owned, count(*) FILTER (kind <> 'owned' AND live) AS n_live, count(*) FILTER (kind <> 'owned' AND owners = 1 AND NOT live) AS n_samples, max(repositories) AS most_repositories, count(*) FILTER (kind <> 'owned' AND owners >= {COPIED_OWNERS}) AS n_copied,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (kind <> 'owned') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_owned, 0) AS n_owned,
  coalesce(n_live, 0) AS n_live, coalesce(n_samples, 0) AS n_samples, coalesce(most_repositories, 0) AS most_repositories, coalesce(n_copied, 0) AS n_copied, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z USING (r)
"""


ORACLE_SQL = _sql()
