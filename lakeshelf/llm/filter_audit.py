"""How filters of a corpus interact: what each removes in every order of application.

All orders form a trie whose node is a prefix of filters. Survivors of a prefix don't depend on its order, so the trie
is walked depth first with a memory of unordered prefixes: each set of filters has one survivor table, made by applying
one more filter to the survivors of its parent, persisted and used by all orders that pass it. What an edge removes is
counted on the survivors above it. With n filters there are 2^n tables and n 2^(n-1) edges in place of n! orders.
Survivors carry ids and outcomes, not texts: every text is read and judged once, and the outcomes are written to the
shared folder, from which a lost executor's survivors are filtered anew.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeshelf.llm.common import split_join, stored

#: Failure conditions, as a rule of the registered query (fixed values).
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SIGNS = 200, 50, 2, "[#$%&*|]"
SPACE = " \t\n\x0b\x0c\r"
#: The number of orders grows with the factorial, and each is a row of the result.
MOST_FILTERS = 7


def measures(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """rows with n_words, n_distinct, n_capitals and n_points of a text that is not null, in place of it, each counted once."""
    inner = F.btrim(F.col(text_col), F.lit(SPACE))
    counts = {"n_capitals": F.regexp_count(text_col, F.lit("[A-Z]")), "n_points": F.char_length(text_col), "signs": F.col(text_col).rlike(SIGNS)}
    words = rows.withColumns({**counts, "words": F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))}).drop(text_col)
    return words.withColumns({"n_words": F.size("words"), "n_distinct": F.size(F.array_distinct("words"))}).drop("words")


def text_filters() -> dict[str, Column]:
    """Failure conditions by `measures`: few words, few distinct ones, many capitals, signs of markup."""
    n_words, n_distinct, n_capitals, n_points = (F.col(c).cast("long") for c in ("n_words", "n_distinct", "n_capitals", "n_points"))
    return {"A": n_words < LEAST_WORDS, "B": 100 * n_distinct < LEAST_DISTINCT * n_words, "C": 100 * n_capitals > MOST_CAPITALS * n_points, "D": F.col("signs")}


def repeats(rows: DataFrame) -> DataFrame:
    """rows (doc_id, digest, ...) with `fails_E` in place of digest: an equal digest has a smaller doc_id."""
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    found = split_join(rows, stored(first, "repeated"), "digest", "n", "left")
    return found.withColumn("fails_E", F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))).drop("digest", "first_id")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, fails_A to fails_E, good, toxic) for each row of docs."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), part)
    rows = measures(rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))
    rows = repeats(stored(rows.select("doc_id", "part", "digest", *[c.alias(f"fails_{f}") for f, c in text_filters().items()]), "judged"))
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*marks)
    named = rows.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").fillna(False, ["good", "toxic"])
    return named.unionByName(rows.where("doc_id IS NULL").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def survivor_tables(rows: DataFrame, names: str) -> dict[frozenset, DataFrame]:
    """The survivors of each set of filters, each made once from those of a set with one filter less; all but the first are persisted."""
    tables: dict[frozenset, DataFrame] = {}

    def descend(prefix: frozenset, survivors: DataFrame) -> None:
        tables[prefix] = survivors
        for name in names:
            longer = prefix | {name}
            if longer not in tables:
                descend(longer, survivors.where(f"NOT fails_{name}").persist(StorageLevel.MEMORY_AND_DISK))

    descend(frozenset(), rows)
    return tables


def edges(tables: dict[frozenset, DataFrame], names: str) -> DataFrame:
    """(part, before, filter, kept, removed, good_lost, toxic_lost) for every edge of the trie and every part, zeros included.

    before has the names of the filters applied so far, sorted. Parts without survivors have rows of zeros.
    """
    counts, every = [F.count("*").alias("n")], None
    for f in names:
        counts += [F.count_if(f"fails_{f}").alias(f"removed_{f}"), F.count_if(F.expr(f"fails_{f} AND good")).alias(f"good_{f}"), F.count_if(F.expr(f"fails_{f} AND toxic")).alias(f"toxic_{f}")]
    for prefix, survivors in tables.items():
        rows = survivors.withColumn("before", F.lit("".join(sorted(prefix))))
        every = rows if every is None else every.unionByName(rows)
    found = stored(every.groupBy("part", "before").agg(*counts), "counts")
    prefixes = F.array(*[F.lit("".join(sorted(p))) for p in tables])
    full = found.where("before = ''").select("part", F.explode(prefixes).alias("before")).join(found, ["part", "before"], "left").fillna(0)
    steps = [F.struct(F.lit(f).alias("filter"), *[F.col(f"{c}_{f}").alias(a) for c, a in (("removed", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]) for f in names]
    out = full.select("part", "before", "n", F.explode(F.array(*steps)).alias("e")).select("part", "before", "n", "e.*")
    return out.where(~F.col("before").contains(F.col("filter"))).withColumn("kept", F.col("n") - F.col("removed")).drop("n")


def audit(rows: DataFrame, names: str = "ABCDE") -> DataFrame:
    """One row per part, order of the filters and step, for rows (part, good, toxic, fails_<name>...) as `judged` gives them.

    Columns: part, filter_order, step, and of the step's filter kept, removed, redundant (rows that fail it and had
    gone before), unique_fails (rows that fail only it), good_lost, toxic_lost, and shapley, its removals summed over
    all orders. Null and empty texts count as empty and are judged as such; a null source is the part ''. Rows are
    counted as often as they occur, and rows that repeat an id and a text don't fail E for each other. A null id is
    never a repeat and has no labels; several labels of an id count as one that has whatever any of them has. Very long
    texts are split once, whole. Ties can't arise, an empty table gives no rows, and other columns aren't read.
    """
    if len(names) > MOST_FILTERS or len(set(names)) < len(names):
        raise ValueError(f"at most {MOST_FILTERS} different filters")
    spark, n = rows.sparkSession, len(names)
    tables = survivor_tables(stored(rows, "outcomes"), names)
    found = stored(edges(tables, names), "edges")
    for survivors in tables.values():
        survivors.unpersist()
    size = F.char_length("before")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), size + 1)
    sums = found.groupBy("part", "filter").agg(
        F.sum(weight * F.col("removed")).alias("shapley"),
        F.max(F.when(size == 0, F.col("removed"))).alias("failing"),
        F.max(F.when(size == n - 1, F.col("removed"))).alias("unique_fails"),
    )
    orders = [("".join(p), k + 1, "".join(sorted(p[:k])), p[k]) for p in permutations(names) for k in range(n)]
    orders = spark.createDataFrame(orders, "filter_order string, step int, before string, filter string")
    out = found.join(sums, ["part", "filter"]).join(F.broadcast(orders), ["before", "filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS caps,
  min(doc_id) OVER (PARTITION BY t) AS least FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  concat(CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * list_unique(ws) < 50 * len(ws) THEN 'B' ELSE '' END,
    CASE WHEN 100 * caps > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN w.doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM v a, v b, v c, v d, v e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, CAST(k AS INTEGER) AS step, substr(filter_order, CAST(k AS INTEGER), 1) AS x, substr(filter_order, 1, CAST(k AS INTEGER) - 1) AS before
  FROM p, range(1, 6) AS r(k)),
r AS (SELECT part, filter_order, step, x, n, good, toxic, translate(fails, before, '') = fails AS here, contains(fails, x) AS failing, fails = x AS only_it FROM s, g),
c AS (SELECT part, filter_order, step, x, sum(CASE WHEN here AND NOT failing THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN here AND failing THEN n ELSE 0 END) AS removed, sum(CASE WHEN failing AND NOT here THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN only_it THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND failing THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN here AND failing THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, x)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM c
"""
