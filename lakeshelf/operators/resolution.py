"""Duplicates, versions, latest rows, merges of names, and matching of moved or renamed files."""

from __future__ import annotations

import difflib
import math
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeshelf.functions import scoring, text

STAGES = ["metadata-sanitize", "artist-intelligence", "metadata-enrich-online", "filename-normalize", "library-organize"]


def stage_rank(stage: Column) -> Column:
    rank = F.lit(-1)
    for k, name in enumerate(STAGES):
        rank = F.when(stage == name, k).otherwise(rank)
    return rank


def latest(rows: DataFrame, key: str, at: str, tie: str = "id") -> DataFrame:
    """The latest row of each key; of equal times the smallest tie. Done by max_by, so partial results are small."""
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col(at), -F.col(tie)))
    return rows.groupBy(key).agg(best.alias("__row")).select("__row.*")


def current_states(states: DataFrame) -> DataFrame:
    """Per track the row of the highest stage, then the latest, then the largest id; stale rows don't count."""
    order = F.struct(stage_rank(F.col("stage")), F.col("processed_at"), F.col("id"))
    best = F.max_by(F.struct(*states.columns), order)
    return states.where("status <> 'stale'").groupBy("track_id").agg(best.alias("__row")).select("__row.*")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, id) of every row whose keys another row has too: the counts of repeated keys, joined back to their rows."""
    several = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(several, list(keys)).select(*keys, "n", "id")


def exact_groups(files: DataFrame) -> DataFrame:
    """(content_hash, n, keep_id, bytes_to_free): groups of equal content; the largest, then smallest id stays."""
    keep = F.max_by("id", F.struct("size", -F.col("id")))
    groups = files.groupBy("content_hash").agg(F.count("*").alias("n"), keep.alias("keep_id"), (F.sum("size") - F.max("size")).alias("bytes_to_free"))
    return groups.where("n > 1")


def quality_groups(tracks: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(artist_key, base_key, version_key, n, keep_id): copies of one version; the best file, then the largest, stays.

    Groups whose known durations spread by more than the tolerance, or whose best is no better than the worst, are left
    out.
    """
    base, version = text.version_parts(F.coalesce("title", F.lit("")))
    rows = tracks.select("id", "duration_sec", "filesize_bytes", scoring.quality_points(F.col("filepath"), F.col("bitrate_kbps")).alias("points"),
        text.compare_name(F.col("artist")).alias("artist_key"), text.compare_name(base).alias("base_key"), text.compare_name(version).alias("version_key"))
    known = F.when(F.col("duration_sec") > 0, F.col("duration_sec"))
    groups = rows.where("artist_key <> '' AND base_key <> ''").groupBy("artist_key", "base_key", "version_key").agg(
        F.count("*").alias("n"), F.max_by("id", F.struct("points", "filesize_bytes", -F.col("id"))).alias("keep_id"),
        F.max("points").alias("best"), F.min("points").alias("worst"), (F.max(known) - F.min(known)).alias("spread"))
    return groups.where((F.col("n") > 1) & (F.col("best") > F.col("worst")) & (F.coalesce("spread", F.lit(0.0)) <= tolerance)).select("artist_key", "base_key", "version_key", "n", "keep_id")


def version_groups(tracks: DataFrame) -> DataFrame:
    """(artist_key, base_key, versions): titles with several versions."""
    base, version = text.version_parts(F.coalesce("title", F.lit("")))
    rows = tracks.select(text.compare_name(F.col("artist")).alias("artist_key"), text.compare_name(base).alias("base_key"), text.compare_name(version).alias("v"))
    return rows.where("artist_key <> '' AND base_key <> ''").groupBy("artist_key", "base_key").agg(F.count_distinct("v").alias("versions")).where("versions > 1")


def near_copies(tracks: DataFrame) -> DataFrame:
    """One track of each (primary artist, title without version): lossless first, then most complete, then shortest name, then id."""
    base, _ = text.version_parts(F.coalesce("title", F.lit("")))
    complete = sum((F.col(c).isNotNull().cast("int") for c in ("bpm", "key_camelot", "genre")), F.lit(0))
    lossless = text.extension(F.col("filepath")).isin("wav", "aiff", "aif", "flac").cast("int")
    order = F.struct(lossless, complete, -F.length("filepath"), -F.col("id"))
    return tracks.groupBy(text.primary_artist(F.col("artist")).alias("artist_key"), text.compare_name(base).alias("title_key")).agg(F.max_by("id", order).alias("id"), F.count("*").alias("n"))


def merge_groups(tracks: DataFrame) -> DataFrame:
    """(artist_key, spellings, n, canonical): spellings of one primary artist; the most frequent, not all capitals, is canonical."""
    counts = tracks.where(~text.is_unknown_artist(F.col("artist"))).groupBy(text.primary_artist(F.col("artist")).alias("artist_key"), "artist").agg(F.count("*").alias("files"))
    order = F.struct(-F.col("files"), (F.col("artist") == F.upper("artist")).cast("int"), (F.col("artist") == F.lower("artist")).cast("int"), F.col("artist"))
    return counts.groupBy("artist_key").agg(F.count("*").alias("spellings"), F.sum("files").alias("n"), F.min_by("artist", order).alias("canonical")).where("spellings > 1")


def label_rollup(tracks: DataFrame) -> DataFrame:
    """(label, n, bpm_min, bpm_max, genres) over positive rounded tempos."""
    bpm = F.when(F.col("bpm") > 0, F.floor(F.col("bpm") + 0.5))
    return tracks.groupBy(F.coalesce("artist", F.lit("")).alias("label")).agg(F.count("*").alias("n"), F.min(bpm).alias("bpm_min"), F.max(bpm).alias("bpm_max"), F.count_distinct("genre").alias("genres"))


def numbered_targets(rows: DataFrame, folder: Column, name: Column) -> DataFrame:
    """rows with `target`: (n) is added to the second and later of equal names in a folder, by id."""
    k = F.row_number().over(Window.partitionBy(folder, F.lower(name)).orderBy("id"))
    return rows.withColumn("target", F.concat(folder, F.lit("/"), name, F.when(k > 1, F.concat(F.lit(" ("), k - 1, F.lit(")"))).otherwise("")))


#: Rows of each side that one call compares; they bound its memory, not what is compared.
OLD_BLOCK, NEW_BLOCK = 1000, 10_000


def spread(rows: DataFrame, *keys: str, most: int | None = None) -> DataFrame:
    """rows in a few tasks for each core, for work that is large beside the bytes of its rows: readers and shuffles go by bytes."""
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(min(tasks, most or tasks), *keys)


def kept(rows: DataFrame) -> DataFrame:
    """rows computed once, in the shared checkpoint folder, so that lost executors don't lose them.

    Only a session that runs in this process alone gets a folder of its own where none is set.
    """
    spark = rows.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()


def block_matches(old: DataFrame, new: DataFrame, choose, k: int, order: list, by_path: bool = True, most_off: float | None = None) -> DataFrame:
    """(old_id, new_id, new_path, overlap, off, score, place): the k best new rows of each old row, of another path, places from 1.

    choose(overlap, off, same, score) gives the new rows that fit and their sort keys, the least first; `order` are the same
    keys as columns. Ties go by path and id, or by id only. A name without tokens overlaps with nothing. Where choose takes only
    rows of the same format whose size is off by less than `most_off` of the old one, only rows of one format and of the same or
    the next class of size meet.

    What a pair is worth depends on tokens, format and size only. So old rows of equal ones are compared once, and of equal new
    rows only the first count: 2k of them, k of a path, since one old path rules out k rows at most. The rest is exact:
    every class of old rows meets every new row left that may fit, both sides are dealt by hash into blocks, each pair of blocks is one
    call, and in it an inverted index counts the shared tokens, so that pairs never become rows and no token is too frequent.
    """
    keep = 2 * k

    def first(rows: DataFrame, keys: list[str], at: list, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*at))
        return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")

    def classed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"ext": text.extension(F.col("path")), "tokens": F.array_sort(text.audit_tokens(F.col("path")))})
        return rows.withColumn("class", F.to_json(F.struct("tokens", "ext", "size")))

    def named(rows: DataFrame) -> DataFrame:
        return rows.where("filepath IS NOT NULL").select("id", F.col("filepath").alias("path"), F.col("filesize_bytes").cast("double").alias("size"))

    tie = ["path", "id"] if by_path else ["id"]
    places = first(classed(first(named(new), ["path", "size"], ["id"], k)), ["class"], tie, keep)
    sought = classed(spread(named(old)))
    sides = {"old": sought.select("class", "tokens", "ext", "size").distinct(), "new": places}
    if most_off is None:
        sides = {name: rows.withColumn("meets", F.lit("")) for name, rows in sides.items()}
    else:
        near = F.floor(F.ln("size") / F.lit(-1.01 * math.log1p(-most_off)))  # a step beyond the tolerance, on either side
        for name, steps in (("old", (-1, 0, 1)), ("new", (0,))):
            sides[name] = sides[name].where("size > 0").withColumn("meets", F.explode(F.array(*[F.concat_ws("/", near + d, "ext") for d in steps])))
    largest = {name: rows.groupBy("meets").count().agg(F.max("count")).first()[0] or 0 for name, rows in sides.items()}
    counts = {"old": -(-largest["old"] // OLD_BLOCK) or 1, "new": -(-largest["new"] // NEW_BLOCK) or 1}

    def side(name: str, other: str) -> DataFrame:
        rows = sides[name].withColumns({c: F.lit(v) for c, v in (("id", 0), ("path", "")) if name == "old"})
        own = F.pmod(F.xxhash64("class", "path", "id"), F.lit(counts[name])).cast("int")
        rows = rows.select("class", "id", "path", "size", "ext", "tokens", "meets", F.lit(name == "old").alias("old"), own.alias(name[0]))
        return rows.withColumn(other[0], F.explode(F.sequence(F.lit(0), F.lit(counts[other] - 1))))

    def preferred(some: np.ndarray, keys: list[np.ndarray], owner: np.ndarray) -> list[int]:
        """The first `keep` of some rows, which are in order of ties, at most k of an owner."""
        most = 2 * keep
        while True:
            part = np.arange(len(some))
            if len(some) > most:
                part = np.flatnonzero(keys[0] <= np.partition(keys[0], most - 1)[most - 1])
            met, out = {}, []
            for i in some[part[np.lexsort([key[part] for key in reversed(keys)])]]:
                if met.setdefault(owner[i], 0) < k:
                    met[owner[i]] += 1
                    out.append(i)
                    if len(out) == keep:
                        return out
            if len(part) == len(some):
                return out
            most *= 4

    def compare(both: pd.DataFrame) -> pd.DataFrame:
        o, n = both[both["old"]], both[~both["old"]]
        n = n.sort_values(tie).reset_index(drop=True)
        ids, paths, sizes, kinds = (n[c].to_numpy() for c in ("id", "path", "size", "ext"))
        owner = pd.factorize(paths)[0]
        at: dict[str, list[int]] = {}
        for row, tokens in enumerate(n["tokens"]):
            for t in tokens:
                at.setdefault(t, []).append(row)
        index = {t: np.array(rows) for t, rows in at.items()}
        same_kind = {x: kinds == x for x in set(kinds)}
        none, out = np.zeros(len(n), bool), []
        for name, size, kind, tokens in zip(o["class"], o["size"], o["ext"], o["tokens"], strict=True):
            shared = np.zeros(len(n))
            for t in tokens:
                if t in index:
                    shared[index[t]] += 1
            overlap, same = shared / max(1, len(tokens)), same_kind.get(kind, none)
            off = np.abs(size - sizes) / size if size > 0 else np.full(len(n), np.nan)
            score = 0.6 * overlap + 0.3 * np.maximum(0.0, 1 - np.where(np.isnan(off), 1.0, off)) + np.where(same, 0.1, 0.0)
            some, keys = choose(overlap, off, same, score)
            best = preferred(some, [key[some] for key in keys], owner)
            if best:
                out.append(([name] * len(best), ids[best], paths[best], overlap[best], off[best], score[best]))
        columns = ["class", "new_id", "new_path", "overlap", "off", "score"]
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*out, strict=True), strict=True)}) if out else pd.DataFrame(columns=columns)

    most = 4 * counts["old"] * counts["new"] if most_off is None else None
    blocks = spread(side("old", "new").unionByName(side("new", "old")), "meets", "o", "n", most=most)
    found = blocks.groupBy("meets", "o", "n").applyInPandas(compare, "class string, new_id long, new_path string, overlap double, off double, score double")
    ranked = [*order, *[f"new_{c}" for c in tie]]
    found = first(first(found, ["class", "new_path"], ranked, k), ["class"], ranked, keep)
    rows = sought.select(F.col("id").alias("old_id"), F.col("path").alias("__path"), "class").join(found, "class").where("new_path <> __path").drop("class", "__path")
    place = F.row_number().over(Window.partitionBy("old_id").orderBy(*ranked))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def moved_candidates(old: DataFrame, new: DataFrame, k: int = 5) -> DataFrame:
    """The k best new places of each old file that score above 0: 0.6 overlap + 0.3 size + 0.1 format, to six digits; ties by path."""
    score = F.round("score", 6)

    def best(overlap, off, same, score):
        score = np.round(score, 6)
        return np.flatnonzero(score > 0), [-score]

    return block_matches(old, new, best, k, [-score]).select("old_id", "new_id", "overlap", score.alias("score"), "place")


def best_overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, overlap): the largest share of each old name's tokens that a new name of the same format has; rows without any are left out."""

    def best(overlap, off, same, score):
        return np.flatnonzero(same & (overlap > 0)), [-overlap]

    return block_matches(old, new, best, 1, [-F.col("overlap")]).select("old_id", "overlap")


def relocations(old: DataFrame, new: DataFrame, least: float = 0.7, most_off: float = 0.1) -> DataFrame:
    """The best new place of each old file: same format, nearly the same size, enough tokens in common."""

    def best(overlap, off, same, score):
        return np.flatnonzero(same & (off < most_off) & (overlap >= least)), [-overlap, off]

    return block_matches(old, new, best, 1, [-F.col("overlap"), F.col("off")], by_path=False, most_off=most_off).select("old_id", "new_id", "overlap", "off")




def common_length(codes: np.ndarray, starts: np.ndarray, length: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The longest common subsequences of pairs of texts (numbers into starts and length), all pairs at a time."""
    wide = int(max(length[one].max(initial=0), length[other].max(initial=0)))

    def letters(which: np.ndarray, pad: int) -> np.ndarray:
        at = starts[which][:, None] + np.arange(wide)
        return np.where(np.arange(wide) < length[which][:, None], codes[np.minimum(at, len(codes) - 1)].astype(np.int64), pad)

    a, b = letters(one, -1), letters(other, -2)
    best = np.zeros((len(one), wide + 1), np.int32)
    for k in range(wide):
        best[:, 1:] = np.maximum.accumulate(np.maximum(best[:, 1:], best[:, :-1] + (a[:, k : k + 1] == b)), axis=1)
    return best[:, -1]


def sequence_ratio(left: Column, right: Column, least: float = 0.0) -> Column:
    """The share of matching blocks of two texts, 0 if either is empty or it can't exceed `least`; it isn't an edit distance.

    No more characters can match than both texts have, character by character, nor than their longest common
    subsequence has; both bounds are taken for a whole batch at once, and only pairs beyond them are compared block by block.
    """

    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        place, texts = pd.factorize(pd.concat([a, b]))
        one, other = place.reshape(2, -1)
        length = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        letters, code = np.unique(codes, return_inverse=True)
        owner, sizes, out = np.repeat(np.arange(len(texts)), length), length[one] + length[other], np.zeros(len(a))
        bound = np.zeros(len(a), np.int64)
        for first in range(0, len(letters), 64):  # a few letters at a time
            some = (code >= first) & (code < first + 64)
            counts = np.bincount(owner[some] * 64 + code[some] - first, minlength=64 * len(texts)).reshape(-1, 64).astype(np.uint16)
            bound += np.minimum(counts[one], counts[other]).sum(axis=1, dtype=np.int64)
        open_ = np.flatnonzero((2 * bound > least * sizes) & (length[one] > 0) & (length[other] > 0))
        starts = np.cumsum(length) - length
        if least > 0 and len(open_):
            for part in np.array_split(open_, -(-len(open_) * int(length.max()) // 1_000_000)):
                bound[part] = common_length(codes, starts, length, one[part], other[part])
            open_ = open_[2 * bound[open_] > least * sizes[open_]]
        matcher, indexed = difflib.SequenceMatcher(None), -1
        for k in open_[np.argsort(other[open_], kind="stable")]:  # the matcher keeps an index of its second text
            if other[k] != indexed:
                indexed = other[k]
                matcher.set_seq2(texts[indexed])
            matcher.set_seq1(texts[one[k]])
            out[k] = matcher.ratio()
        return pd.Series(out)

    found = F.pandas_udf(ratio, "double")
    if least > 0:  # for a filter by the result, which must not be moved below a projection, where pairs would be compared once more
        found = found.asNondeterministic()
    return found(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))


#: Pairs of rows that one block and about one task expand.
BLOCK_PAIRS, TASK_PAIRS = 1 << 21, 1 << 24


def expanded(pairs: DataFrame, left: DataFrame, right: DataFrame, one: list[str], other: list[str]) -> DataFrame:
    """left and right joined by pairs of keys: pairs has the columns `one` and `other`, left has `one`, right has `other`.

    The rows of a key of right are dealt into blocks by how many rows of left meet them, and each task has about the
    same number of pairs to make: neither a frequent key nor small inputs of a large product end in one task.
    """
    met = pairs.join(left.groupBy(*one).agg(F.count("*").alias("__left")), one).groupBy(*other).agg(F.sum("__left").alias("__left"))
    load = met.join(right.groupBy(*other).agg(F.count("*").alias("__right")), other).select(*other, (F.col("__left") * F.col("__right")).alias("__pairs"))
    load = load.withColumn("__blocks", F.ceil(F.col("__pairs") / BLOCK_PAIRS).cast("int"))
    tasks = int((load.agg(F.sum("__pairs")).first()[0] or 0) // TASK_PAIRS) + 1
    keys = [*other, "__block"]
    where = F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))
    lefts = left.join(pairs, one).join(load, other).withColumn("__block", where).drop("__blocks", "__pairs", *[c for c in one if c not in other])
    rights = right.join(load, other).withColumn("__block", F.pmod(F.xxhash64(*right.columns, F.lit(7)), "__blocks").cast("int")).drop("__blocks", "__pairs")
    return lefts.repartition(tasks, *keys).join(rights.repartition(tasks, *keys), keys).drop("__block")

#: Parts of the old names of one class, which meet the new ones in tasks of their own.
NAME_PARTS = 16


def fuzzy_renames(old: DataFrame, new: DataFrame, least: float = 0.85, most_off: float = 0.05) -> DataFrame:
    """(old_id, new_id, similarity): same format, size within the tolerance, names alike; blocked by format and size class.

    Sizes within the tolerance lie in the same or the next class of a logarithmic scale of that step, so names meet on
    equal keys. Two names are compared once, however many files bear them, in all cores; the files of names that are alike follow.
    """
    step = F.lit(float(most_off) * 1.1)

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.where("filesize_bytes > 0").select(F.col("id").alias(f"{name}_id"), F.col("filepath").alias(f"{name}_path"), F.col("filesize_bytes").alias(f"{name}_size"), text.extension(F.col("filepath")).alias("ext"), F.floor(F.ln("filesize_bytes") / step).alias("size_class"), text.audit_name(F.col("filepath")).alias(f"{name}_name"))

    o, n = side(old, "old"), side(new, "new")
    near = F.array_distinct(F.flatten(F.collect_set(F.array(*[F.col("size_class") + d for d in (-1, 0, 1)]))))
    olds = o.groupBy("ext", "old_name").agg(near.alias("old_classes")).withColumn("size_class", F.explode("old_classes"))
    news = n.groupBy("ext", "new_name").agg(F.collect_set("size_class").alias("new_classes")).withColumn("size_class", F.explode("new_classes"))
    keys = ["ext", "size_class", "part"]
    olds = spread(olds.withColumn("part", F.pmod(F.xxhash64("old_name"), F.lit(NAME_PARTS)).cast("int")), *keys)
    news = spread(news.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(NAME_PARTS - 1)))), *keys)
    first = F.array_min(F.array_intersect("old_classes", "new_classes"))  # of the classes in which two names meet
    met = olds.join(news, keys).where(F.col("size_class") == first).select("ext", "old_name", "new_name")
    alike = met.withColumn("similarity", sequence_ratio(F.col("old_name"), F.col("new_name"), least)).where(F.col("similarity") > least)
    alike = kept(alike)  # it is read three times
    rows = expanded(alike, o.drop("size_class"), n.drop("size_class"), ["ext", "old_name"], ["ext", "new_name"])
    rows = rows.where((F.col("old_path") != F.col("new_path")) & (scoring.size_difference(F.col("old_size"), F.col("new_size")) < most_off))
    return rows.select("old_id", "new_id", "similarity")
