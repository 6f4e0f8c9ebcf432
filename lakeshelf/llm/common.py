"""What the corpus operators share: inputs, shared tables and shipping of code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id, text), null texts as empty: other columns can't clash with an operator's own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where none is set, a session in one process gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="lakeshelf-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage and survives lost executors. `remove_stored` deletes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeshelf/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_stored(spark: SparkSession) -> None:
    """Delete all that `stored` has written in this session's shared folder; for when no DataFrame of it is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lakeshelf")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of rows that go to a Python worker at once; it bounds what the JVM and the worker hold beside their own state.
MOST_BATCH = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, and make this package importable in workers that don't have it on their path."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(setting) == "67108864b":  # Spark's own value; any other was chosen
        spark.conf.set(setting, str(MOST_BATCH))
    context = spark.sparkContext
    if getattr(context, "_lakeshelf_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lakeshelf-code-"), "lakeshelf.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("lakeshelf", os.path.relpath(full, top)))
    context.addPyFile(path)
    context._lakeshelf_shipped = True


def held_out(id_column: Column) -> Column:
    """The fold that no model may learn from."""
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def least_hash(most: int, count: int) -> int:
    """The bound below which about `most` of `count` evenly spread values of 62 bits lie; never 0."""
    return (1 << 62) if count <= most else max(1, (most << 62) // count)


def hash_share(id_column: Column, salt: int, most: int, count: int) -> Column:
    """True for about `most` of `count` rows at most, by a hash of their id; a null id is hashed too."""
    return F.pmod(F.xxhash64(id_column, F.lit(salt)), F.lit(1 << 62)) < F.lit(least_hash(most, count))


#: Keys whose facts are broadcast by `split_join`; no other key holds more than this share of the weight.
MOST_HEAVY = 1000


def split_join(rows: DataFrame, facts: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """rows joined to facts, which have one row a key: facts of the MOST_HEAVY keys of the largest weight are broadcast, the others meet by a shuffle.

    Rows of a key that holds any share of the table stay where they lie; both inputs should be stored, as they are read
    twice. `weight` is dropped. how is inner or left, and says what becomes of rows without a fact.
    """
    heavy = stored(facts.orderBy(F.desc(weight), key).limit(MOST_HEAVY), "heavy")
    keys = F.broadcast(heavy.select(key))
    light = facts.join(keys, key, "left_anti").drop(weight)
    return rows.join(F.broadcast(heavy.drop(weight)), key).unionByName(rows.join(keys, key, "left_anti").join(light, key, how))
