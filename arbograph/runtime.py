"""Session helpers shared by all operators: table access, scratch space, id predicates, joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: What counts as a blank at either end of an id.
BLANKS = " \t\n\r\f\u000b\u00a0"
#: Keys of a split join that are broadcast, however many rows each has.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_id(col: Column) -> Column:
    """True for an id that is neither null nor blank, else false (never null)."""
    return F.coalesce(F.length(F.btrim(col, F.lit(BLANKS))) > 0, F.lit(False))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where that is unset, a local master gets an own one; a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(spark.sparkContext, "_arbograph_scratch", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="arbograph-")
        spark.sparkContext._arbograph_scratch = root
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; release() removes what was written to it."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_arbograph_paths", []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes what operators wrote to the shared folder in this session so far, for when their results have been read or written; the number of folders.

    Operators cannot do so themselves, as their results are read later. A job that ends gives its folder back as a whole.
    """
    paths = spark.sparkContext.__dict__.pop("_arbograph_paths", [])
    delete(spark, *paths)
    return len(paths)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once to the shared folder and read back: lineage ends here and no executor's loss repeats the work before."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, label: str, count: Column) -> tuple[DataFrame, int]:
    """stored(), and how many of the rows fulfil a condition, counted while they are written."""
    seen = Observation(uuid.uuid4().hex)
    out = stored(df.observe(seen, F.count_if(count).alias("n")), label)
    return out, (seen.get or {}).get("n") or 0


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def delete(spark: SparkSession, *paths: str) -> None:
    """Removes folders; those that are not there are no error."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed(col: Column) -> tuple[Column, Column]:
    """128 bits of a value as two longs, by two differently salted 64-bit hashes; exact joins on it cost 16 bytes a side."""
    return F.xxhash64(col), F.xxhash64(F.lit(0x5BD1E995), col)


def digest(col: Column) -> Column:
    """128 bits of a text as one binary column, for joins in which only equality counts."""
    return F.unhex(F.md5(col))


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle that states its number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size_of(df: DataFrame) -> int:
    """The optimiser's bound on the bytes of df; of written tables it follows from the sizes of their files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def split_join(big: DataFrame, small: DataFrame, key: str, how: str = "inner", limit: int | None = None) -> DataFrame:
    """big joined with small (one row a key) on `key`, inner, left or left_semi, without a hot key's rows in one task.

    A small side within Spark's limit for broadcasts is left to Spark, which broadcasts it: then no row of big moves.
    Beyond it (or beyond `limit` bytes) the HOT_KEYS keys that most rows of big have are joined by a broadcast of their
    rows of small, HOT_KEYS at most whatever the data, and only the rows of other keys are shuffled.
    """
    spark = big.sparkSession
    if size_of(small) <= (int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()) if limit is None else limit):
        return big.join(small, key, how)
    top = big.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(HOT_KEYS).select(key)
    hot = F.broadcast(small.join(F.broadcast(top), key, "left_semi"))
    return big.join(F.broadcast(top), key, "left_semi").join(hot, key, how).unionByName(big.join(F.broadcast(top), key, "left_anti").join(small, key, how))
