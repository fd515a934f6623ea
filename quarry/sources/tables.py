"""Tables in the shared folder: versions with a pointer, append-only logs, content-keyed caches."""

from __future__ import annotations

import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Rows of a file of an intermediate table at least, where their number is known.
ROWS_PER_FILE = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors reach: ``spark.checkpoint.dir``.  Where that is unset, a local run gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")


def scratch(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_folder(spark)}/quarry-{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: its lineage is cut, and a lost executor costs nothing.

    ``rows``: a bound of its rows, if one is known; a file then gets a quarter of a million of them, so that small tables aren't
    dealt out over hundreds of files.  The folder goes when the driver ends, or before by ``remove``.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_PER_FILE)))).write.parquet(path)
    fs, folder = hadoop(spark, path)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def united(*frames: DataFrame) -> DataFrame:
    """The rows of some frames, by name.

    Spark 4.1 takes a union of frames that are partitioned alike for partitioned too, while adaptive execution may join the partitions
    of each in another way: a later aggregate then misses rows of its key.  So this inference is switched off in the session.
    """
    frames[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    return reduce(DataFrame.unionByName, frames)


def remove(*frames: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if "/quarry-" in folder:
                fs, path = hadoop(df.sparkSession, folder)
                fs.delete(path, True)


def hadoop(spark: SparkSession, path: str):
    """The file system of a path and the path, as Spark's own classes see them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; null if it isn't there."""
    if not exists(spark, path):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file, under a temporary name first and then renamed over the old one, so that readers find one or the other."""
    jvm = spark.sparkContext._jvm
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    fs, source = hadoop(spark, temporary)
    out = fs.create(source, True)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(source, target, options)


def publish(df: DataFrame, table: str) -> str:
    """Write a new version and point to it; readers of the old one keep it.  An empty version is never published."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{version}")
    if not spark.read.parquet(f"{table}/{version}").limit(1).count():
        raise ValueError(f"{table}: an empty version is not published")
    write_small(spark, f"{table}/CURRENT.json", json.dumps({"version": version}, sort_keys=True))
    return version


def current(spark: SparkSession, table: str) -> DataFrame | None:
    pointer = read_text(spark, f"{table}/CURRENT.json")
    return None if pointer is None else spark.read.parquet(f"{table}/{json.loads(pointer)['version']}")


def append_log(df: DataFrame, path: str) -> None:
    """Append rows with a sequence that goes on where the log's ends; nothing written is changed."""
    spark = df.sparkSession
    start = 0
    if exists(spark, path):
        start = (spark.read.parquet(path).agg(F.max("seq")).first()[0] or 0) + 1
    df.withColumn("seq", F.monotonically_increasing_id() + F.lit(start)).write.mode("append").parquet(path)


def missing(wanted: DataFrame, cache: DataFrame | None, keys: list[str]) -> DataFrame:
    """What a cache hasn't got yet."""
    return wanted if cache is None else wanted.join(cache.select(*keys), keys, "left_anti")


def content_key(*parts) -> F.Column:
    return F.substring(F.sha2(F.concat(*[F.concat(p.cast("string").cast("binary"), F.lit(b"\x00")) for p in parts]), 256), 1, 32)


def with_cache(wanted: DataFrame, path: str, compute, keys: list[str]) -> DataFrame:
    """Compute what the cache at ``path`` lacks, append it, and return the wanted rows from the cache."""
    spark = wanted.sparkSession
    cache = spark.read.parquet(path) if exists(spark, path) else None
    new = missing(wanted.dropDuplicates(keys), cache, keys)
    compute(new).write.mode("append").parquet(path)
    return wanted.select(*keys).join(spark.read.parquet(path), keys)


def changed(fetched: DataFrame, state: DataFrame | None) -> DataFrame:
    """Sources whose content differs from the recorded digest: ``fetched`` (name, content), ``state`` (name, sha256)."""
    now = fetched.withColumn("sha256", F.sha2("content", 256))
    if state is None:
        return now.withColumn("changed", F.lit(True))
    old = state.select("name", F.col("sha256").alias("old_"))
    return now.join(old, "name", "left").withColumn("changed", ~F.col("sha256").eqNullSafe(F.col("old_"))).drop("old_")


def to_prune(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that no entry of the manifest names."""
    return listed.join(manifest.select("filename"), "filename", "left_anti")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
