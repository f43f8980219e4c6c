"""Tables written to the folder that all executors share, and a cache that outlives a task."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own; a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, and a lost executor costs nothing of it.

    What is still there when the driver's process ends is deleted then; drop_written deletes a table earlier, once nothing reads it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _PATHS[path] = spark
    if len(_PATHS) == 1:
        atexit.register(_sweep)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._plumbline_path = path
    return back


#: Tables that written() made and that nothing has deleted yet.
_PATHS: dict[str, SparkSession] = {}


def written_now() -> set[str]:
    return set(_PATHS)


def drop_paths(paths: Iterable[str]) -> None:
    for path in list(paths):
        spark = _PATHS.pop(path, None)
        if spark is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_written(*tables: DataFrame) -> None:
    """Deletes what written() made, once nothing reads it any more."""
    drop_paths(t._plumbline_path for t in tables if getattr(t, "_plumbline_path", None))


def _sweep() -> None:
    for path in list(_PATHS):
        try:
            drop_paths([path])
        except Exception:  # the session is gone already
            return


def checked_id(df: DataFrame, id_col: str) -> str:
    """The type of the id column, which can be any that has an order and an Arrow form."""
    return df.schema[id_col].dataType.simpleString()


def process_cache() -> dict:
    """One dict for each Python process; workers are reused, so models and vocabularies load once."""
    return sys.__dict__.setdefault("_plumbline_cache", {})


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that df doesn't have yet, each starting with a wanted name (compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def meeting_cells(keyed: DataFrame, keys: list[str], id_col: str, most: int, part: str | None = None) -> DataFrame:
    """keyed with a column cell, repartitioned and sorted by keys and cell, so that any two rows of equal keys are in one cell and a cell has about 2 * most rows at most.

    A key with more than `most` rows is cut into parts by the hash of the id; a row of part p goes to the cells (p, q) of all parts q.
    A cell is the number min(p, q) * 2^32 + max(p, q); where a name is given as part, that column keeps p."""
    from pyspark.sql import functions as F

    large = keyed.groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.ceil(F.col("count") / most).cast("int").alias("parts"))
    p = F.expr(f"CASE WHEN parts IS NULL THEN 0 ELSE pmod(xxhash64({id_col}), parts) END").cast("int")
    cells = F.expr("CASE WHEN parts IS NULL THEN array(0L) ELSE transform(sequence(0, parts - 1), q -> least(p, q) * 4294967296L + greatest(p, q)) END")
    out = keyed.join(large, keys, "left").withColumn("p", p).withColumn("cell", F.explode(cells)).drop("parts")
    out = out.withColumnRenamed("p", part) if part else out.drop("p")
    return out.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", id_col)
