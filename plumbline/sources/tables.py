"""Reading and writing: the driver tables, line-delimited JSON, CSV, text corpora; appends, upserts and idempotent overwrites."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: What readers of spreadsheets take for a missing value.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zoned(df: DataFrame) -> DataFrame:
    """Timestamps without a zone as instants in the session's zone, as streams and watermarks need them."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)})


def without_nan(df: DataFrame) -> DataFrame:
    """NaN as null, in all float columns; infinities stay."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.FloatType | T.DoubleType)})


def read_jsonl(spark: SparkSession, path: str, schema: str, since: Column | None = None, rescued: str | None = None) -> DataFrame:
    """Line-delimited JSON of a schema; broken lines (a torn last one, say) are left out, or kept with their text in a column of the name `rescued`, and only rows of `since` stay."""
    bad = "_corrupt_record"
    df = spark.read.schema(f"{schema}, {bad} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).json(path)
    df = df.withColumnRenamed(bad, rescued) if rescued else df.where(F.col(bad).isNull()).drop(bad)
    return df if since is None else df.where(since)


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """CSV with a header; the strings that spreadsheets use for missing values become null."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = df.withColumns({f.name: F.when(~F.col(f.name).isin(NA_STRINGS), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.StringType)})
    return df.select(*columns) if columns else df


def read_corpus(spark: SparkSession, root: str, patterns: str = "*.{md,txt}") -> DataFrame:
    """(source, text) of all text files below root."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", patterns).text(root, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))


def listing(spark: SparkSession, root: str, patterns: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files below root, without their content; order by modified for the newest first."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", patterns).load(root)
    return df.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def front_matter(text: Column) -> Column:
    """The "key: value" lines between two lines of three dashes at the head of a text, as a map; an empty map where there are none."""
    head = F.regexp_extract(F.regexp_replace(text, "\r\n", "\n"), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z0-9_-]+):", 1).alias("key"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[A-Za-z0-9_-]+:", "")), "^[\"']|[\"']$", "").alias("value")))
    return F.map_from_entries(F.array_sort(F.array_distinct(pairs)))


def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """old with the rows of new put in their place by key. Of several new rows of a key the one of greatest `order` counts; an old row isn't replaced by one of a smaller `order`."""
    if order:
        new = new.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))).where("_k = 1").drop("_k")
    cols = old.columns
    both = old.select(*keys, F.struct(*cols).alias("_old")).join(new.select(*keys, F.struct(*cols).alias("_new")), keys, "full_outer")
    newer = F.col("_old").isNull() | (F.col("_new").isNotNull() & (F.coalesce(F.col(f"_new.{order}") >= F.col(f"_old.{order}"), F.lit(True)) if order else F.lit(True)))
    return both.select(F.when(newer, F.col("_new")).otherwise(F.col("_old")).alias("_row")).select("_row.*")


def overwrite_window(df: DataFrame, path: str, partition: str) -> None:
    """Replaces exactly the partitions that df has rows of; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def merged_totals(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str], least: list[str] = (), greatest: list[str] = ()) -> DataFrame:
    """A materialised aggregate brought up to date by the aggregate of what is new: sums and counts add, extremes meet. The table itself isn't read again."""
    both = old.unionByName(new)
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in greatest])


def compacted(df: DataFrame, files: int, order: list[str]) -> DataFrame:
    """df in so many files, sorted within each, for readers that skip by statistics."""
    return df.repartitionByRange(files, *order).sortWithinPartitions(*order)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, a local master gets one of its own, and a cluster is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


#: Tables that cut_lineage made and that nothing has deleted yet.
_STEPS: dict[str, SparkSession] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: a lost executor costs nothing of it. What is still there when the driver's process ends is deleted then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/step-{uuid.uuid4().hex}"
    if not _STEPS:
        atexit.register(_sweep)
    _STEPS[path] = spark
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._plumbline_step = path
    return back


def drop_step(df: DataFrame) -> None:
    """Deletes a table of cut_lineage that nothing reads any more."""
    path = getattr(df, "_plumbline_step", None)
    spark = _STEPS.pop(path, None)
    if spark is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _sweep() -> None:
    for path, spark in list(_STEPS.items()):
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session is gone already
            return
