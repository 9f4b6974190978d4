"""Sources with fixed schemas: nothing is inferred, bad records are counted, not guessed."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.integrity import bad_values, conform, require, require_columns

#: The columns a message table must have.
MESSAGE_COLUMNS = ["tweet_id", "author_id", "inbound", "created_at", "text", "response_tweet_id", "in_response_to_tweet_id"]


def strings(names: list[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_csv_strings(spark: SparkSession, path: str, names: list[str], exact: bool = False, breaks: bool = True) -> DataFrame:
    """A CSV with a header, every field as text, quotes doubled, line breaks inside quotes allowed.

    The header is checked: all of `names` must be there, or exactly these in this order. Bytes that aren't UTF-8 are
    replaced by U+FFFD. A file with line breaks inside quotes is one task; without them (`breaks` false) files are split.
    """
    head = spark.read.option("header", True).option("multiLine", breaks).option("escape", '"').csv(path)
    require_columns(head, names, exact)
    return spark.read.schema(strings(head.columns)).option("header", True).option("multiLine", breaks).option("escape", '"').option("mode", "PERMISSIVE").csv(path).select(*names)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of messages; `inbound` is 1 or 0 from true and false, null for anything else."""
    from ..functions.text import parse_bool

    return read_csv_strings(spark, path, MESSAGE_COLUMNS).withColumn("inbound", parse_bool(F.col("inbound")).cast("int"))


def read_typed_csv(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """A CSV read as text and cast afterwards; if strict, a value that can't be cast raises an error naming its column."""
    raw = read_csv_strings(spark, path, schema.fieldNames(), exact=True)
    if strict:
        require(bad_values(raw, schema).withColumnRenamed("column", "rule"))
    return conform(raw, schema)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, optional: list[str] | None = None) -> DataFrame:
    """Parquet with only the named columns and those of `optional` that exist; the scan reads no others."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*columns, *[c for c in optional or [] if c in df.columns])


def read_json_records(spark: SparkSession, path: str, record: StructType, field: str = "records") -> DataFrame:
    """One JSON document that holds an array of records."""
    from pyspark.sql.types import ArrayType

    doc = StructType([StructField(field, ArrayType(record))])
    return spark.read.schema(doc).option("multiLine", True).json(path).select(F.explode(field).alias("r")).select("r.*")


def read_jsonl_latest(spark: SparkSession, path: str, schema: StructType, key: str) -> DataFrame:
    """JSON lines, blank ones skipped; of equal keys the one that comes last in the file is kept."""
    raw = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r"), F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("p"))
    best = raw.groupBy(F.col(f"r.{key}").alias("_k")).agg(F.max_by("r", F.struct("f", "p")).alias("r"))
    return best.select("r.*")


def read_vectors(spark: SparkSession, path: str, vector: str, dimensions: int) -> DataFrame:
    """Parquet with a vector column; rows of another length raise an error."""
    df = spark.read.parquet(path)
    if df.where(F.coalesce(F.size(vector) != dimensions, F.lit(True))).take(1):
        raise ValueError(f"{vector} isn't of {dimensions} dimensions everywhere")
    return df


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256, pointer) of files; a pointer is a short text that stands for a file kept elsewhere."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return f.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.coalesce(F.substring(F.decode(F.substring("content", 1, 40), "utf-8"), 1, 40).startswith("version https://git-lfs"), F.lit(False)).alias("pointer"))


def verify_manifest(files: DataFrame, manifest: DataFrame, root: str) -> DataFrame:
    """(path, problem) for manifest rows (path, size_bytes, sha256): escapes, repeats, absence, size, hash, pointers."""
    f = files.select(F.regexp_replace("path", r"^(file:)?/*\Q" + root.strip("/") + r"\E/", "").alias("path"), F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"), (F.col("pointer") if "pointer" in files.columns else F.lit(False)).alias("_pointer"))
    m = manifest.withColumn("_n", F.expr("count(*) over (partition by path)")).join(f, "path", "left")
    p = F.array_compact(F.array(
        F.when(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/"), "path escapes the root"), F.when(F.col("_n") > 1, "listed twice"), F.when(F.col("_size").isNull(), "missing"),
        F.when(F.col("_size") != F.col("size_bytes"), "other size"), F.when(F.col("_sha") != F.lower("sha256"), "other content"), F.when(F.col("_pointer"), "a pointer, not the file"),
    ))
    return m.select("path", F.explode(p).alias("problem")).distinct()


def read_taxonomy(spark: SparkSession, path: str, required: list[str], low: int = 8, high: int = 15) -> DataFrame:
    """A JSON taxonomy {status, intents: [...]}: approved, of allowed length, with required keys and unique names, in order."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    items = doc.get("intents", [])
    if doc.get("status") != "approved":
        raise ValueError("the taxonomy isn't approved")
    if not low <= len(items) <= high:
        raise ValueError(f"{len(items)} items; {low} to {high} are allowed")
    if bad := [i for i, x in enumerate(items) if any(not x.get(k) for k in required)]:
        raise ValueError(f"items without required keys: {bad}")
    if len({x["name"] for x in items}) != len(items):
        raise ValueError("names are not unique")
    return spark.createDataFrame([(i, x["name"], x.get("description", "")) for i, x in enumerate(items)], "ord int, name string, description string")
