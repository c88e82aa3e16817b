"""Files as tables: task documents, GeoJSON, settings, templates; and tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a GeoJSON feature; coordinates stay JSON text, as their depth differs by type.
FEATURE = "struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>"


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_no, text): text files whose pages are parted by form feeds."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\f")).alias("page_no", "text")).withColumn("page_no", F.col("page_no") + 1)


def pdf_fallback(spark: SparkSession, path: str, most: int = 4000) -> DataFrame:
    """(path, pages, sample) of PDF files read as bytes: how many page objects there are, and the first characters. No PDF library is assumed."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    text = F.decode("content", "ISO-8859-1")
    return raw.select("path", F.greatest(F.regexp_count(text, F.lit(r"/Type\s*/Page(?![a-zA-Z])")), F.lit(1)).alias("pages"), F.substring(text, 1, most).alias("sample"))


def tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Task documents, a JSON object a file, newest first; files that can't be read are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("created_at"))


def features(df: DataFrame, json_col: str) -> DataFrame:
    """A row for each feature of the GeoJSON collections in a column: ordinal, type, geometry_type, coordinates, properties. Other JSON gives none."""
    parsed = F.from_json(json_col, f"struct<type: string, features: array<{FEATURE}>>")
    rows = df.withColumn("_c", parsed).where("_c.type = 'FeatureCollection'").select(*df.columns, F.posexplode("_c.features").alias("ordinal", "_f"))
    return rows.select(*df.columns, "ordinal", F.col("_f.type").alias("type"), F.col("_f.geometry.type").alias("geometry_type"), F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.properties").alias("properties"))


def settings(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, setting) of lines ``key=value``: comments and empty lines are skipped, quotes around a value go, the first of a key stays."""
    line = F.trim(column)
    kept = lines.where((line != "") & ~line.startswith("#") & line.contains("="))
    value = F.trim(F.regexp_replace(line, r"^[^=]*=", ""))
    bare = F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")
    return kept.select(F.trim(F.substring_index(line, "=", 1)).alias("key"), bare.alias("setting"), F.monotonically_increasing_id().alias("_n")).groupBy("key").agg(F.min_by("setting", "_n").alias("setting"))


def feature_collection(rows: DataFrame, keys: list[str], order: str, feature: Column) -> DataFrame:
    """(keys, geojson): the features of each group, in order, as one collection."""
    found = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), feature.alias("f")))), lambda x: x["f"])
    return rows.groupBy(*keys).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), found.alias("features"))).alias("geojson"))


def run_record(inputs: DataFrame, id_col: str) -> DataFrame:
    """``inputs`` as run records: the input as JSON and the SHA-256 of it, by which results are found again."""
    text = F.to_json(F.struct(*[c for c in inputs.columns if c != id_col]))
    return inputs.select(id_col, text.alias("input"), F.sha2(text, 256).alias("input_hash"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet under Spark's commit protocol, so that readers see all of it or none."""
    df.write.mode(mode).parquet(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text file of a column's values."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)
