"""Reading and writing: tables, text folders, catalog exports, JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import schemas


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A model table with its declared schema; nothing is inferred."""
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def decode_text(content: Column) -> Column:
    """UTF-8 where the bytes are valid, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def read_text_folder(
    spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md"), recursive: bool = True
) -> DataFrame:
    """Files of a folder with hash and decoded text, one row each."""
    pattern = "*.{" + ",".join(extensions) + "}"
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return files.select(
        F.col("path").alias("file_path"),
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("file_hash"),
        decode_text(F.col("content")).alias("text"),
    )


def pages_of(files: DataFrame) -> DataFrame:
    """One page per file, keyed by the content hash."""
    return files.select(
        F.col("file_hash").alias("doc_id"),
        F.lit(1).alias("page_no"),
        F.lit("other").alias("page_type"),
        "text",
        F.length("text").alias("text_length"),
    )


def new_files(files: DataFrame, documents: DataFrame) -> DataFrame:
    """One file per content that no current document holds."""
    first = F.struct("file_path", "filename", "file_size", "text")
    unique = files.groupBy("file_hash").agg(F.min_by(first, "file_path").alias("_f"))
    known = documents.filter("is_latest").select("file_hash")
    return unique.join(known, "file_hash", "left_anti").select("file_hash", "_f.*")


EXPORT_COLUMNS = ["name", "category", "brand", "hs_code", "origin_country", "unit"]


def catalog_export(materials: DataFrame) -> DataFrame:
    """The export columns with empty text for NULL."""
    have = set(materials.columns)
    return materials.select(
        *[
            F.coalesce(F.col(c).cast("string") if c in have else F.lit(None), F.lit("")).alias(c)
            for c in EXPORT_COLUMNS
        ]
    )


def write_catalog(materials: DataFrame, path: str, form: str = "csv") -> None:
    """CSV with a header, or JSON lines with all columns."""
    if form == "csv":
        catalog_export(materials).write.option("header", True).option("emptyValue", "").csv(path)
    else:
        materials.write.json(path)


def decode_json(c: Column, schema: str) -> Column:
    """Typed value of a JSON text; bad JSON gives an empty map, array or struct."""
    parsed = F.from_json(c, schema)
    if schema.startswith("map"):
        return F.coalesce(parsed, F.create_map().cast(schema))
    if schema.startswith("array"):
        return F.coalesce(parsed, F.array().cast(schema))
    return parsed


def generated_documents(register: DataFrame, kind: str | None, limit: int, offset: int = 0) -> DataFrame:
    """One page of the register of generated documents, newest first."""
    rows = register if kind is None else register.filter(F.col("document_type") == kind)
    return rows.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit)
