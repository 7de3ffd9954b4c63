"""Side tables on storage: admission of uploads, layout files, JSON side tables, idempotent rewrites, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_MB = 500

SPAN = "struct<text:string,font:string,size:double,color:int,flags:int,bbox:array<double>>"
BLOCK = f"struct<block_no:int,type:string,bbox:array<double>,text:string,lines:array<struct<bbox:array<double>,spans:array<{SPAN}>>>>"
LAYOUT = f"array<{BLOCK}>"


def upload_listing(spark: SparkSession, path: str) -> DataFrame:
    """Files under a folder, without their bytes: the content column is never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def admission(listing: DataFrame, limit_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """Which uploads are accepted (``.docx`` up to the size limit), and why not; other columns stay."""
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, "\\."), -1)).otherwise(""))
    reason = F.when(suffix != "docx", "format").when(F.col("length") > limit_mb * 1024 * 1024, "size")
    return listing.select(
        *listing.columns, name.alias("filename"), suffix.alias("format"), reason.isNull().alias("admitted"), reason.alias("reason")
    )


def flatten_layout(pages: DataFrame) -> DataFrame:
    """Layout JSON per page → text blocks with the font of their first span.

    ``pages`` has doc_id, page_no, blocks_json. Block bounds are x0, y0, x1, y1.
    """
    rows = pages.select("doc_id", "page_no", F.inline(F.from_json("blocks_json", LAYOUT)))
    span = F.get(F.get(F.col("lines"), F.lit(0))["spans"], F.lit(0))
    bounds = [F.get("bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))]
    return rows.filter("type = 'text'").select(
        "doc_id", "page_no", "block_no", F.col("text").alias("block_text"), *bounds,
        span["font"].alias("font"), span["size"].alias("font_size"), span["flags"].alias("font_flags"), span["color"].alias("font_color"),
    )


def page_summary(pages: DataFrame) -> DataFrame:
    """Full text and block counts of each page, straight from its layout array."""
    blocks = F.from_json("blocks_json", LAYOUT)
    text = F.filter(F.col("_b"), lambda b: b["type"] == "text")
    return pages.withColumn("_b", blocks).select(
        "doc_id", "page_no", F.array_join(F.filter(F.transform(text, lambda b: b["text"]), lambda t: t != ""), "\n").alias("page_text"),
        F.size(text).alias("text_blocks"), F.size(F.filter("_b", lambda b: b["type"] == "image")).alias("image_blocks"),
    )


def write_json_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Side table from JSON with a declared schema: nothing is inferred."""
    return spark.read.schema(schema).json(path)


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def rewrite_documents(df: DataFrame, path: str, buckets: int = 64, files_per_bucket: int = 8) -> None:
    """Replace the stored rows of the documents in ``df``; running it twice leaves the same table.

    The table is partitioned by a hash bucket of doc_id. Buckets that are touched are rebuilt from their other
    documents plus the new rows and swapped in by dynamic partition overwrite; other buckets stay as they are.
    ``buckets`` is part of the stored table's layout and ``files_per_bucket`` spreads the writing of one bucket; choose
    both so that a file holds some hundred MB.
    """
    from redline.session import checkpoint_dir

    spark = df.sparkSession
    new = df.withColumn("doc_bucket", bucket_of(F.col("doc_id"), buckets))
    try:
        old = spark.read.parquet(path)
    except Exception as missing:  # nothing stored yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        old = None
    if old is not None:
        checkpoint_dir(spark)
        touched = new.select("doc_bucket").distinct()
        keep = old.join(touched, "doc_bucket", "left_semi").join(new.select("doc_id").distinct(), "doc_id", "left_anti")
        new = new.unionByName(keep.select(*new.columns)).checkpoint()  # old files are about to be replaced
    new.repartition("doc_bucket", bucket_of(F.col("doc_id"), files_per_bucket)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("doc_bucket").parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id", version: str | None = None) -> DataFrame:
    """One row per key: the new row's fields where it has them, else the old ones.

    ``version`` orders several new rows of one key; the highest wins.
    """
    fields = [c for c in old.columns if c != key]
    if version is not None:
        new = new.groupBy(key).agg(F.max_by(F.struct(*fields), version).alias("_n"))
    else:
        new = new.select(key, F.struct(*fields).alias("_n"))
    before = old.select(key, F.struct(*fields).alias("_o"))
    joined = before.join(new, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"_n.{c}"), F.col(f"_o.{c}")).alias(c) for c in fields])
