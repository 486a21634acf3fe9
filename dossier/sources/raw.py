"""Raw inputs: detail records, category lists, paged listings, text or bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.functions.text import first_present
from dossier.operators.numbering import number_within

# The field names of the detail payload.
DETAIL_FIELDS = (
    "importInformationId", "id", "cnTitle", "title", "enTitle", "publishDate",
    "policyCategoryType", "policyCategoryTypeName", "categoryTypeName", "categoryName",
    "policySystemType", "createUserName", "body",
)
# Alternative names of an attachment's name, address and type.
FILE_NAME_KEYS = ("name", "fileName", "filename", "title")
FILE_URL_KEYS = ("url", "fileUrl", "downloadUrl", "path", "filePath")
FILE_TYPE_KEYS = ("contentType", "mimeType", "type")

FILE_TYPE = T.MapType(T.StringType(), T.StringType())  # a map keeps fileName and filename apart
DETAIL_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in DETAIL_FIELDS] + [T.StructField("fileList", T.ArrayType(FILE_TYPE))]
)
CATEGORY_TYPE = T.StructType(
    [
        T.StructField(n, T.StringType())
        for n in (
            "categoryTypeId", "policyCategoryType", "categoryId", "id",
            "categoryName", "name", "categoryEname", "ename", "englishName",
        )
    ]
)
SYSTEM_SCHEMA = T.StructType(
    [
        T.StructField("categoryList", T.ArrayType(CATEGORY_TYPE)),
        T.StructField("policyCategoryList", T.ArrayType(CATEGORY_TYPE)),
    ]
)


def _given(*cols) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def detail_rows(df: DataFrame, payload: str = "payload") -> DataFrame:
    """JSON detail payloads to typed rows. A record without an id is kept and marked `rejected`."""
    d = df.withColumn("d", F.from_json(payload, DETAIL_SCHEMA))
    import_id = _given(F.col("d.importInformationId"), F.col("d.id"))
    d = d.withColumn("import_id", import_id)
    return d.select(
        *[c for c in df.columns if c != payload],
        "import_id",
        F.concat(F.lit("company-policy-"), "import_id").alias("doc_id"),
        first_present(
            F.col("d.cnTitle"), F.col("d.title"), F.col("d.enTitle"),
            default=F.concat(F.lit("policy-"), F.coalesce("import_id", F.lit("unknown"))),
        ).alias("title"),
        first_present(
            F.col("d.policyCategoryTypeName"), F.col("d.categoryTypeName"), F.col("d.categoryName"),
        ).alias("category_name"),
        F.concat(F.lit("https://example.com/policyDetail/"), "import_id").alias("source_url"),
        F.col("d.cnTitle").alias("cn_title"),
        F.col("d.enTitle").alias("en_title"),
        F.col("d.publishDate").alias("publish_date"),
        F.col("d.policyCategoryType").alias("policy_category_type"),
        F.col("d.policySystemType").alias("policy_system_type"),
        F.col("d.createUserName").alias("create_user_name"),
        F.coalesce(F.col("d.body"), F.lit("")).alias("body"),
        F.coalesce(F.col("d.fileList"), F.array().cast(T.ArrayType(FILE_TYPE))).alias("files"),
        F.col("import_id").isNull().alias("rejected"),
    )


def category_dim(df: DataFrame, order: str, payload: str = "payload") -> DataFrame:
    """Nested category lists to one row per category id; the first occurrence wins.

    `min_by` combines map-side, so an id that fills a third of all rows costs
    one partial row per task, not one hot group.
    """
    sys = F.from_json(payload, SYSTEM_SCHEMA)
    items = (
        df.select(F.col(order).alias("o"), sys.alias("s"))
        .select(
            "o",
            F.posexplode(
                F.when(F.size("s.categoryList") > 0, F.col("s.categoryList")).otherwise(F.col("s.policyCategoryList"))
            ).alias("pos", "c"),
        )
        .withColumn(
            "category_id",
            F.trim(
                _given(F.col("c.categoryTypeId"), F.col("c.policyCategoryType"), F.col("c.categoryId"), F.col("c.id"))
            ).try_cast("bigint"),
        )
        .filter("category_id is not null")
        .select(
            "category_id",
            F.struct("o", "pos").alias("at"),
            F.struct(
                first_present(
                    F.col("c.categoryName"), F.col("c.name"),
                    default=F.concat(F.lit("category-"), F.col("category_id").cast("string")),
                ).alias("name"),
                first_present(F.col("c.categoryEname"), F.col("c.ename"), F.col("c.englishName")).alias("ename"),
            ).alias("v"),
        )
    )
    return items.groupBy("category_id").agg(F.min_by("v", "at").alias("v")).select("category_id", "v.name", "v.ename")


def paged_listing(
    df: DataFrame, key: str, order: str, page_size: int, max_pages: int | None = None, max_docs: int | None = None
) -> DataFrame:
    """Adds listing position, page number and page count per key; both caps apply in listing order.

    With caps only the first rows of each key are needed, and Spark's window
    group limit drops the rest before the shuffle. Without caps the numbering
    is spread over buckets, so no key is sorted in one task.
    """
    if page_size <= 0 or (max_pages is not None and max_pages <= 0) or (max_docs is not None and max_docs <= 0):
        raise ValueError("page_size, max_pages and max_docs must be positive")
    totals = df.groupBy(key).agg(F.count("*").alias("total_available"))
    caps = [c for c in (max_docs, max_pages * page_size if max_pages else None) if c]
    if caps:
        from pyspark.sql import Window as W

        rn = F.row_number().over(W.partitionBy(key).orderBy(order))
        ranked = df.withColumn("position", rn).filter(F.col("position") <= min(caps))
        ranked = ranked.withColumn("position", F.col("position").cast("bigint"))
    else:
        ranked = number_within(df, key, order, "position")
    return (
        ranked.join(totals, key)
        .withColumn("page_num", F.ceil(F.col("position") / page_size))
        .withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total_available") / page_size)))
    )


def with_text(df: DataFrame, text: str = "text", content: str = "content") -> DataFrame:
    """Text where given, else the bytes as UTF-8 with invalid sequences replaced, else empty."""
    decoded = F.make_valid_utf8(F.col(content).cast("string"))
    return df.withColumn(text, F.coalesce(F.col(text), decoded, F.lit(""))).drop(content)
