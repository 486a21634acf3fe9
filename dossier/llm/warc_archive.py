"""Content-addressed web archive.

An archive is two tables. `records` has the exact header block of every record; `payloads` has the bytes of each
distinct payload once, under its SHA-256. A record is its header joined with its payload. Reading recomputes the
digest of the stored bytes and fails on a difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.base import materialize, sized, some

#: Payloads below this many bytes are always written in full.
MIN_REVISIT_BYTES = 100
CRLF = "\r\n"
#: Pages carry no time of their capture; every record has this one unless the caller names another, so reruns give equal bytes.
NO_DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def record_id(page: Column, row: Column) -> Column:
    """Unique per record: the page and the number of its row in this archive."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit("#"), row.cast("string"), F.lit(">"))


def header_block(date: str = NO_DATE) -> Column:
    """Header lines of one record, up to and with the empty line. A URL with line ends is percent-encoded; its exact bytes follow in base64."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    blank = F.lit("")
    url = F.coalesce(F.col("url"), blank)
    uri = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("record_type") == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page"), F.col("row"))),
        line("WARC-Date", F.lit(date)),
        F.when(revisit, line("WARC-Refers-To", record_id(F.col("refers_to.page"), F.col("refers_to.row")))).otherwise(blank),
        F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(blank),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", uri)).otherwise(blank),
        F.when(uri != url, line("X-Target-URI-Base64", F.base64(F.encode(url, "UTF-8")))).otherwise(blank),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = NO_DATE) -> None:
    """Writes one record per row of pages to path/records and each distinct payload once to path/payloads.

    Of the rows with equal payloads of at least MIN_REVISIT_BYTES, those with the smallest key are responses and
    the others revisit them; null keys are larger than all. Rows that repeat a key and its payload share one stored
    payload, but records of their own. A null html is an empty payload, a null url leaves its header line
    out. Bytes are not shuffled to find copies, only digests. An empty table gives an empty archive, payloads may be of
    any length, and other columns are not read.
    """
    body = payload_of(F.col(html))
    seen = materialize(pages.select(F.col(key).alias("page"), F.col(url).cast("string").alias("url"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("row")), "seen")
    named = F.when(F.col("page").isNotNull(), F.struct("page", "row"))
    firsts = seen.groupBy("digest", "payload_bytes").agg(F.min("page").alias("first"), F.min(named).alias("refers_to"), F.count("*").alias("n"))
    shared = materialize(firsts.filter("n > 1"), "shared")
    joined = seen.join(sized(shared.select("digest", "first", "refers_to")), "digest", "left")
    again = (F.col("payload_bytes") >= MIN_REVISIT_BYTES) & F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))
    records = joined.withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    records.select(F.encode(header_block(date), "UTF-8").alias("header"), "digest").write.parquet(f"{path}/records")
    # A payload that occurs once is written where its page is read. Of the others, the first pages' bytes are gathered by digest.
    once = pages.select(F.col(key).alias("page"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    single = once.join(sized(shared.select("digest")), "digest", "left_anti").select("digest", "payload")
    single.write.option("compression", "zstd").parquet(f"{path}/payloads")
    if some(shared):
        more = once.join(sized(shared.select("digest", "first")), "digest").filter(F.col("page").eqNullSafe(F.col("first")))
        more.select("digest", "payload").dropDuplicates(["digest"]).write.mode("append").option("compression", "zstd").parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(header, digest, payload, record) per record: the exact bytes of the header block, the payload and the WARC record.

    A stored payload whose digest is not its key fails the job, and so does a record without a payload.
    """
    store = spark.read.parquet(f"{path}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not have its digest "), F.col("digest"))))
    store = store.select("digest", sound.alias("payload"))
    d = spark.read.parquet(f"{path}/records").join(store, "digest", "left")
    d = d.withColumn("payload", F.coalesce("payload", F.raise_error(F.concat(F.lit("no payload "), F.col("digest"))).cast("binary")))
    inline = F.when(header(F.col("header"), "Content-Length") == "0", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return d.withColumn("record", F.concat("header", inline, F.lit(CRLF * 2).cast("binary")))


def header(block: Column, name: str) -> Column:
    """Value of one header line; empty if there is none."""
    return F.regexp_extract(F.decode(block, "UTF-8"), rf"(?:^|\n){name}: ([^\r\n]*)", 1)


def parsed(archive: DataFrame) -> DataFrame:
    """(page, payload_bytes, payload_digest, record_type, refers_to, url) of read records, from their bytes."""
    page = lambda name: F.regexp_extract(header(F.col("header"), name), r"<urn:page:(.*)#\d+>", 1)
    none = lambda c: F.when(c != "", c)
    exact = F.decode(F.unbase64(none(header(F.col("header"), "X-Target-URI-Base64"))), "UTF-8")
    return archive.select(
        none(page("WARC-Record-ID")).alias("page"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        header(F.col("header"), "WARC-Type").alias("record_type"), none(page("WARC-Refers-To")).alias("refers_to"), F.coalesce(exact, none(header(F.col("header"), "WARC-Target-URI"))).alias("url"),
    )
