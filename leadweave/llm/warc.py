"""WARC archives: writing pages, and reading records by boundary-chain verification.

An archive is split at each `WARC/1.0` line, wherever it stands. Every piece is a candidate record: its place in
the file and its declared length give the place of its successor. Only candidates that the chain reaches from the
file's start are records, so a file that begins with anything else has none; a candidate within a payload is on no chain. A candidate whose successor is the next
piece is whole. Runs of whole candidates up to one that isn't are one link of the chain, and pointers from link
to link are doubled until no further link is reached. Payloads that hold the magic line are put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadweave.storage import materialise, scratch_path, small_or_merge

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Payloads of fewer bytes are always written whole.
LEAST_REVISIT = 100
#: Records of a file at most; this bounds what one file's chain takes.
FILE_RECORDS = 50_000
#: Most groups of equal payloads whose digest and first page are broadcast (100 bytes each).
BROADCAST_GROUPS = 200_000


def _line(name: str, value: Column) -> Column:
    """A header line; none if the value is null. Line breaks in a value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _id_line(name: str, value: Column) -> Column:
    """A header line with an id as text, URL-encoded, so that it comes back as it was, empty or not."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.url_encode(value.cast("string")), F.lit("\r\n")), F.lit(""))


def warc_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """record: one WARC record for each page, without the blank lines at its end."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    alike = rows.filter(F.octet_length("payload") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    alike = small_or_merge(materialise(alike.filter("n > 1").select(F.col("digest").alias("d"), "first"), "equal-payloads"), BROADCAST_GROUPS)
    rows = rows.join(alike, F.col("digest") == F.col("d"), "left")
    again = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    record = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws(" ", F.col("page_id").cast("string"), "digest"), 256), F.lit(">"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        _id_line("X-Page-ID", F.col("page_id")),
        _id_line("X-Refers-To-Page-ID", F.when(again, F.col("first"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(block)),
        F.lit("\r\n"),
        block,
    )
    return rows.select(record.alias("record"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Write the pages (page_id, url, html) as WARC files under `path`; null html is an empty payload.

    Of pages with equal payloads of LEAST_REVISIT bytes or more, those with the smallest page_id are responses and
    the others revisits of it. Rows that share an id are records of their own; null ids and urls give no header.
    Ids come back as they were; line breaks in an url become spaces. Payloads of any length are written whole, columns
    other than these three are not read, and an empty table gives an archive without records.
    """
    warc_records(pages).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, value: what follows each magic line; offset is that of the line."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    return raw.withColumn("size", F.octet_length("value").cast("long"))


def _placed(pieces: DataFrame) -> DataFrame:
    """The pieces with the offset of their magic line, of files that have one at their start."""
    before = W.partitionBy("file").orderBy("block", "seq").rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.withColumn("offset", F.sum(F.col("size") + len(MAGIC)).over(before) - len(MAGIC)).withColumn("junk", F.first("size").over(before))
    return placed.filter("junk = 0").drop("junk")


def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def _id(head: Column, name: str) -> Column:
    return F.try_url_decode(F.get(F.regexp_extract_all(head, F.lit(rf"(?im)^{name}:[ \t]*([^\r\n]*)"), F.lit(1)), F.lit(0)))


def _parsed(pieces: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The pieces' headers, whether they are whole, and the payload's bytes and digest if so."""
    head = F.substring_index("value", END, 1)
    pieces = pieces.withColumn("head", head).withColumn("body", F.expr("substring(value, length(head) + 5)"))
    pieces = pieces.withColumn("length", F.expr("try_cast(regexp_extract(head, '(?im)^content-length:[ \\t]*([0-9]+)', 1) AS bigint)"))
    whole = F.col("size") == F.octet_length("head") + F.col("length") + 2 * len(END)
    pieces = pieces.withColumn("whole", F.coalesce(whole, F.lit(False))).withColumn("step", len(MAGIC) + F.octet_length("head") + F.col("length") + 2 * len(END))
    # the block without the blank lines at the record's end; of an HTTP message, what follows its header
    block = F.expr("substring(body, 1, length(body) - 4)")
    payload = F.when(F.col("body").startswith("HTTP/"), F.expr("substring(body, locate('\\r\\n\\r\\n', body) + 4, length(body) - locate('\\r\\n\\r\\n', body) - 7)")).otherwise(block)
    pieces = pieces.withColumn("payload", payload)
    fields = [
        _header(F.col("head"), "WARC-Type").alias("record_type"),
        _header(F.col("head"), "WARC-Target-URI").alias("url"),
        _header(F.col("head"), "WARC-Payload-Digest").alias("declared_digest"),
        _id(F.col("head"), "X-Page-ID").alias("page_id"),
        _id(F.col("head"), "X-Refers-To-Page-ID").alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
    ]
    return pieces.select(*keep, "step", "whole", *fields)


def _reached(links: DataFrame) -> DataFrame:
    """Links (file, link, next, entry) that are reached from link 0 of their file: file, link, entry.

    Round k adds what lies 2**k pointers after the links reached so far, and doubles the pointers.
    """
    jumps = links.filter("next IS NOT NULL").select("file", "link", "next", "entry")
    entered = jumps.select("file", F.col("next").alias("link"), "entry")
    found = materialise(links.filter("link = 0").select("file", "link"), "reached")
    jumps, count = materialise(jumps.select("file", "link", "next"), "jumps"), 0
    while (now := found.count()) != count and not jumps.isEmpty():
        count = now
        more = found.hint("merge").join(jumps, ["file", "link"]).select("file", F.col("next").alias("link"))
        found = materialise(found.unionByName(more).distinct(), "reached")
        twice = jumps.hint("merge").join(jumps.select("file", F.col("link").alias("next"), F.col("next").alias("after")), ["file", "next"])
        jumps = materialise(twice.select("file", "link", F.col("after").alias("next")), "jumps")
    start = links.filter("link = 0").select("file", "link", F.lit(0).cast("long").alias("entry"))
    return start.unionByName(found.filter("link > 0").hint("merge").join(entered, ["file", "link"]).select("file", "link", "entry"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files under `path` (uncompressed, of bounded size).

    file, offset, record_type, url, page_id, refers_to (as text), declared_digest, payload_bytes, payload_digest.
    Records behind a damaged length are not reached and left out, and so is a file that doesn't begin with a record.
    An empty archive gives no rows.
    """
    fields = ["record_type", "url", "declared_digest", "page_id", "refers_to", "payload_bytes", "payload_digest"]
    placed = _placed(_parsed(_pieces(spark, path), ("file", "block", "seq", "size")))
    pieces = materialise(placed.withColumn("succ", F.col("offset") + F.col("step")).drop("step", "size"), "pieces")
    broken = pieces.filter("NOT whole")
    if broken.isEmpty():
        return pieces.select("file", "offset", *fields)
    before = W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    pieces = materialise(pieces.withColumn("link", F.coalesce(F.sum(F.when(F.col("whole"), 0).otherwise(1)).over(before), F.lit(0))), "linked")
    ends = pieces.filter("NOT whole").select("file", "link", F.col("succ").alias("entry"))
    heads = pieces.select("file", F.col("offset").alias("entry"), F.col("link").alias("next"))
    links = ends.hint("merge").join(heads, ["file", "entry"], "left")
    lone = pieces.filter("offset = 0").select("file", F.col("link"), F.lit(None).cast("long").alias("entry"), F.lit(None).cast("long").alias("next"))
    links = materialise(links.select("file", "link", "entry", "next").unionByName(lone.hint("merge").join(ends.select("file", "link"), ["file", "link"], "left_anti")), "links")
    reached = materialise(_reached(links), "reached-links")
    marked = pieces.hint("merge").join(reached.withColumnRenamed("entry", "from"), ["file", "link"], "left").withColumn("record", F.coalesce(F.col("offset") >= F.col("from"), F.lit(False)))
    sofar = W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("record"), F.struct("offset", "whole", "succ")), True).over(sofar)
    marked = materialise(marked.withColumn("owner", owner), "marked")
    whole = marked.filter("record AND whole").select("file", "offset", *fields)
    parts = marked.filter("NOT owner.whole AND offset < owner.succ").select("file", "block", "seq", "offset", F.col("owner.offset").alias("start"))
    parts = small_or_merge(materialise(parts, "fragments"), BROADCAST_GROUPS)
    # pieces are known by their place in the reading, so that only fragments' payloads are shuffled
    texts = _pieces(spark, path).select("file", "block", "seq", "value").join(parts, ["file", "block", "seq"]).groupBy("file", "start").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda x: x["value"]), MAGIC)
    texts = texts.select("file", F.col("start").alias("offset"), joined.alias("value")).withColumn("size", F.octet_length("value").cast("long"))
    return whole.unionByName(_parsed(texts, ("file", "offset")).filter("whole").select("file", "offset", *fields))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """Every page, written to WARC archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType
    found = read_warc(spark, path).withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
    found = materialise(found.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", F.expr("substring(declared_digest, 8)").alias("declared")), "records")
    again, first = found.filter("record_type = 'revisit'"), found.filter("record_type = 'response'")
    full = first.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("declared")).agg(F.first("payload_bytes").alias("full"))
    again = again.hint("merge").join(full, ["refers_to", "declared"], "left")
    again = again.select("page_id", F.col("full").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", "refers_to")
    return first.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(again)


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> head THEN head END AS refers_to
FROM m
"""
