"""WARC archives written and read with Spark's text source, records found by boundary-chain verification.

The reader cuts files at the version line. Each piece that parses as a record is a
candidate with an offset and that of its successor, computed from its declared
length. A payload may hold the version line too, so a candidate counts only when
the chain of successors from the start of its file reaches it. Pointer jumping
finds these: every round doubles the length of the jumps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.operators.sizing import Dimension, join_dimension, new_folder, settle, written_table

# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END_OF_HEAD = "\r\n\r\n"
RECORD_END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# Characters that some readers take for the end of a line.
LINE_ENDS = ("\r", "\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")

REVISIT_BYTES = 100  # smaller payloads are always written in full
RECORDS_PER_FILE = 100_000
WRITE_DATE = "2026-01-01T00:00:00Z"


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _with_originals(pages: DataFrame) -> DataFrame:
    """Add ``first_id``: the smallest page of those with the same large payload, where there are several.

    Only digests with several pages are joined. Their table is measured: while it is
    small the pages stay where they are, beyond that they are shuffled and a digest
    that belongs to a third of all pages is split.
    """
    several = (
        pages.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy(F.col("payload_digest").alias("same_digest"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("same_digest", "first_id")
    )
    return join_dimension(pages, settle(several)[0], [("payload_digest", "same_digest")], spread_by="page_id").drop("same_digest")


def warc_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(record): the text of each page's record, without the closing blank lines."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("html"),
        F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"),
    )
    first = F.col("first_id")
    revisit = first.isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > first))
    # A line break in a URL would end its header line, for this reader or another.
    address = F.col("url")
    for sign in LINE_ENDS:
        address = F.replace(address, F.lit(sign), F.lit("".join(f"%{b:02X}" for b in sign.encode())))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(END_OF_HEAD),
    )
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("html")))
    lines = F.concat_ws(
        "\r\n",
        F.when(F.col("revisit"), F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("page_id"))),
        F.lit(f"WARC-Date: {WRITE_DATE}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: "), _name(first), F.lit(f"\r\nWARC-Profile: {REVISIT_PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string")),
    )
    marked = _with_originals(rows).withColumn("revisit", revisit).withColumn("block", block)
    return marked.select(F.concat(F.lit(VERSION), lines, F.lit(END_OF_HEAD), F.col("block")).alias("record"))


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    records = warc_records(pages, key, url, html)
    records.write.option("lineSep", RECORD_END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _header(head: Column, name: str, pattern: str) -> Column:
    # Only CR LF ends a header line. Java would also take other signs for one at ^ and $.
    found = F.regexp_extract(head, rf"(?i)(?:\A|\r\n){name}:[ \t]*{pattern}[ \t]*(?=\r\n|\z)", 1)
    return F.when(found != "", found)


def _parsed(piece: Column) -> Column:
    """What a piece says of itself: its head, the bytes it claims behind the version line, and the payload as far as it holds it."""
    head = F.substring_index(piece, END_OF_HEAD, 1)
    declared = _header(head, "Content-Length", "([0-9]{1,15})").cast("long")
    begin = F.octet_length(head) + len(END_OF_HEAD)
    block = F.substring(piece.cast("binary"), begin + 1, declared.cast("int"))
    http = F.substring_index(block.cast("string"), END_OF_HEAD, 1)
    payload = F.substring(block, F.octet_length(http) + len(END_OF_HEAD) + 1, F.octet_length(block))
    kind = _header(head, "WARC-Type", "([a-z]+)")
    whole = (F.octet_length(head) < F.octet_length(piece)) & kind.isNotNull() & declared.isNotNull()
    page = rf"<urn:page:(-?[0-9]+)>"
    revisit = kind == "revisit"
    return F.struct(
        F.when(whole, begin + declared + len(RECORD_END)).alias("used"),
        kind.alias("record_type"),
        _header(head, "WARC-Record-ID", page).cast("long").alias("page_id"),
        F.when(revisit, _header(head, "WARC-Refers-To", page).cast("long")).alias("refers_to"),
        F.when(revisit, _header(http, "Content-Length", "([0-9]{1,15})").cast("long")).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, _header(head, "WARC-Payload-Digest", "sha256:([0-9a-f]+)")).otherwise(F.sha2(payload, 256)).alias("payload_digest"),
    )


def warc_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at the version lines, each piece with a number that grows within the part of the file that a task reads; written once."""
    read = spark.read.option("lineSep", VERSION).text(path)
    rows = read.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"), F.octet_length("value").cast("long").alias("size"),
        _parsed(F.col("value")).alias("own"), F.col("value").alias("piece"),
    )
    path = new_folder(spark, "pieces")
    rows.write.option("compression", "zstd").parquet(path)  # holds every payload, so it is packed tightly
    return spark.read.schema(rows.schema).parquet(path)


def _placed(pieces: DataFrame) -> DataFrame:
    """Pieces with a number for their file and their offset: a running sum of sizes over each file."""
    (files,) = settle(pieces.select(F.col("path").alias("file_path")).distinct().withColumn("file", F.monotonically_increasing_id()))
    lean = pieces.select("path", "block", "number", "size", F.col("own.used").alias("used"))
    order = Window.partitionBy("file").orderBy("block", "number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("size") + len(VERSION)).over(before), F.lit(0)) - len(VERSION)
    numbered = join_dimension(lean, files, [("path", "file_path")], spread_by="number")
    return numbered.select("file", "number", "size", "used", offset.alias("offset"))


def reachable(candidates: DataFrame) -> DataFrame:
    """Of candidates (file, offset, next), the (file, offset) that the chain from offset 0 of their file reaches.

    Pointer jumping: each round marks what the marked ones jump to and then doubles
    the jumps, so that the rounds grow with the logarithm of the records in a file.
    """
    nodes = written_table(candidates.select("file", "offset", F.col("next").alias("jump"), (F.col("offset") == 0).alias("seen")))
    while True:
        marks = nodes.where("seen").select("file", F.col("jump").alias("offset"), F.lit(True).alias("marked")).distinct()
        further = nodes.select("file", F.col("offset").alias("jump"), F.col("jump").alias("further"))
        stepped = nodes.join(marks, ["file", "offset"], "left").join(further, ["file", "jump"], "left")
        after = written_table(
            stepped.select(
                "file", "offset", F.coalesce("further", "jump").alias("jump"),
                (F.col("seen") | F.coalesce("marked", F.lit(False))).alias("seen"), (~F.col("seen") & F.col("marked")).alias("new"),
            )
        )
        if after.where("new").isEmpty():
            return after.where("seen").select("file", "offset")
        nodes = after.drop("new")


def check_chains(placed: DataFrame, chained: DataFrame) -> None:
    """Raise when the records of a file, from its start, do not reach its end."""
    ends = placed.groupBy("file").agg(F.max(F.col("offset") + len(VERSION) + F.col("size")).alias("end"))
    reached = chained.groupBy("file").agg(F.max("next").alias("reached"))
    broken = ends.join(reached, "file", "left").where("end > 0 and not end <=> reached").select("file", "end", "reached").first()
    if broken is not None:
        raise ValueError(f"damaged archive: the records of file {broken['file']} reach {broken['reached']} of {broken['end']} bytes")


def _measured(side: Dimension) -> DataFrame:
    return F.broadcast(side.table) if side.fits_broadcast else side.table


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record of the archives in a folder.

    A response's bytes and digest are those of its payload as read; a revisit holds
    none and tells those of the payload it stands for. A record whose payload holds
    version lines is put together again from its pieces. Records that no chain
    from the start of a file reaches do not count. A file whose chain does not end
    where the file ends is damaged and raises, as records would be lost behind the
    break. Pages without a key have null.
    """
    pieces = warc_pieces(spark, path)
    placed = written_table(_placed(pieces))
    claims = placed.where("used is not null and offset >= 0").select("file", "offset", (F.col("offset") + len(VERSION) + F.col("used")).alias("next"))
    chain = reachable(claims).withColumn("record", F.lit(True))
    check_chains(placed, claims.join(chain, ["file", "offset"]))
    marked = placed.join(chain, ["file", "offset"], "left")
    order = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("start", F.last(F.when(F.col("record"), F.col("offset")), ignorenulls=True).over(order))
    whole = F.coalesce(F.col("record") & (F.col("used") == F.col("size")), F.lit(False))
    # All pieces that are no record by themselves: those of records in several pieces and what no chain reaches.
    other = _measured(settle(owned.where(~whole).select("number", "file", "offset", "start"))[0])
    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    single = pieces.select("number", "own").join(other.select("number"), "number", "left_anti")
    # Pieces of one record only: no more than that record has bytes.
    parts = pieces.select("number", "piece").join(other.where("start is not null"), "number")
    joined = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
    several = joined.select(_parsed(F.array_join(F.col("parts.piece"), VERSION)).alias("own"))
    return single.select("own").unionAll(several).select(*[F.col(f"own.{f}").alias(f) for f in fields])


def warc_round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per page and read the archives back; one row per page.

    Null html is the empty payload. Of pages with the same payload of 100 bytes or
    more the smallest key is a response and the others revisit it; rows that share
    that key are all responses. A null key is written last in its group and read
    back as null. An empty table gives an empty result. Other columns play no part.
    """
    path = new_folder(pages.sparkSession, "warc")
    write_warc(pages, path, key, url, html)
    return read_warc(pages.sparkSession, path)
