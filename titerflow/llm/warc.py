"""WARC archives written by Spark, and read back from any split by verifying the chain of record boundaries.

The line that opens a record may also stand inside a payload, so a reader that starts in the middle of a file
cannot trust it.  Every such line makes a candidate whose header says where its successor starts.  Only what the
chain from the file's start reaches is a record; the rest lies inside payloads.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from titerflow.llm.common import written
from titerflow.operators.joins import attach
from titerflow.session import temp_table_path

# Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
#: What separates candidates on reading.  A header value holds no line end, so no header is ever cut, and the mark
#: does not overlap itself.
MARK = f"\n{VERSION}\r"
#: Payloads of fewer bytes are never replaced by a reference.
LEAST = 100


def _line(value: Column) -> Column:
    """Text that fits into a header line."""
    for c in ("\r", "\n", "\0"):
        value = F.replace(value, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return value


def first_of_payload(pages: DataFrame, id_col: str, text_col: str, url_col: str, least: int = LEAST) -> DataFrame:
    """Rows that repeat an earlier payload: ``_id, _url, _digest`` of the row and ``_to``, the id it refers to.

    Payloads with one row, which are most, are gone before the join.
    """
    payload = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    small = written(pages.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(url_col).alias("_url"), F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_bytes")
    ).where(F.col("_bytes") >= least))
    order = F.struct(F.col("_id").isNull().alias("missing"), F.col("_id").alias("id"), F.col("_url").isNull().alias("bare"), F.col("_url").alias("url"))
    groups = small.groupBy("_digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = attach(small, groups, "_digest", "inner")
    same = F.col("_id").eqNullSafe(F.col("first.id")) & F.col("_url").eqNullSafe(F.col("first.url"))
    return rows.where(~same).select("_id", "_url", "_digest", F.col("first.id").alias("_to")).distinct()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", text_col: str = "html", url_col: str = "url", least: int = LEAST, date: str = "2020-01-01T00:00:00Z",
) -> None:
    """Write one WARC record per row below ``path``, one archive per task.

    The payload is the text in UTF-8 (null: empty).  Of equal payloads of at least ``least`` bytes the row with the
    smallest id (null ids last, then by url) is a ``response``; the others are ``revisit`` records without a block,
    which name it and the payload's digest.  Rows equal in id, url and payload to the response are responses too.
    Line ends inside a url are written as ``%0D`` and ``%0A``; a null url leaves its line out.
    """
    payload = F.coalesce(F.col(text_col), F.lit(""))
    keyed = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest")
    )
    again = written(first_of_payload(pages, id_col, text_col, url_col, least))  # its size decides how it is joined
    same = keyed["id"].eqNullSafe(again["_id"]) & keyed["url"].eqNullSafe(again["_url"]) & (keyed["digest"] == again["_digest"])
    rows = keyed.join(again.withColumn("_again", F.lit(True)), same, "left")

    def urn(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(">"))

    revisit = F.coalesce("_again", F.lit(False))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    header = F.concat_ws(
        CRLF,
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _line(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("_to"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(header, F.lit(CRLF + CRLF), block)
    rows.select(record.alias("value")).write.option("lineSep", CRLF + CRLF).text(path)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per opening line in the archives: its place, its header, and what its block would be.

    ``file, block, seq`` give the order: the split's start and the rows' order in it.  ``size`` is the distance to the
    next candidate or to the file's end, ``jump`` the distance to the successor that the header promises (null: no
    usable header).  ``content`` is the digest of the whole piece, by which it is found again.
    """
    text = spark.read.option("lineSep", MARK).text(path)
    rows = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value"
    )
    # a file's first row still has its opening line, as may what follows a mark inside a payload; `placed` tells them apart
    opens = F.startswith("value", F.lit(MARK[1:]))
    rows = rows.withColumn("opens", opens).withColumn("piece", F.when(opens, F.substring("value", len(MARK), 2**31 - 1)).otherwise(F.col("value")))
    followed = F.concat("piece", F.lit("\n"))  # a block that opens with a mark takes the header's last line end with it
    head = F.substring_index(followed, CRLF + CRLF, 1)
    sound = (F.octet_length(head) < F.octet_length(followed)) & F.startswith("piece", F.lit("\n"))
    rows = rows.withColumn("header", F.when(sound, head))
    length = F.expr(r"try_cast(regexp_extract(header, '(?im)^content-length:[ \t]*([0-9]{1,15})[ \t]*\r?$', 1) as bigint)")

    def field(name: str) -> Column:
        found = F.regexp_extract("header", rf"(?im)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
        return F.when(found != "", found)

    body = F.octet_length("header").cast("bigint") + 4  # bytes of the piece before the block
    whole = F.expr("substring(cast(piece as binary), octet_length(header) + 5, cast(length as int))")
    cut = F.octet_length("piece").cast("bigint") < body + F.col("length")  # the payload goes on beyond the piece
    return rows.withColumn("length", length).select(
        "file", "block", "seq", "opens",
        (F.octet_length("value").cast("bigint") + len(MARK)).alias("size"),  # the mark counts with the piece it opens
        (body + F.col("length") + 4 + len(MARK) - 1).alias("jump"),
        "length", (F.octet_length("header") + 4).cast("bigint").alias("body"),
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("record"), field("WARC-Refers-To").alias("refers"),
        field("WARC-Payload-Digest").alias("claimed"), field("WARC-Target-URI").alias("url"),
        F.when(~cut, F.sha2(whole, 256)).alias("digest"), F.sha2(F.col("value").cast("binary"), 256).alias("content"),
    )


def placed(found: DataFrame) -> DataFrame:
    """Adds ``at``, the candidate's offset in its file, ``goes``, its successor's, ``end``, the offset after its piece,
    and ``run``: candidates of a run lead to one another in file order, so whoever enters a run walks to its end.

    Sums run inside each split; the few totals per split are summed per file.
    """
    in_order = Window.partitionBy("file", "block").orderBy("seq")
    opened = F.col("opens") & (F.col("block") == 0) & (F.row_number().over(in_order) == 1)
    rows = found.withColumn("opened", opened)
    rows = rows.withColumns({
        "size": F.col("size") - F.when(F.col("opened"), len(MARK) - 1).otherwise(0),
        "jump": F.when(F.col("opened") | ~F.col("opens"), F.col("jump")),
    })
    rows = rows.withColumn("breaks", (~F.col("jump").eqNullSafe(F.col("size"))).cast("bigint"))
    inside = in_order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"before": F.coalesce(F.sum("size").over(inside), F.lit(0)), "cuts": F.coalesce(F.sum("breaks").over(inside), F.lit(0))})
    totals = rows.groupBy("file", "block").agg(F.sum("size").alias("sizes"), F.sum("breaks").alias("ends"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", "block", F.coalesce(F.sum("sizes").over(earlier), F.lit(0)).alias("b0"), F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("r0"))
    rows = attach(rows, totals, ["file", "block"], "inner")
    at = F.col("b0") + F.col("before")
    return rows.withColumns({"at": at, "goes": at + F.col("jump"), "end": at + F.col("size"), "run": F.col("r0") + F.col("cuts")}).drop("opens", "b0", "r0", "before", "cuts")


def reachable(places: DataFrame) -> DataFrame:
    """The candidates that the chain from their file's start reaches.

    Runs are contracted: an entry is a file's start or a place that the last candidate of a run leads to, and its own
    successor is the entry that its run's end leads to.  Pointer jumping doubles the distance over entries each round,
    marking what marked entries reach; where payloads hold no opening lines there is one entry and no round.
    """
    ends = places.where("breaks = 1 and goes is not null and goes > at").select("file", F.col("run").alias("from_run"), F.col("goes").alias("at"))
    starts = places.where("opened").select("file", F.lit(None).cast("bigint").alias("from_run"), "at")
    landed = starts.unionByName(ends).join(places.select("file", "at", "run"), ["file", "at"])
    entries = written(landed)
    nodes = entries.groupBy("file", "at", "run").agg(F.max(F.col("from_run").isNull()).alias("marked"))
    leads = entries.where("from_run is not null").select("file", F.col("from_run").alias("run"), F.col("at").alias("next"))
    state = written(nodes.join(leads, ["file", "run"], "left").select("file", "at", "run", "marked", "next"))
    while state.where("marked and next is not null").limit(1).count():
        ahead = state.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        pushed = state.where("marked and next is not null").select("file", F.col("next").alias("at")).distinct().withColumn("hit", F.lit(True))
        moved = state.join(ahead, ["file", "next"], "left").join(pushed, ["file", "at"], "left")
        state = written(moved.select("file", "at", "run", (F.col("marked") | F.coalesce("hit", F.lit(False))).alias("marked"), F.col("after").alias("next")))
    entered = state.where("marked").groupBy("file", "run").agg(F.min("at").alias("from"))
    return places.join(entered, ["file", "run"]).where("at >= from and jump is not null").drop("from")


def _whole_payloads(spark: SparkSession, path: str, records: DataFrame, places: DataFrame) -> DataFrame:
    """``file, at, digest`` of records whose payload holds opening lines: their pieces are joined again.

    Only the pieces wanted are read a second time, by the digest of their content.
    """
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    marks = records.select("file", "at", F.col("at").alias("own"))
    rows = attach(places.select("file", "block", "seq", "at", "end", "content"), marks, ["file", "at"], "left")
    rows = rows.withColumn("last", F.max("own").over(inside))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("file", "block").agg(F.max("own").alias("top")).select("file", "block", F.max("top").over(earlier).alias("carried"))
    rows = attach(rows, totals, ["file", "block"], "inner").withColumn("of", F.coalesce("last", "carried"))
    cut = records.where("digest is null").select("file", F.col("at").alias("of"), "body", "length")
    pieces = written(rows.join(cut, ["file", "of"]).select("file", "of", "at", "body", "length", "content"))
    wanted = pieces.select("content").distinct()
    text = spark.read.option("lineSep", MARK).text(path).withColumn("content", F.sha2(F.col("value").cast("binary"), 256))
    texts = text.join(wanted, "content", "left_semi").dropDuplicates(["content"])
    parts = attach(pieces, texts, "content", "inner").groupBy("file", "of").agg(
        F.min("body").alias("body"), F.min("length").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda p: p["value"]), MARK).alias("text")
    )
    # a file's first piece still has its opening line
    text = F.when(F.startswith("text", F.lit(MARK[1:])) & (F.col("of") == 0), F.substring("text", len(MARK), 2**31 - 1)).otherwise(F.col("text"))
    parts = parts.withColumn("raw", text.cast("binary"))
    return parts.select("file", F.col("of").alias("at"), F.expr("sha2(substring(raw, cast(body as int) + 1, cast(length as int)), 256)").alias("joined"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``file, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact`` per record.

    Archives are read in splits of any size by Spark's text reader, cut at opening lines.  Records are what the
    chain of lengths reaches from each file's start.  A response's bytes and digest come from its block; a revisit's
    from the response that it names.  ``intact`` tells whether the digest equals the one in the header; it is false
    for a revisit whose response is missing.  A file that does not open with a record has none; a broken length ends
    its file's chain there.  Ids that are not numbers are null.  No archives, or empty ones, give no rows.
    """
    places = written(placed(written(candidates(spark, path))))
    records = written(reachable(places))
    if records.where("digest is null").limit(1).count():
        joined = written(_whole_payloads(spark, path, records, places))
        records = attach(records, joined, ["file", "at"], "left").withColumn("digest", F.coalesce("digest", "joined")).drop("joined")

    def page(column: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({column}, 'urn:page:(-?[0-9]+)', 1) as bigint)")

    revisits = F.col("type") == "revisit"
    claim = F.regexp_replace("claimed", "^sha256:", "")
    rows = records.select(
        "file", F.col("at").alias("offset"), page("record").alias("page_id"), "url", F.col("type").alias("record_type"), page("refers").alias("refers_to"),
        F.col("length").alias("bytes"), "digest", claim.alias("claim"), revisits.alias("again"), "refers",
    )
    held = records.where(~revisits).select(F.col("record").alias("refers"), F.col("digest").alias("claim"), F.col("length").alias("held")).dropDuplicates(["refers", "claim"])
    rows = attach(rows, held, ["refers", "claim"], "left")
    return rows.select(
        "file", "offset", "page_id", "url", "record_type", "refers_to", F.when(F.col("again"), F.col("held")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(F.col("again"), F.col("claim")).otherwise(F.col("digest")).alias("payload_digest"),
        F.when(F.col("again"), F.col("held").isNotNull()).otherwise(F.col("digest").eqNullSafe(F.col("claim"))).alias("intact"),
    )


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` as archives below ``spark.checkpoint.dir`` and read them back."""
    spark = pages.sparkSession
    path = temp_table_path(spark, f"warc-{uuid.uuid4().hex}")
    write_archives(pages, path, **options)
    return read_archives(spark, path)
