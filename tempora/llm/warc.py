"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing is Spark's text writer with the record terminator as line separator.  Reading splits
the files at every occurrence of the version line, wherever it lies; each piece is a candidate
record with an offset and, by its Content-Length, a successor offset.  Pointer jumping from the
start of each file marks the candidates that the chain of records reaches; pieces that it does
not reach were payload, and are put back into the record that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, scratch_path

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the pages do not tell when they were fetched
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 4096
BROADCAST_ROWS = 200_000


def base32_sha1(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: every five hex digits are four letters."""
    out = []
    for k in range(0, 40, 5):
        group = F.conv(F.substring(digest, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(group, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, refers_to)``; ``refers_to`` is the
    least id of an equal payload of at least ``min_bytes`` bytes, null for that record itself."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.encode("payload", "UTF-8")))
    equal = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(equal.where("n > 1").select("sha1", "first"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:  # else the payloads are shuffled by digest
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, "sha1", "left").withColumn("payload_digest", base32_sha1(F.col("sha1")))
    return rows.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first", "sha1")


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, date: str = DATE) -> None:
    """Write ``with_revisits()`` rows as WARC files; a revisit record has no payload.  ``date`` is
    that of every record, given so that a task that runs again writes the same bytes."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    revisit = F.col("refers_to").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
        body,
    )
    records.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


def _pieces(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Pieces between version lines with file and order.  The first piece of a file lies before
    its first version line and is empty."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.withColumn("nth", F.monotonically_increasing_id())  # rising in file order within a block
    return raw if files is None else raw.join(F.broadcast(files), "file", "left_semi")


def _offsets(pieces: DataFrame) -> DataFrame:
    """Adds ``offset``, the byte at which the piece's version line starts.  Files are rolled by
    record count when written, which bounds a window's partition."""
    order = Window.partitionBy("file").orderBy("block", "nth")
    before = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.withColumn("offset", before - len(MAGIC))
    return placed.where("offset >= 0")


def reachable(candidates: DataFrame) -> DataFrame:
    """``(file, offset)`` of the candidates reached from offset 0 by successors.

    ``candidates(file, offset, successor)``.  Neighbours of which each is the other's successor
    are contracted to runs first, cut wherever another successor enters; a run is reached as a
    whole or not at all.  Pointer jumping then goes from run to run: a round doubles the length
    of every jump, so their number is the logarithm of the longest chain of runs.
    """
    order = Window.partitionBy("file").orderBy("offset")
    rows = candidates.select("file", "offset", "successor")
    leaves = ~F.coalesce(F.lead("offset").over(order) == F.col("successor"), F.lit(False))
    entered = rows.withColumn("leaves", leaves).where("leaves").select("file", F.col("successor").alias("offset"), F.lit(True).alias("entered")).distinct()
    follows = F.coalesce(F.lag("successor").over(order) == F.col("offset"), F.lit(False))
    rows = rows.join(entered, ["file", "offset"], "left").withColumn("head", ~follows | F.col("entered").isNotNull())
    rows = materialize(rows.withColumn("run", F.sum(F.col("head").cast("long")).over(order)).select("file", "offset", "successor", "run"), "runs")
    runs = rows.groupBy("file", "run").agg(F.min("offset").alias("offset"), F.max_by("successor", "offset").alias("jump"))
    jumps, known = materialize(runs.select("file", "run", "offset", "jump", (F.col("offset") == 0).alias("reached")), "jumps"), -1
    while True:
        count = jumps.where("reached").count()
        if count == known:
            return rows.join(jumps.where("reached").select("file", "run"), ["file", "run"], "left_semi").select("file", "offset")
        known, step = count, jumps
        for _ in range(2):
            targets = step.where("reached").select("file", F.col("jump").alias("offset"), F.lit(True).alias("hit")).distinct()
            beyond = step.select("file", F.col("offset").alias("jump"), F.col("jump").alias("next"))
            step = step.join(beyond, ["file", "jump"], "left").select("file", "run", "offset", F.coalesce("next", F.lit(-1)).alias("jump"), "reached")
            step = step.join(targets, ["file", "offset"], "left").select("file", "run", "offset", "jump", (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"))
        step = materialize(step, "jumps")
        discard(jumps)
        jumps = step


def _field(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, record_type, refers_to, payload_bytes, payload_digest, payload_ok)`` per record.

    Length and digest are those of the payload as read, for a revisit those that it states;
    ``payload_ok`` tells whether the stated digest agrees.
    """
    head = F.substring_index("value", END, 1)
    pieces = _pieces(spark, path).withColumn("bytes", F.octet_length("value")).withColumn("head", head)
    parsed = _parsed(pieces)
    told = ["file", "block", "nth", "bytes", "head_bytes", "length", "page_id", "record_type", "refers_to", "stated_digest", "stated_bytes", "payload_bytes", "payload_digest"]
    placed = materialize(_offsets(parsed.select(*told)), "candidates")
    chain = placed.where("length is not null").select("file", "offset", (F.col("offset") + len(MAGIC) + F.col("head_bytes") + 2 * len(END) + F.col("length")).alias("successor"))
    marks = reachable(chain).withColumn("record", F.lit(True))
    placed = placed.join(marks, ["file", "offset"], "left")
    owner = F.last(F.when(F.col("record"), F.col("offset")), ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    owned = materialize(placed.withColumn("owner", owner), "owners")
    broken = owned.where("record is null").select("file", "owner").distinct()
    whole = owned.where("record").join(broken.withColumnRenamed("owner", "offset"), ["file", "offset"], "left_anti")
    out = whole.select(*told[6:])
    files = broken.select("file").distinct()
    if not files.isEmpty():
        again = _offsets(_pieces(spark, path, files).withColumn("bytes", F.octet_length("value")))
        again = again.join(owned.select("file", "offset", "owner"), ["file", "offset"]).join(broken, ["file", "owner"], "left_semi")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
        mended = again.groupBy("file", "owner").agg(joined.alias("value")).withColumn("head", head)
        out = out.union(_parsed(mended).select(*told[6:]))
    stated = F.col("record_type") == "revisit"
    return out.select(
        "page_id",
        "record_type",
        "refers_to",
        F.when(stated, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stated, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        (stated | (F.col("stated_digest") == F.col("payload_digest"))).alias("payload_ok"),
    )


def _parsed(rows: DataFrame) -> DataFrame:
    """Header fields of ``head`` and measures of the payload that follows it in ``value``."""
    number = lambda name: _field(F.col("head"), name).try_cast("long")
    page = lambda name: F.regexp_extract(F.coalesce(_field(F.col("head"), name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    payload = F.expr(f"substring(value, length(head) + {len(END) + 1}, greatest(length(value) - length(head) - {2 * len(END)}, 0))")
    return rows.select(
        *rows.columns,
        F.octet_length("head").alias("head_bytes"),
        number("Content-Length").alias("length"),
        page("WARC-Record-ID").alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
        number("WARC-Payload-Length").alias("stated_bytes"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(F.sha1(F.encode(payload, "UTF-8"))).alias("payload_digest"),
    )


def archive_pages(pages: DataFrame, path: str | None = None, records_per_file: int = RECORDS_PER_FILE, min_bytes: int = 0, **columns: str) -> DataFrame:
    """Write a record per row of ``pages`` and read the archives back.

    A null payload is empty, and empty payloads are equal payloads; a null url gives no target.
    Of equal payloads the least id is the response, the others revisit it; repeated rows of that
    id are responses all, and rows with a null id revisit unless they are alone with their
    payload.  Other columns are not written.  An empty table gives no record.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(with_revisits(pages, min_bytes=min_bytes, **columns), path, records_per_file)
    return read_warc(spark, path)
