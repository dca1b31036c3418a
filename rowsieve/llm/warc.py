"""WARC archives: pages written as transactions, read back and assembled, one row a capture."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowsieve.session import scratch_path, settle

VERSION = "WARC/1.1"
#: Page bytes in one archive file at most, by the mean size of a page.
FILE_BYTES = 128 << 20
#: The date of the records, unless one is given; fixed, so that reruns agree.
DATE = "2024-01-01T00:00:00Z"
#: A key with more than this share of the rows, and at least so many, is dealt to many tasks.
HOT_SHARE, HOT_ROWS, SALTS = 256, 1000, 64
_END = "\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# The headers read by name, as the WARC standard spells them. Fixed values.
HEADERS = {
    "record_id": "warc-record-id",
    "kind": "warc-type",
    "concurrent_to": "warc-concurrent-to",
    "refers_to_id": "warc-refers-to",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "declared_digest": "warc-payload-digest",
}
RECORD = (
    "file string, at long, record_id string, kind string, concurrent_to string, refers_to_id string, "
    "target_uri string, date string, declared_digest string, payload_bytes long, "
    "payload_digest string, digest_fits boolean, fields map<string, string>, payload binary"
)


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a column: ten hex digits make eight of base32."""
    digits = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)
    ]
    # conv counts 0-9A-V, base32 counts A-Z2-7.
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Left join to a ``right`` side with one row a key (null keys meet null keys).

    Keys that hold more than 1/``HOT_SHARE`` of the left rows are counted out first, at most that
    many; their left rows are dealt by ``spread_by`` to ``SALTS`` tasks, their right row to all.
    """
    mark = F.xxhash64(*on)
    per_key = left.groupBy(mark.alias("mark")).agg(F.count(F.lit(1)).alias("n"))
    total = left.count()
    hot = [r[0] for r in per_key.filter(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).collect()]
    is_hot = mark.isin(hot) if hot else F.lit(False)
    deal = F.when(is_hot, F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))).otherwise(F.lit(0))
    copies = F.when(is_hot, F.array(*map(F.lit, range(SALTS)))).otherwise(F.array(F.lit(0)))
    keep = [c for c in right.columns if c not in on]
    right = right.withColumn("_salt", F.explode(copies)).select(
        *[F.col(c).alias(f"_on_{i}") for i, c in enumerate(on)], F.col("_salt").alias("_on_salt"), *keep
    )
    left = left.withColumn("_salt", deal.cast("int"))
    same = [F.col(c).eqNullSafe(F.col(f"_on_{i}")) for i, c in enumerate(on)]
    joined = left.join(right, reduce(lambda a, b: a & b, same, F.col("_salt") == F.col("_on_salt")), "left")
    return joined.drop("_salt", "_on_salt", *[f"_on_{i}" for i in range(len(on))])


# --- writing -----------------------------------------------------------------------------------


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, uri, sha, html, copy, revisit, first_id, first_uri): pages as they are archived.

    Rows with equal payloads of at least ``min_bytes`` bytes form a group; the row that comes
    first by page_id (nulls last), then address, is its response; the others are revisits
    and name it. Only page_id, address and SHA-256 are grouped and joined by payload, hot payloads
    dealt to many tasks; the payload itself is shuffled once, by row.
    ``copy`` numbers rows equal in everything, the first of which counts as the response.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        # White space and control characters would break the header line.
        F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20").alias("uri"),
        F.coalesce(F.col("html"), F.lit("")).alias("html"),
    ).withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    narrow = settle(
        rows.filter(F.octet_length("html") >= min_bytes)
        .groupBy("page_id", "uri", "sha")
        .agg(F.count(F.lit(1)).alias("n")),
        "payloads",
    )
    order = F.struct(
        F.col("page_id").isNull().alias("no_id"), "page_id", F.col("uri").isNull().alias("no_uri"), "uri"
    )
    groups = (
        narrow.groupBy("sha")
        .agg(F.min(order).alias("first"), F.sum("n").alias("size"))
        .filter("size > 1")
        .select("sha", "first")
    )
    again = spread_join(narrow, groups, ["sha"], ["page_id", "uri"]).filter("first IS NOT NULL")
    # One text for the three, which is never null, so rows, marks and numbers share a shuffle.
    key = F.to_json(F.struct("page_id", "uri", "sha"))
    marks = again.select(key.alias("row_key"), "first")
    # Rows equal in everything are alike, so it does not matter which is numbered first.
    number = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key")) - 1
    marked = rows.withColumn("row_key", key).join(marks, "row_key", "left").withColumn("copy", number)
    leads = (
        F.col("page_id").eqNullSafe(F.col("first.page_id"))
        & F.col("uri").eqNullSafe(F.col("first.uri"))
        & (F.col("copy") == 0)
    )
    revisit = F.col("first").isNotNull() & ~leads
    return marked.select(
        "page_id", "uri", "sha", "html", "copy", revisit.alias("revisit"),
        F.when(revisit, F.col("first.page_id")).alias("first_id"),
        F.when(revisit, F.col("first.uri")).alias("first_uri"),
    )


def _record_id(kind: str, page_id: Column, uri: Column, sha: Column, copy: Column) -> Column:
    """A record's name, the same on every run: a UUID (version 8) of what it records."""
    named = F.to_json(F.struct(F.lit(kind).alias("k"), page_id.alias("p"), uri.alias("u"),
                               sha.alias("s"), copy.alias("c")))
    h = F.sha2(named, 256)
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(
        F.lit("<urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-8"), cut(14, 3), F.lit("-a"),
        cut(18, 3), F.lit("-"), cut(21, 12), F.lit(">"),
    )


def _record(headers: dict[str, Column], block: Column) -> Column:
    """A record without the two line ends behind it; headers with a null value are left out."""
    lines = [
        F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))
        for name, value in headers.items()
    ]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit(VERSION + _END), *lines, length, F.lit(_END * 2), block)


def write_archives(
    pages: DataFrame, path: str | None = None, min_bytes: int = 0, date: str = DATE,
    file_bytes: int = FILE_BYTES,
) -> str:
    """Writes three records a page (request, response or revisit, metadata); returns the folder.

    ``pages`` holds page_id, url and html (null: empty); extra columns are not read. Files are
    gzipped WARC, written by Spark's own writer: a record is a line whose end is two CRLF, as
    the standard asks, so a task that runs twice leaves one file, on any store. A revisit has the
    HTTP head of its page but no payload, and names the response with an equal payload in
    WARC-Refers-To. Request and metadata name the response or revisit in WARC-Concurrent-To.
    A null url leaves its headers out. An empty table leaves a folder without records.
    """
    spark = pages.sparkSession
    target = path or scratch_path(spark, "archives")
    size = F.coalesce(F.octet_length("html"), F.lit(0)) + 1500
    mean = float(pages.agg(F.avg(size)).first()[0] or 1500)
    marked = mark_revisits(pages, min_bytes)
    own = [F.col(c) for c in ("page_id", "uri", "sha", "copy")]
    ids = {kind: _record_id(kind, *own) for kind in ("request", "capture", "metadata")}
    answered = _record_id(
        "capture", F.col("first_id"), F.col("first_uri"), F.col("sha"), F.lit(0)
    )
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("html").cast("binary")))
    host = F.regexp_extract("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest = F.regexp_extract("uri", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    asked = F.concat(
        F.lit("GET "),
        F.when(F.substring(rest, 1, 1) == "/", rest).otherwise(F.concat(F.lit("/"), F.coalesce(rest, F.lit("")))),
        F.lit(" HTTP/1.1" + _END + "Host: "), F.coalesce(host, F.lit("")), F.lit(_END * 2),
    )
    head = F.concat(
        F.lit("HTTP/1.1 200 OK" + _END + "Content-Type: text/html; charset=utf-8" + _END + "Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(_END * 2),
    )
    fields = F.concat(
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(_END)), F.lit("")),
        F.lit("payload-sha256: "), F.col("sha"), F.lit(_END),
    )
    revisit = F.col("revisit")
    common = {"WARC-Target-URI": F.col("uri"), "WARC-Date": F.lit(date)}
    capture = _record(
        {
            "WARC-Type": F.when(revisit, "revisit").otherwise("response"),
            "WARC-Record-ID": ids["capture"],
            **common,
            "WARC-Payload-Digest": digest,
            "WARC-Profile": F.when(revisit, F.lit(_PROFILE)),
            "WARC-Refers-To": F.when(revisit, answered),
            "WARC-Refers-To-Target-URI": F.when(revisit, F.col("first_uri")),
            "WARC-Refers-To-Date": F.when(revisit, F.lit(date)),
            "Content-Type": F.lit("application/http; msgtype=response"),
        },
        F.when(revisit, head).otherwise(F.concat(head, F.col("html"))),
    )
    others = [
        _record(
            {"WARC-Type": F.lit(kind), "WARC-Record-ID": ids[kind], **common,
             "WARC-Concurrent-To": ids["capture"], "Content-Type": F.lit(content)},
            block,
        )
        for kind, content, block in (
            ("request", "application/http; msgtype=request", asked),
            ("metadata", "application/warc-fields", fields),
        )
    ]
    rows = marked.select(F.explode(F.array(others[0], capture, others[1])).alias("value"))
    writer = rows.write.option("lineSep", _END * 2).option("compression", "gzip")
    writer.option("maxRecordsPerFile", 3 * max(1, int(file_bytes / mean))).text(target)
    return target


# --- reading -----------------------------------------------------------------------------------


def _headers(source: io.BufferedReader) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    while (line := source.readline().rstrip(b"\r\n")):
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and last:  # a folded line goes on with the header before it
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found


def parse_archive(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, headers, block) of every record of a WARC file, gzipped as a whole, by record, or not.

    Names of headers are in lower case. Text before a record that is no record, or a block cut
    short, ends the file with an error.
    """
    raw: io.IOBase = io.BytesIO(content)
    if content[:2] == b"\x1f\x8b":
        raw = gzip.GzipFile(fileobj=raw)
    source = io.BufferedReader(raw, 1 << 20)
    at = 0
    while (line := source.readline()):
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record, but {line[:40]!r}")
        headers = _headers(source)
        size = int(headers.get("content-length", 0))
        block = source.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut short")
        yield at, headers, block
        at += 1


def _record_row(file: str, at: int, headers: dict[str, str], block: bytes, keep: bool) -> tuple:
    kind = headers.get("warc-type", "").lower()
    payload, size, fields = block, len(block), None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        fields = dict(_field(x) for x in head.split(b"\r\n")[1:] if b":" in x)
        size = len(payload)
        if kind == "revisit":  # its payload lies with the response
            stated = fields.get("content-length", "")
            size = int(stated) if stated.isdigit() else None
    elif headers.get("content-type", "").startswith("application/warc-fields"):
        fields = dict(_field(x) for x in block.split(b"\r\n") if b":" in x)
    stated = headers.get("warc-payload-digest", "")
    digest = stated.partition(":")[2] if stated.startswith("sha1:") else None
    fits = None
    if kind != "revisit":
        made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        fits, digest = (None if digest is None else made == digest), made
    named = [headers.get(name) for name in HEADERS.values()]
    named[1] = kind
    return (file, at, *named, size, digest, fits, list((fields or {}).items()), payload if keep else None)


def _field(line: bytes) -> tuple[str, str]:
    name, _, value = line.decode("utf-8", "replace").partition(":")
    return name.strip().lower(), value.strip()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the WARC files below ``path``, of any size that Spark reads as one (2 GB).

    payload_bytes and payload_digest (SHA-1 in base32) are worked out from the payload; those of a
    revisit are what its HTTP head and header say. digest_fits says whether the digest is the
    stated one, null where none is. ``fields`` are the HTTP or metadata fields, names in lower
    case. Without ``payloads`` the payload column is null.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _ARROW
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list[tuple] = []
                held = 0
                for at, headers, block in parse_archive(content.as_py()):
                    rows.append(_record_row(file, at, headers, block, payloads))
                    held += len(block) if payloads else 0
                    if held > 16 << 20 or len(rows) >= 10_000:
                        yield _batch(rows, kinds)
                        rows, held = [], 0
                yield _batch(rows, kinds)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(read, RECORD)


_ARROW = pa.schema(
    [
        ("file", pa.string()), ("at", pa.int64()),
        *[(name, pa.string()) for name in HEADERS],
        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_fits", pa.bool_()),
        ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """(capture_id, request, response, metadata, n_requests, n_responses, n_metadata): a row a capture.

    Records name the one they were made with in concurrent_to; a record that names none is its
    own capture's id. request, response (also a revisit) and metadata are nested records with all
    columns of ``records``, null where the archive has none. Of several of a kind the one with
    the smallest id, then place, is taken, so that no group is gathered; the counts say that
    there are more, and ``surplus`` gives those. Copies of a record count as several. Records of
    other kinds are left out; an empty table gives no rows.
    """
    names = [c for c in records.columns if c not in ("record_id", "file", "at")]
    whole = F.struct("record_id", "file", "at", *names)
    parts = {"request": ["request"], "response": ["response", "revisit"], "metadata": ["metadata"]}
    capture = F.coalesce("concurrent_to", "record_id").alias("capture_id")
    wanted = [k for kinds in parts.values() for k in kinds]
    rows = records.filter(F.col("kind").isin(wanted)).select(capture, "kind", whole.alias("record"))
    is_kind = {part: F.col("kind").isin(kinds) for part, kinds in parts.items()}
    place = F.struct("record.record_id", "record.file", "record.at")
    firsts = [
        F.min_by(F.when(test, F.col("record")), F.when(test, place)).alias(part)
        for part, test in is_kind.items()
    ]
    counts = [
        F.count_if(test).alias(f"n_{part}" if part == "metadata" else f"n_{part}s")
        for part, test in is_kind.items()
    ]
    return rows.groupBy("capture_id").agg(*firsts, *counts)


def surplus(records: DataFrame, captures: DataFrame) -> DataFrame:
    """Records of a capture beyond the first of their kind, as rows."""
    taken = reduce(
        DataFrame.unionByName,
        [
            captures.select(F.col(part)["file"].alias("file"), F.col(part)["at"].alias("at"))
            for part in ("request", "response", "metadata")
        ],
    ).filter("file IS NOT NULL")
    kinds = ["request", "response", "revisit", "metadata"]
    return records.filter(F.col("kind").isin(kinds)).join(taken, ["file", "at"], "left_anti")


def page_captures(captures: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures of ours.

    A revisit's WARC-Refers-To is looked up among the responses; their page_id comes from
    the metadata record. A response that very many revisits name is dealt to many tasks.
    """
    rows = settle(
        captures.filter("response IS NOT NULL").select(
            F.expr("try_cast(metadata.fields['page-id'] AS bigint)").alias("page_id"),
            "response.payload_bytes",
            "response.payload_digest",
            F.col("response.kind").alias("record_type"),
            "response.record_id",
            "response.refers_to_id",
        ),
        "captures",
    )
    answers = rows.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    result = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    known = rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    asked = spread_join(
        rows.filter("record_type <> 'response'"), answers, ["refers_to_id"], ["record_id"]
    )
    return known.select(*result).unionByName(asked.select(*result))


#: The same in SQL: ten hex digits of the SHA-1 are eight digits of base32.
ORACLE = """
WITH rows AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id) AS place,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  translate(concat(
    to_base(('0x' || h[1:10])::BIGINT, 32, 8), to_base(('0x' || h[11:20])::BIGINT, 32, 8),
    to_base(('0x' || h[21:30])::BIGINT, 32, 8), to_base(('0x' || h[31:40])::BIGINT, 32, 8)),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN first_id END AS refers_to
FROM rows
"""
