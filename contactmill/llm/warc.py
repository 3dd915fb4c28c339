"""WARC archives: written from pages, read back, and indexed as capture histories by an external merge of sorted runs.

Writing. Pages of equal payload are one response and revisits of it. Which page that is follows from digests alone, in two
levels (per payload and part, then per payload), so a payload that a third of all pages share never stands in one task. The
payloads of the responses take one shuffle. A record is one string; its trailing CRLF CRLF is the line separator of Spark's
text writer, which makes every file a plain WARC/1.1 stream (compressed as a whole, not record by record), on any file
system Spark can write to, committed like any other table.

Reading. A compressed file is read by one task from its beginning. The pieces between separators are put together again by
the lengths the headers state, one record at a time, whatever separators a payload holds. Digests and lengths are checked.

Index. The captures of an archive, sorted by (URL key, time, record), are a run, written out. Runs are cut at common range
bounds, and the slices of one range are merged by a loser tree into one piece of the global order. Ranges are bounded by a
number of rows, not by URL keys, so a long history spans ranges; captures are numbered by the lengths of its pieces.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator, Sequence
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactmill.llm.common import short_batches, whole_text
from contactmill.session import ensure_checkpoint_dir, materialize

END = "\r\n\r\n"
RANGE_ROWS = 50_000  # captures in one task of the merge
ARCHIVE_RECORDS = 20_000
# fixed values: digits of base 32 as Spark writes numbers, and as RFC 4648 does
_PLAIN32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_URN = "urn:x-page:"
_KEY = ["urlkey", "captured", "record_id"]


def payload_digest(payload: Column) -> Column:
    """SHA-1 in base 32, from 8 pieces of 20 bits."""
    name = F.sha1(payload)
    pieces = [F.lpad(F.conv(F.substring(name, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*pieces), _PLAIN32, _BASE32)


def url_key(url: Column) -> Column:
    """Host names from the top domain down, without user, port and www, then path and query; empty for null.

    A URL without scheme stands for itself, without its fragment.
    """
    head = "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)"
    plain = F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)#.*$", "")
    host = F.lower(F.regexp_extract(plain, head, 1))
    for pattern in ("^.*@", ":[0-9]*$", "^www[0-9]*\\."):
        host = F.regexp_replace(host, pattern, "")
    rest = F.regexp_replace(plain, head, "")
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    surt = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path)
    return F.when(plain.rlike(head), surt).otherwise(plain)


def _time(page_id: Column) -> Column:
    """A capture time for pages that carry none: seconds after 2000 by page number."""
    seconds = F.pmod(F.coalesce(page_id.try_cast("bigint"), F.lit(0)), F.lit(10**9))
    day, rest = F.floor(seconds / 86400).cast("int"), (seconds % 86400).cast("int")
    parts = [F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60]
    clock = F.concat_ws(":", *[F.lpad(p.cast("string"), 2, "0") for p in parts])
    return F.concat(F.date_add(F.lit("2000-01-01").cast("date"), day).cast("string"), F.lit("T"), clock, F.lit("Z"))


def _identity(pages: DataFrame, id_col: str, url_col: str, html_col: str, date_col: str | None) -> DataFrame:
    """page_id, url, captured, payload, and _key, which rows share that are equal in all four."""
    page_id, url = F.col(f"`{id_col}`"), F.col(f"`{url_col}`").cast("string")
    captured = F.col(f"`{date_col}`").cast("string") if date_col else _time(page_id)
    rows = pages.select(
        page_id.alias("page_id"), url.alias("url"), captured.alias("captured"), whole_text(html_col).alias("payload")
    )
    marks = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-"))
             for c in (F.col("page_id").cast("string"), F.col("url"), F.col("captured"))]
    return rows.withColumn("_payload", F.sha2("payload", 256)).withColumn("_key", F.sha2(F.concat(*marks, "_payload"), 256))


def _record_id(page_id: Column, key: Column, copy: Column) -> Column:
    name = F.coalesce(page_id.cast("string"), F.lit(""))
    return F.concat(F.lit(_URN), name, F.lit(":"), F.substring(key, 1, 16), F.lit(":"), copy.cast("string"))


def _decided(rows: DataFrame, min_bytes: int) -> DataFrame:
    """One row per _key: how many rows share it, how many are responses, and whom the others revisit."""
    alike = rows.groupBy("_key").agg(
        *[F.first(c).alias(c) for c in ("page_id", "url", "captured", "_payload")],
        F.first(F.octet_length("payload").cast("bigint")).alias("bytes"),
        F.first(payload_digest(F.col("payload"))).alias("digest"),
        F.count(F.lit(1)).alias("copies"),
    )
    alike = materialize(alike.withColumn("_part", F.spark_partition_id()))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "captured", "_key")
    leaves = alike.groupBy("_payload", "_part").agg(F.min(order).alias("_first"))
    winners = leaves.groupBy("_payload").agg(F.min("_first").alias("first"))
    heads = leaves.select("_payload", "_part").join(winners, "_payload")
    short = F.col("bytes") < min_bytes
    responses = F.when(short, F.col("copies")).otherwise((F.col("_key") == F.col("first._key")).cast("bigint"))
    return alike.join(heads, ["_payload", "_part"]).withColumn("responses", responses)


def _numbered(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """Each row once per number first..last-1, in `copy`."""
    numbers = F.when(first < last, F.sequence(first, last - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("copy", F.explode(numbers))


def _record(kind: str, extra: list[Column], http: Column, length: Column) -> Column:
    """The text of a record without its trailing separator."""
    line = F.lit("\r\n")
    clean = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), line.substr(2, 1), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), _record_id(F.col("page_id"), F.col("_key"), F.col("copy")),
        F.lit(">\r\nWARC-Date: "), F.coalesce("captured", F.lit("")), line,
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), clean, line), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), line, *extra,
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), http,
    )


def records(
    pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    date_col: str | None = None,
) -> DataFrame:
    """One WARC record per page, in column `value`, each without the CRLF CRLF that ends it.

    Null payloads are empty. Of equal payloads of at least min_bytes bytes the one with the smallest page_id is a response
    (null identifiers last; equal ones by URL, then by time; of rows equal in everything exactly one), the others are
    revisits of it; smaller ones are all responses. A null URL gives a record without target. Columns that are not named,
    whatever they are called, are not read. No rows give no records.
    """
    rows = _identity(pages, id_col, url_col, html_col, date_col)
    decided = materialize(_decided(rows, min_bytes))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    payloads = rows.groupBy("_key").agg(F.first("payload").alias("payload"))  # equal rows meet before the shuffle
    full = _numbered(decided.where("responses > 0").join(payloads, "_key"), F.lit(0).cast("bigint"), F.col("responses"))
    responses = full.select(_record("response", [], F.concat(head, "payload"), F.octet_length(head) + F.col("bytes")).alias("value"))
    target = _record_id(F.col("first.page_id"), F.col("first._key"), F.lit(0))
    extra = [
        F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"),
        target, F.lit(">\r\n"),
    ]
    again = _numbered(decided, F.col("responses"), F.col("copies"))
    return responses.unionByName(again.select(_record("revisit", extra, head, F.octet_length(head)).alias("value")))


def write_archives(pages: DataFrame, path: str, **options) -> None:
    """The records of pages as archives in the folder `path`, at most ARCHIVE_RECORDS in each."""
    writer = records(pages, **options).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


def _streamed(pieces: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
    """(archive, offset, headers, block) of every record; pieces come in the order of the archive."""
    end, name, buffer, offset = END.encode(), None, bytearray(), 0
    headers: dict[str, str] | None = None
    size = 0

    def closed() -> None:
        if headers is not None or buffer.strip(b"\r\n"):
            raise ValueError(f"{name} ends inside a record")

    for archive, piece in pieces:
        if archive != name:
            closed()
            name, offset = archive, 0
            buffer.clear()
        buffer += piece + end
        while True:
            if headers is None:
                size = buffer.find(end)
                if size <= 0:
                    break
                lines = buffer[:size].decode().split("\r\n")
                headers = dict(line.split(": ", 1) for line in lines[1:])
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"no record at {offset} of {name}")
                size += len(end)
            total = size + int(headers["Content-Length"])
            if len(buffer) < total + len(end):
                break
            if buffer[total : total + len(end)] != end:
                raise ValueError(f"the record at {offset} of {name} has another length than it states")
            yield name, offset, headers, bytes(buffer[size:total])
            del buffer[: total + len(end)]
            offset, headers = offset + total + len(end), None
    closed()


def _capture(archive: str, offset: int, headers: dict[str, str], block: bytes) -> dict:
    """One row of the index; the payload of a response must be what its headers say."""
    http, _, payload = block.partition(END.encode())
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    size, digest = int(stated["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if headers["WARC-Type"] == "response":
        found = base64.b32encode(sha1(payload).digest()).decode()
        if len(payload) != size or found != digest:
            raise ValueError(f"the payload at {offset} of {archive} is damaged")
    refers = headers.get("WARC-Refers-To")
    return {
        "archive": archive, "offset": offset, "record_type": headers["WARC-Type"], "record_id": headers["WARC-Record-ID"][1:-1],
        "refers_to_record": refers and refers[1:-1], "url": headers.get("WARC-Target-URI"), "captured": headers["WARC-Date"],
        "payload_bytes": size, "payload_digest": digest,
    }


_INDEX = (
    "archive STRING, offset BIGINT, record_type STRING, record_id STRING, refers_to_record STRING, url STRING, "
    "captured STRING, payload_bytes BIGINT, payload_digest STRING"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in `path`: where it is and what its headers say, payloads checked.

    Memory is bounded by the longest record. Damaged archives raise.
    """
    schema = pa.schema([(f.split()[0], pa.int64() if "BIGINT" in f else pa.string()) for f in _INDEX.split(", ")])
    pieces = spark.read.option("lineSep", END).text(path)
    pieces = pieces.select(F.col("_metadata.file_name").alias("archive"), F.col("value").cast("binary").alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for record in _streamed((a.as_py(), p.as_py()) for b in batches for a, p in zip(b.column(0), b.column(1), strict=True)):
            rows.append(_capture(*record))
            if len(rows) == 1000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema)

    return short_batches(pieces, 200).mapInArrow(run, _INDEX)


def merge_order(runs: Sequence[Sequence]) -> Iterator[tuple[int, int]]:
    """(run, place) of all entries of sorted runs in one order, by a tree of losers; equal entries by run.

    Inner node i of the tree remembers the run that lost there; a new head of the winning run plays upwards against the
    losers on its path only.
    """
    k, places = len(runs), [0] * len(runs)
    losers: list[int | None] = [None] * max(k, 1)

    def beats(a: int, b: int) -> bool:
        if places[a] == len(runs[a]) or places[b] == len(runs[b]):
            return places[b] == len(runs[b]) and (places[a] < len(runs[a]) or a < b)
        x, y = runs[a][places[a]], runs[b][places[b]]
        return x < y or (x == y and a < b)

    def replay(run: int) -> int | None:
        """The new champion; while the tree fills up, a run waits at the first empty node it meets."""
        node, champion = (run + k) // 2, run
        while node:
            other = losers[node]
            if other is None:
                losers[node] = champion
                return None
            if beats(other, champion):
                losers[node], champion = champion, other
            node //= 2
        return champion

    champion = None
    for run in range(k):
        champion = replay(run)
    while champion is not None and places[champion] < len(runs[champion]):
        yield champion, places[champion]
        places[champion] += 1
        champion = replay(champion)


def _merged_slices(table: pa.Table) -> pa.Table:
    """Rows of one range, run after run and sorted in each, in the order of all; _n counts captures of a URL key."""
    keys = list(zip(*[table[c].to_pylist() for c in _KEY], strict=True))
    names = table["_run"].to_pylist()
    starts = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
    runs = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
    order = [starts[run] + place for run, place in merge_order(runs)]
    counts, before = [], None
    for i in order:
        counts.append(counts[-1] + 1 if counts and keys[i][0] == before else 1)
        before = keys[i][0]
    return table.take(pa.array(order, pa.int64())).append_column("_n", pa.array(counts, pa.int64()))


def capture_histories(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The rows of an index of archives in the global order of (URL key, time, record), with urlkey and capture.

    `capture` numbers the captures of a URL key from 1. Rows lie in the order of the histories, range after range.
    """
    keyed = index.withColumn("urlkey", url_key(F.col("url"))).withColumnRenamed("archive", "_run")
    runs = keyed.sortWithinPartitions("_run", *_KEY).withColumn("_place", F.monotonically_increasing_id())
    runs = materialize(runs)
    ranges = max(1, -(-runs.count() // range_rows))
    slices = runs.repartitionByRange(ranges, *_KEY).sortWithinPartitions("_run", "_place").drop("_place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(batches)  # one range
        if found:
            yield from _merged_slices(pa.Table.from_batches(found)).to_batches(1000)

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slices.schema)
    merged = slices.mapInArrow(run, f"{shape}, _n BIGINT").withColumn("_range", F.spark_partition_id())
    merged = materialize(merged)
    pieces = merged.groupBy("urlkey", "_range").agg(F.max("_n").alias("_long"))
    earlier = Window.partitionBy("urlkey").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("urlkey", "_range", F.coalesce(F.sum("_long").over(earlier), F.lit(0)).alias("_before"))
    numbered = merged.join(starts, ["urlkey", "_range"]).withColumn("capture", F.col("_n") + F.col("_before"))
    return numbered.drop("_n", "_before", "_range").withColumnRenamed("_run", "archive")


def archived(pages: DataFrame, id_col: str = "page_id", **options) -> DataFrame:
    """Pages written as WARC archives and read back: one row per record of the merged index.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, urlkey, captured, capture, and where the record
    is (archive, offset in its uncompressed stream). Rules and odd rows as in `records`; a revisit of a page without
    identifier has a null refers_to.
    """
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, id_col=id_col, **options)
    id_type = pages.select(F.col(f"`{id_col}`").alias("page_id")).schema["page_id"].dataType

    def page_of(record: str) -> Column:
        """The identifier may itself hold colons; what follows it never does."""
        name = F.regexp_extract(record, f"(?s)^{_URN}(.*):[0-9a-f]+:[0-9]+$", 1)
        return F.when(name != "", name).cast(id_type)

    found = capture_histories(read_archives(spark, path))
    return found.select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of("refers_to_record").alias("refers_to"), "url", "urlkey", "captured", "capture", "archive", "offset",
    )
