"""WARC archives: writing with revisit records, reading by boundary chains.

Writing stays in Spark's text writer: a record is one text value and the writer's
line end closes it, so the files are plain WARC 1.0 wherever Spark can write.

Reading stays in Spark's text reader with the magic line ``WARC/1.0`` as separator,
so archives are split like any text and need no task that holds a file.  Every piece
between two magics is a *candidate* record; a task knows its offset in its split and,
from its own Content-Length, the offset of its successor.  Candidates inside payloads
(an archived page may quote a WARC file) are not records: pointer jumping from offset
zero of each file, doubling the hop each round, keeps only the reachable ones.
A record whose payload holds the magic line is put together from its pieces.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, written

MAGIC = "WARC/1.0\r\n"
MIN_REVISIT_BYTES = 1000
SMALL_ROWS = 200_000  # rows of (hash, id) that may be broadcast: some 10 MB
_BLOCK = 1 << 20


def _line(value):
    """A header value: control characters would end the line or the header."""
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[\x00-\x1f\x7f]", "%20")


def revisits(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest and refers_to.

    Of rows with equal payloads of at least ``min_bytes`` bytes the largest id is the
    original; the others refer to it.  Rows that repeat the largest id are originals
    too; with only null ids all are.  Originals are found by a partial maximum for each
    digest, so a payload shared by a third of all rows costs one row for each task."""
    data = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    keyed = pages.withColumns({"payload_bytes": F.octet_length(data).cast("long"), "payload_digest": F.sha1(data)})
    shared = (
        pages.select(F.col(id_col).alias("_id"), F.sha1(data).alias("payload_digest"), F.octet_length(data).cast("long").alias("payload_bytes"))
        .where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("_id").alias("_original"), F.count("*").alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    shared = written(shared, "originals")
    few = shared.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    joined = keyed.join(F.broadcast(shared) if few else shared, ["payload_digest", "payload_bytes"], "left")
    other = F.col("_original").isNotNull() & (F.col(id_col).isNull() | (F.col(id_col) < F.col("_original")))
    return joined.withColumn("refers_to", F.when(other, F.col("_original"))).drop("_original")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One record per row, in as many archives as ``pages`` has partitions."""
    rows = revisits(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("payload")), "id", "payload")
    is_revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n")
    )
    body = F.when(is_revisit, F.lit("")).otherwise(F.coalesce(F.col("payload").cast("string"), F.lit("")))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">\r\n"))
    block_bytes = F.octet_length(http) + F.when(is_revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        urn(F.col("id")),
        F.lit("WARC-Target-URI: "),
        _line(F.col("url")),
        F.lit("\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"),
        F.col("payload_digest"),
        F.when(
            is_revisit,
            F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), urn(F.col("refers_to"))),
        ).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        block_bytes.cast("string"),
        F.lit("\r\n\r\n"),
        http,
        body,
        F.lit("\r\n\r"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\n").text(path)


CANDIDATE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("rel", T.LongType()),
        T.StructField("span", T.LongType()),
        T.StructField("head", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("http", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("declared", T.LongType()),
        T.StructField("sha1", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
_FIELD = re.compile(rb"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*?)[ \t]*$")


def _header(data: bytes) -> tuple[int, dict] | None:
    """Length up to and with the empty line, and lower-case fields; None if malformed."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in data[:end].split(b"\r\n"):
        m = _FIELD.match(line)
        if m is None:
            return None
        fields[m[1].decode("ascii").lower()] = m[2].decode("utf-8", "replace")
    return end + 4, fields


def _number(fields: dict) -> int | None:
    value = fields.get("content-length", "")
    return int(value) if value.isascii() and value.isdigit() and len(value) < 19 else None


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _candidates(pieces: DataFrame, keep_payload: bool) -> DataFrame:
    def run(batches):
        at, rel = None, 0
        for batch in batches:
            out = []
            for value, file, start in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                if (file, start) != at:
                    at, rel = (file, start), 0
                data = value.as_py() or b""
                span = len(data) + len(MAGIC)
                row = {"file": file, "start": start, "rel": rel, "span": span}
                parsed = _header(data)
                block = _number(parsed[1]) if parsed else None
                if block is not None and "warc-type" in parsed[1]:
                    head, fields = parsed
                    row |= {"head": head, "block": block, "headers": list(fields.items()), "http": 0}
                    content = data[head : head + block]
                    if fields.get("content-type", "").startswith("application/http") and (inner := content.find(b"\r\n\r\n")) >= 0:
                        row["http"] = inner + 4
                        status = content.find(b"\r\n")
                        http = _header(content[status + 2 : inner + 4]) if status < inner else None
                        row["declared"] = _number(http[1]) if http else None
                    if len(content) == block:
                        payload = content[row["http"] :]
                        row["sha1"] = hashlib.sha1(payload).hexdigest()
                        if keep_payload:
                            row["payload"] = payload
                out.append(row)
                rel += span
            if out:
                columns = [pa.array([r.get(f.name) for r in out], t) for f, t in zip(CANDIDATE, _ARROW)]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in CANDIDATE])

    return pieces.mapInArrow(run, CANDIDATE)


_ARROW = [pa.string(), *[pa.int64()] * 6, pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.binary()]


def reachable(candidates: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Of (fid, at, next) the (fid, at) on the chain from offset 0 of each file.

    Round k holds for each candidate the one 2**k hops ahead.  Each round marks what the
    marked ones point at and doubles the hops, so a file of n records takes log2(n)
    rounds, each ending in a written table."""
    hops = candidates.select("fid", "at", F.col("next").alias("to"), (F.col("at") == 0).alias("on"))
    hops = written(hops, "hops")
    for _ in range(max_rounds):
        marked = hops.where("on and to is not null").select("fid", F.col("to").alias("at")).distinct().withColumn("hit", F.lit(True))
        ahead = hops.select("fid", F.col("at").alias("to"), F.col("to").alias("beyond"))
        stepped = (
            hops.join(ahead, ["fid", "to"], "left")
            .join(marked, ["fid", "at"], "left")
            .select("fid", "at", F.col("beyond").alias("to"), (F.col("on") | F.coalesce("hit", F.lit(False))).alias("on"))
        )
        hops = written(stepped, "hops")
        if hops.where("to is not null").isEmpty():
            return hops.where("on").select("fid", "at")
    raise RuntimeError(f"chains are longer than 2**{max_rounds} records")


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of the archives under ``path``: file, at (offset), headers (map, keys in
    lower case), declared (HTTP Content-Length), payload_bytes, sha1 (of the payload in
    the record) and, on request, payload.

    Bytes that no chain from a file's start reaches are no records; a file that does
    not start with the magic line has none; a chain ends where a header is malformed.
    A last record that is cut short keeps null sha1 and payload."""
    found = _candidates(_pieces(spark, path), payloads)
    found = written(found, "candidates")
    totals = found.groupBy("file", "start").agg(F.sum("span").alias("total"))
    before = F.coalesce(F.sum("total").over(_window()), F.lit(0))
    bases = totals.select("file", "start", before.alias("base"))
    placed = found.join(F.broadcast(bases) if bases.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else bases, ["file", "start"])
    placed = placed.withColumns({"fid": F.xxhash64("file"), "at": F.col("base") + F.col("rel") - len(MAGIC)})
    good = placed.where("block is not null and at >= 0")
    nodes = good.select("fid", "at", (F.col("at") + len(MAGIC) + F.col("head") + F.col("block") + 4).alias("next"))
    records = good.join(reachable(nodes), ["fid", "at"], "left_semi")
    torn = written(
        records.where("sha1 is null").select("fid", "at", F.col("rel").alias("first_rel"), F.col("start").alias("first_start"), "head", "block", "http"), "torn"
    )
    if not torn.isEmpty():
        whole = _put_together(spark, path, placed, torn)
        records = records.join(whole, ["fid", "at"], "left").withColumns(
            {"sha1": F.coalesce("sha1", "whole_sha1"), "payload": F.coalesce("payload", "whole") if payloads else F.col("payload")}
        )
    columns = ["file", "at", "headers", "declared", (F.col("block") - F.col("http")).alias("payload_bytes"), "sha1"]
    return records.select(*columns, *(["payload"] if payloads else []))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)


def _put_together(spark: SparkSession, path: str, placed: DataFrame, torn: DataFrame) -> DataFrame:
    """(fid, at, whole_sha1, whole) of records whose payload holds the magic line.

    Pieces meet their record by an equi-join on megabyte blocks of the file (records do
    not overlap, so a piece has at most one), then their bytes are read again."""
    end = F.col("at") + len(MAGIC) + F.col("head") + F.col("block")
    spans = torn.select("fid", "at", "head", "block", "http", end.alias("end")).withColumn(
        "mega", F.explode(F.sequence(F.floor(F.col("at") / _BLOCK), F.floor(F.col("end") / _BLOCK)))
    )
    parts = placed.select("file", "start", "rel", "fid", F.col("at").alias("piece_at"), F.floor(F.col("at") / _BLOCK).alias("mega"))
    wanted = written(
        parts.join(spans, ["fid", "mega"]).where("piece_at >= at and piece_at < end").select("file", "start", "rel", "fid", "at", "piece_at", "head", "block", "http"),
        "parts",
    )

    def run(batches):
        at, rel = None, 0
        for batch in batches:
            rels = []
            for value, file, start in zip(batch.column("value"), batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                if (file, start) != at:
                    at, rel = (file, start), 0
                rels.append(rel)
                rel += len(value.as_py() or b"") + len(MAGIC)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("start"), pa.array(rels, pa.int64()), batch.column("value")], ["file", "start", "rel", "value"])

    again = _pieces(spark, path).mapInArrow(run, "file string, start long, rel long, value binary")
    small = wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    bytes_of = again.join(F.broadcast(wanted) if small else wanted, ["file", "start", "rel"])
    joined = F.aggregate(
        F.array_sort(F.collect_list(F.struct("piece_at", "value"))),
        F.lit(b"").cast("binary"),
        lambda acc, x: F.concat(acc, F.lit(MAGIC.encode()), x["value"]),
    )
    whole = bytes_of.groupBy("fid", "at", "head", "block", "http").agg(joined.alias("data"))
    payload = F.expr(f"substring(data, cast({len(MAGIC) + 1} + head + http as int), cast(block - http as int))")
    complete = F.octet_length("data") >= len(MAGIC) + F.col("head") + F.col("block")
    return whole.select("fid", "at", F.when(complete, payload).alias("whole")).withColumn("whole_sha1", F.sha1("whole"))


def op1_warc(spark, sf_dir):
    """Null html is an empty payload; null urls are empty; null ids read back as null."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = new_path(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path)
    page = lambda name: F.expr(f"try_cast(regexp_extract(headers['{name}'], '^<urn:x-page:(-?[0-9]+)>$', 1) as bigint)")
    kind = F.col("headers")["warc-type"]
    named = F.regexp_extract(F.col("headers")["warc-payload-digest"], "^sha1:([0-9a-f]{40})$", 1)
    return records.select(
        page("warc-record-id").alias("page_id"),
        F.when(kind == "revisit", F.col("declared")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(kind == "revisit", named).otherwise(F.col("sha1")).alias("payload_digest"),
        kind.alias("record_type"),
        page("warc-refers-to").alias("refers_to"),
    )


ORACLE_OP1 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS original FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN original > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN original > page_id THEN original END AS refers_to
FROM m
"""
