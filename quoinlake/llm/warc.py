"""WARC archives: captures to record files, and record files to one nested row per capture.

Each capture is a transaction of three records: request, response (or revisit) and
metadata. The request and the metadata name the response through WARC-Concurrent-To, and
reading joins them through that field, whatever files they lie in. Among captures with
equal payloads of at least `least_bytes` the one with the smallest id is the response and
the others are revisits, which hold headers only and name the response in WARC-Refers-To.

Files are written by Spark's text writer, whose line separator is the blank lines that end
a record, and fetched by its binary reader; a record is cut by its Content-Length, so a
payload may hold anything. Archives of other writers are read too: plain ones and those of
a gzip member a record, names of headers in any case, folded values; records are taken from
the stream one by one. A truncated archive is an error. A file must stay below 2 GB, the
most that the binary reader takes; those written here are as many as the shuffle's partitions.

Defined results: NULL html is an empty payload, NULL url an empty target; rows without an
id are not captures and are left out; of rows that repeat an id each is a capture of its
own, numbered within the id; an empty table gives no captures; other columns are ignored.
"""

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoinlake.workspace import new_folder, stored

END = "\r\n\r\n"
HTTP_OK = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, record_type string, concurrent_to string, refers_to string, target string, captured string, "
    "declared string, payload binary, payload_bytes long, payload_digest string"
)
# Digits of base 32 as conv() writes them, and those of RFC 4648.
CONV_DIGITS, BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 5 hex digits are 4 of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(c), i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def captures(df: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Canonical captures: id, n (number of the row within its id), url, payload, digest, octets."""
    rows = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
    )
    return rows.withColumns({"digest": sha1_base32(F.col("payload")), "octets": F.octet_length("payload")})


def with_revisits(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add `n`, which numbers equal rows of an id, and for repeats of a payload the response's id as `first`.

    Only ids, digests and sizes are shuffled to find the first of each repeated digest. One
    digest may hold most rows: minima combine before the shuffle and the join splits skewed
    sides. The payloads move once, for the numbering and the join alike.
    """
    slim = rows.where(F.col("octets") >= least_bytes).select("id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    facts = slim.join(firsts.where("copies > 1").drop("copies"), "digest").select("id", "digest", "first").distinct()
    equal = Window.partitionBy("id", "digest").orderBy("url")
    numbered = rows.withColumn("n", F.row_number().over(equal)).join(facts, ["id", "digest"], "left")
    return numbered.withColumn("first", F.when((F.col("first") != F.col("id")) | (F.col("n") > 1), F.col("first")))


def _uuid(kind: str, *of: Column) -> Column:
    """A URN from the MD5 of what it names: the same in every run and on a retried task."""
    h = F.md5(F.concat_ws("/", F.lit(kind), *[c.cast("string") for c in of]))
    dashed = F.concat_ws("-", *[F.substring(h, i, n) for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: str, record_id: Column, fields: dict[str, Column], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind)),
             F.concat(F.lit("WARC-Record-ID: "), record_id)]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in fields.items()]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def _one_line(c: Column) -> Column:
    """A header value: line breaks, percent signs and the ends' blanks as percent codes."""
    for plain, coded in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), (" ", "%20"), ("\t", "%09")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def write_warc(rows: DataFrame, folder: str, captured: str = "2025-01-01T00:00:00Z") -> None:
    """Write captures (see `with_revisits`) as gzip files of WARC records."""
    key = (F.col("id"), F.col("digest"), F.col("n"))
    me, url = _uuid("response", *key), _one_line(F.col("url"))
    first = _uuid("response", F.col("first"), F.col("digest"), F.lit(1))
    common = {"WARC-Date": F.lit(captured), "WARC-Target-URI": url}
    digest = {"WARC-Payload-Digest": F.concat(F.lit("sha1:"), F.col("digest"))}
    response = _record("response", me, {**common, **digest}, F.concat(F.lit(HTTP_OK), F.col("payload")))
    revisit = _record(
        "revisit", me, {**common, **digest, "WARC-Profile": F.lit(PROFILE), "WARC-Refers-To": first}, F.lit(HTTP_OK)
    )
    request = _record(
        "request", _uuid("request", *key), {**common, "WARC-Concurrent-To": me},
        F.concat(F.lit("GET / HTTP/1.1\r\nHost: "), F.regexp_extract("url", "^[a-z]+://([^/\\s]*)", 1), F.lit(END)),
    )
    metadata = _record(
        "metadata", _uuid("metadata", *key), {**common, "WARC-Concurrent-To": me},
        F.concat(F.lit("capture-id: "), F.col("id").cast("string"), F.lit("\r\n")),
    )
    main = F.when(F.col("first").isNull(), response).otherwise(revisit)
    records = rows.select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("lineSep", END).option("compression", "gzip").text(folder)


def records_of(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, one at a time."""
    file = opened(content)
    while line := file.readline():
        if not line.startswith(b"WARC/"):  # blank lines between records
            continue
        fields, name = {}, ""
        while (line := file.readline()).strip():
            text = line.decode(errors="replace")
            if text[0] in " \t":  # a value goes on
                fields[name] += " " + text.strip()
                continue
            name, _, value = text.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
        block = file.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]):
            raise EOFError(f"archive ends within record {fields.get('warc-record-id')}")
        yield fields, block


def opened(content: bytes) -> BinaryIO:
    """An archive, plain or of any number of gzip members, as a stream."""
    plain = io.BytesIO(content)
    return gzip.GzipFile(fileobj=plain) if content[:2] == b"\x1f\x8b" else plain


def _parse(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    for batch in files:
        for content in batch["content"]:
            rows, held = [], 0
            for h, block in records_of(bytes(content)):
                is_http = h["warc-type"] == "response"
                head = block.find(b"\r\n\r\n") if is_http else -1
                payload = b"" if h["warc-type"] == "revisit" else block[head + 4 :] if head >= 0 else block
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if is_http else None
                rows.append((
                    h.get("warc-record-id"), h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"),
                    h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), payload,
                    len(payload), digest,
                ))
                held += len(payload)
                if held > 8_000_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record. The digest is computed from the payload read, not copied."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    records = files.mapInPandas(_parse, RECORD)
    plain = F.col("target")
    for coded, text in (("%09", "\t"), ("%20", " "), ("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        plain = F.replace(plain, F.lit(coded), F.lit(text))
    return records.withColumn("target", plain)


def transactions(records: DataFrame, contents: bool = True) -> DataFrame:
    """One nested row per capture, joined through the concurrent-to ids.

    `response` holds type, digest and size of the full payload; a revisit takes its size
    from the response it refers to. Without `contents` payloads are not carried along.
    A capture without request or metadata keeps NULL there.
    """
    kept = ["record_id", "target", "captured"]
    about = records.where("record_type in ('request', 'metadata')").groupBy("concurrent_to").agg(
        *[F.min(F.when(F.col("record_type") == k, F.struct(*kept, "payload"))).alias(k) for k in ("request", "metadata")]
    ).withColumnRenamed("concurrent_to", "record_id")
    body = ["payload"] if contents else []
    main = records.where("record_type in ('response', 'revisit')")
    full = main.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"),
        F.col("payload_digest").alias("full_digest"),
    )
    again = main.where("record_type = 'revisit'").join(full, "refers_to", "left").withColumns({
        "payload_bytes": F.col("full_bytes"), "payload_digest": F.col("full_digest"),
    })
    main = main.where("record_type = 'response'").unionByName(again.select(*main.columns))
    response = F.struct(*kept, "record_type", "refers_to", "payload_bytes", "payload_digest", "declared", *body)
    return main.select("record_id", response.alias("response")).join(about, "record_id", "left").select(
        "record_id", "request", "response", "metadata"
    )


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC, read the files back, assemble the transactions and digest them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "warc")
    write_warc(with_revisits(captures(pages, "page_id", "url", "html")), folder)
    records = read_records(spark, folder)
    slim = records.withColumn("payload", F.when(F.col("record_type") == "metadata", F.col("payload")))
    whole = transactions(stored(slim, "records"), contents=False)
    page_id = F.regexp_extract(F.decode(F.col("metadata.payload"), "UTF-8"), r"capture-id: (-?\d+)", 1).cast("bigint")
    whole = whole.withColumn("page_id", page_id)
    facts = ["page_id", "response.payload_bytes", "response.payload_digest", "response.record_type"]
    whole = stored(whole.select(*facts, "record_id", "response.refers_to"), "transactions")
    named = whole.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("first_id")
    )
    again = whole.where("record_type = 'revisit'").join(named, "refers_to", "left").drop("refers_to")
    rest = whole.where("record_type = 'response'").drop("refers_to").withColumn("first_id", F.lit(None).cast("bigint"))
    return rest.unionByName(again).drop("record_id").withColumnRenamed("first_id", "refers_to")


_B32 = "".join(
    f"|| substr('{BASE32_DIGITS}', (((('0x' || substr(h, {1 + 5 * i}, 5))::bigint) >> {15 - 5 * j}) & 31)::bigint + 1, 1)"
    for i in range(8) for j in range(4)
)[3:]

WARC_SQL = f"""
with t as (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as h from pages),
f as (select *, min(page_id) over (partition by h) as f from t)
select page_id, octet_length(encode(p))::bigint as payload_bytes, {_B32} as payload_digest,
    case when f = page_id then 'response' else 'revisit' end as record_type,
    case when f <> page_id then f end as refers_to
from f
"""
