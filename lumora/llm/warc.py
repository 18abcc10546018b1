"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Every response gives two records. The ``metadata`` record (application/warc-fields) holds title, language,
charset, the source's HTTP headers and digest, and the outlinks in order; the ``conversion`` record
(text/plain) holds the text of the page. Both name the response in WARC-Refers-To, keep its target URI and
date, and carry digests of their own block. Record ids are derived from the source's id and digest, so a
repeated run, or a task that runs again, gives the same records.

Derivation is column expressions, one pass without a shuffle. WARC files are written by Spark's text source, and
read by it in pieces between empty lines, as bytes; the pieces of a file are put in order and cut into records by
Content-Length, one record at a time, so a payload may hold any bytes, empty lines or record headers. Files of several
splits are drawn together by one shuffle on the file; compressed files are one split in any case.

Nulls and odd rows: a null URL or date is an empty one, a null payload an empty one, and its records are still
made, with empty fields; line ends in a URL or date are percent-encoded in records; repeated responses give repeated
records with equal ids; very long payloads are records like others; an empty table gives an empty result; extra columns pass
through where they are named in ``keep``. Payloads that are no UTF-8 are decoded with replacements, while the source's own
payload digest and headers are kept as they are. A record that is cut off at the end of a file is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "1970-01-01T00:00:00Z"
#: White space that is not one blank, blanks in a row, and a line's end with more around it: what is one already stays.
_SPACE, _SPACES, _LINE = r"[ \t\r\n\f\x0B]{2,}|[\t\r\n\f\x0B]", r" {2,}", r" \n[ \n]*|\n[ \n]+"
_QUOTES = r"^[\"\x27]|[\"\x27]$"
# Entities that are decoded, "&amp;" last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&amp;", "&"))
#: What is no text, from left to right: comments, scripts, styles and the head.
_DROP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>"
#: Numeric entities: decimal or hexadecimal, up to 7 digits.
_NUMERIC = r"&#[xX]?[0-9A-Fa-f]{1,7};"
_BREAK = r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|article|section|aside|main|nav|header|footer|tr|table|blockquote|pre|form|body|html)\b[^>]*>"
_TITLE, _LANG = r"(?is)<title[^>]*>(.*?)</title", r'(?is)<html[^>]*\blang=["\x27]?([^"\x27\s>]*)'
#: A link's address stands in double quotes, single quotes or none; the quote is taken off afterwards.
_CHARSET, _LINK = r'(?is)<meta[^>]*\bcharset=["\x27]?([A-Za-z0-9_-]+)', r'(?is)<a\b[^>]*\bhref=("[^"]*"|\x27[^\x27]*\x27|[^\s"\x27>]+)'


def _character(entity: Column) -> Column:
    """The character of a numeric entity; one that names no character stays as it is."""
    hexadecimal = F.substring(entity, 3, 1).isin("x", "X")
    code = F.when(hexadecimal, F.conv(F.regexp_extract(entity, "^&#[xX]([0-9A-Fa-f]+);$", 1), 16, 10)).otherwise(F.regexp_extract(entity, "^&#([0-9]+);$", 1)).try_cast("bigint")
    fine = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(fine, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def _entities(text: Column) -> Column:
    numeric = F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(_NUMERIC), F.lit(0))), text, lambda t, e: F.replace(t, e, _character(e)))
    out = F.when(F.contains(text, F.lit("&#")), numeric).otherwise(text)
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), out).otherwise(text)


def _one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(_entities(text), _SPACE, " "))


def _bare_text(html: Column) -> Column:
    """A page without comments, scripts, styles, head and tags, a line for each block; entities stand as they are."""
    html = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _DROP, " "), _SPACE, " "), _BREAK, "\n")
    return F.regexp_replace(html, r"<[^>]*>", "")


def _tidy(bare: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(_entities(bare), _SPACES, " "), _LINE, "\n")
    return F.btrim(text, F.lit(" \n"))


def html_to_text(html: Column) -> Column:
    """Plain text of a page: no comments, scripts, styles or head; a line for each block; entities decoded."""
    return _tidy(_bare_text(html))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _record_id(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def responses(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: Column | None = None, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Response records of pages: record_id, target_uri, date, http_headers, payload, payload_digest."""
    rows = pages.select(*keep, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("target_uri"), F.coalesce(F.lit(DATE) if date is None else date, F.lit("")).alias("date"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("http_headers", F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload").cast("string"))).withColumn("payload_digest", _digest(F.col("payload")))
    return rows.withColumn("record_id", _record_id(F.lit("response"), F.col("_id"), F.col("target_uri"), F.col("payload_digest"))).select(*keep, "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")


_DERIVED = frozenset("record_type record_id refers_to target_uri date content_type source_headers source_digest block content_length block_digest _title _lang _charset _links _bare".split())


def derive(source: DataFrame, *, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two records of each response: record_type, record_id, refers_to, target_uri, date, content_type,
    source_headers, source_digest, block, content_length, block_digest. A kept column with the name of one of them, or of one that
    is worked out on the way, is an error (ValueError)."""
    clash = sorted(set(keep) & _DERIVED)
    if clash:
        raise ValueError(f"the kept columns hold the names of new ones: {clash}; give them other names")
    html = F.col("payload")
    found = {"_title": F.regexp_extract(html, _TITLE, 1), "_lang": F.regexp_extract(html, _LANG, 1), "_charset": F.regexp_extract(html, _CHARSET, 1), "_links": F.regexp_extract_all(html, F.lit(_LINK), 1), "_bare": _bare_text(html)}
    # columns of their own: what is read more than once is computed once
    source = source.select("*", *[v.alias(k) for k, v in found.items()])
    fields = F.concat(
        F.lit("title: "), _one_line(F.col("_title")), F.lit(CRLF + "language: "), _one_line(F.col("_lang")), F.lit(CRLF + "charset: "), F.col("_charset"),
        F.lit(CRLF + "source-headers: "), F.replace(F.col("http_headers"), F.lit(CRLF), F.lit("; ")), F.lit(CRLF + "source-payload-digest: "), F.col("payload_digest"), F.lit(CRLF),
        F.array_join(F.transform("_links", lambda x: F.concat(F.lit("outlink: "), _one_line(F.regexp_replace(x, _QUOTES, "")), F.lit(CRLF))), ""),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), _tidy(F.col("_bare")).alias("block")),
    )
    rows = source.select(*keep, F.col("record_id").alias("refers_to"), "target_uri", "date", F.col("http_headers").alias("source_headers"), F.col("payload_digest").alias("source_digest"), F.inline(kinds))
    rows = rows.withColumn("record_id", _record_id(F.col("record_type"), F.col("refers_to"), F.col("source_digest")))
    return rows.select(*keep, "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_headers", "source_digest", "block", F.octet_length("block").cast("bigint").alias("content_length"), _digest(F.col("block")).alias("block_digest"))


def record_text(record_type: Column, record_id: Column, target_uri: Column, date: Column, content_type: Column, block: Column, refers_to: Column | None = None, payload_digest: Column | None = None) -> Column:
    """A whole WARC record, without the two line ends after it."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{CRLF}{name}: "), F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))

    more = [line("WARC-Refers-To", refers_to)] if refers_to is not None else []
    more += [line("WARC-Payload-Digest", payload_digest)] if payload_digest is not None else []
    return F.concat(F.lit("WARC/1.1"), line("WARC-Type", record_type), line("WARC-Record-ID", record_id), *more, line("WARC-Target-URI", target_uri), line("WARC-Date", date), line("WARC-Block-Digest", _digest(block)), line("Content-Type", content_type), line("Content-Length", F.octet_length(block).cast("string")), F.lit(CRLF * 2), block)


def write_warc(records: DataFrame, path: str, *, compression: str = "none") -> None:
    """Write a one-column table of record texts as WARC files, a file for each partition."""
    records.write.option("lineSep", CRLF * 2).option("compression", compression).text(path)


def response_texts(source: DataFrame) -> DataFrame:
    block = F.concat("http_headers", F.lit(CRLF * 2), "payload")
    return source.select(record_text(F.lit("response"), F.col("record_id"), F.col("target_uri"), F.col("date"), F.lit("application/http; msgtype=response"), block, payload_digest=F.col("payload_digest")).alias("value"))


def derived_texts(derived: DataFrame) -> DataFrame:
    return derived.select(record_text(F.col("record_type"), F.col("record_id"), F.col("target_uri"), F.col("date"), F.col("content_type"), F.col("block"), refers_to=F.col("refers_to")).alias("value"))


class RecordReader:
    """Cuts the bytes of a file into WARC records. Bytes come in parts; what is held is at most one record and a part."""

    def __init__(self) -> None:
        self.held, self.size, self.head, self.need = [], 0, None, 0

    def feed(self, part: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Headers and block of each record that is complete."""
        self.held.append(part)
        self.size += len(part)
        while self.size >= self.need:
            data = b"".join(self.held)
            if self.head is None:
                data = data.lstrip(b"\r\n")
                at = data.find(b"\r\n\r\n")
                self.held, self.size = [data], len(data)
                if at < 0:
                    return
                self.head, data = data[:at], data[at + 4 :]
                length = _header(self.head, b"content-length")
                self.need = int(length) if length.isdigit() else 0
                self.held, self.size = [data], len(data)
            else:
                yield self.head, data[: self.need]
                self.held, self.size = [data[self.need :]], len(data) - self.need
                self.head, self.need = None, 0


def _header(head: bytes, name: bytes) -> bytes:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return b""


_RESPONSE = "record_id string, target_uri string, date string, http_headers string, payload string, payload_digest string, warc_headers string"


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, with the columns that ``derive`` takes, and the record's own headers as ``warc_headers``.
    Other record types are skipped. The payload's digest is the source's, or one of sha256 if it has none."""
    pieces = spark.read.option("lineSep", CRLF * 2).text(path)
    rows = pieces.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("s"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        now, reader = None, RecordReader()
        for b in batches:
            out = []
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if f != now:
                    now, reader = f, RecordReader()
                for head, block in reader.feed(v + b"\r\n\r\n"):
                    if _header(head, b"warc-type").lower() != b"response":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = _header(head, b"warc-payload-digest") or b"sha256:" + hashlib.sha256(payload).hexdigest().encode()
                    got = (_header(head, b"warc-record-id"), _header(head, b"warc-target-uri"), _header(head, b"warc-date"), http, payload, digest, head)
                    out.append([x.decode("utf-8", "replace") for x in got])
            if out:
                yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=[x.split()[0] for x in _RESPONSE.split(", ")])

    return rows.repartition("f").sortWithinPartitions("f", "s", "n").select("f", "v").mapInArrow(run, _RESPONSE)


def _sql_entities(x: str) -> str:
    code = "coalesce(TRY_CAST(CASE WHEN lower(substr(e, 3, 1)) = 'x' THEN '0x' || substr(e, 4, length(e) - 4) ELSE substr(e, 3, length(e) - 3) END AS BIGINT), 0)"
    char = f"CASE WHEN {code} BETWEEN 1 AND 1114111 AND {code} NOT BETWEEN 55296 AND 57343 THEN chr(CAST({code} AS INT)) ELSE e END"
    x = f"list_reduce(list_prepend({x}, list_distinct(regexp_extract_all({x}, '{_NUMERIC}'))), lambda t, e: replace(t, e, {char}))"
    for name, char in ENTITIES:
        quoted = {"'": "''''"}.get(char, f"'{char}'")
        x = f"replace({x}, '{name}', {quoted})"
    return x


def _sql_line(x: str) -> str:
    return f"trim(regexp_replace({_sql_entities(x)}, '{_SPACE}', ' ', 'g'), ' ')"


def oracle() -> str:
    """The result of ``derive(responses(pages))`` in DuckDB's SQL."""
    text = f"regexp_replace(payload, '{_DROP}', ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{_SPACE}', ' ', 'g'), '{_BREAK}', chr(10), 'g')"
    text = _sql_entities(f"regexp_replace({text}, '<[^>]*>', '', 'g')")
    text = f"regexp_replace(regexp_replace({text}, '{_SPACES}', ' ', 'g'), '{_LINE}', chr(10), 'g')"
    text = f"trim({text}, ' ' || chr(10))"
    nl = "chr(13) || chr(10)"

    def uuid(x: str) -> str:
        return f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-8' || substr({x}, 14, 3) || '-a' || substr({x}, 18, 3) || '-' || substr({x}, 21, 12) || '>'"

    return f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS target_uri, '{DATE}' AS "date", coalesce(html, '') AS payload FROM pages),
q AS (SELECT *, 'HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || strlen(payload) AS source_headers,
             'sha256:' || sha256(payload) AS source_digest FROM p),
r AS (SELECT *, sha256('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || target_uri || '|' || source_digest) AS h FROM q),
s AS (SELECT *, {uuid('h')} AS refers_to FROM r),
d AS (
  SELECT page_id, refers_to, target_uri, "date", source_headers, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || {_sql_line(f"regexp_extract(payload, '{_TITLE}', 1)")} || {nl} || 'language: ' || {_sql_line(f"regexp_extract(payload, '{_LANG}', 1)")} || {nl}
         || 'charset: ' || regexp_extract(payload, '{_CHARSET}', 1) || {nl} || 'source-headers: ' || replace(source_headers, {nl}, '; ') || {nl}
         || 'source-payload-digest: ' || source_digest || {nl}
         || coalesce(array_to_string(list_transform(regexp_extract_all(payload, '{_LINK}', 1), lambda x: 'outlink: ' || {_sql_line(f"regexp_replace(x, '{_QUOTES}', '', 'g')")} || {nl}), ''), '') AS block FROM s
  UNION ALL
  SELECT page_id, refers_to, target_uri, "date", source_headers, source_digest, 'conversion', 'text/plain; charset=utf-8', {text} FROM s),
e AS (SELECT *, sha256(record_type || '|' || refers_to || '|' || source_digest) AS h FROM d)
SELECT page_id, record_type, {uuid('h')} AS record_id, refers_to, target_uri, "date", content_type, source_headers, source_digest, block,
       CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM e"""
