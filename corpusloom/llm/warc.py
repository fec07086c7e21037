"""WARC derivatives: metadata and plain-text conversion records of response records, as Spark expressions.

A response record is a row: record_id, target_uri, date, http_headers and payload. Each yields two records that refer to it:
`metadata` (application/warc-fields: title, language, counts and the source's headers) and `conversion` (text/plain). Both keep
the response's identifier in WARC-Refers-To, its target and date, and the digest of its payload, and carry the digest of
their own block. Identifiers are derived from the response's, so reruns give the same records.

Defined cases: a null payload is empty and converts to an empty text; a null target or date leaves its header out, and a null is told from an empty
value in identifiers; line breaks in a target are percent-encoded in headers; a `<` that begins no tag is text, and a script, style, title or comment that isn't closed
ends with the page; pages without a title have an empty one; repeated responses give repeated records; very long payloads are read whole; an empty table gives no
rows; columns but those named are ignored.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.llm.common import sha256

DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: Expressions that Java's engine and RE2 read alike.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<title\b.*?(?:</title\s*>|\z)|<!--.*?(?:-->|\z)"
BLOCK = r"(?i)</?(p|div|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|td|th|section|article|main|header|footer|nav|aside|form|blockquote|pre|figure|figcaption|br|hr)\b[^>]*>"
TAG = r"</?[A-Za-z][^>]*(?:>|\z)|<[!?][^>]*(?:>|\z)"
BLANK = "[ \\t\\r\\f\\x0B ]+"
BREAK = r"[ \n]*\n[ \n]*"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LANG = r"(?is)<html\b[^>]*\blang=\"([^\"]*)\""
LINK = r"(?i)<a\b[^>]*\bhref="
#: The references that the SQL knows.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


@F.pandas_udf(StringType())
def _decoded(text: pd.Series) -> pd.Series:
    """Character references by the whole HTML5 table, once; a no-break space from a reference becomes a blank."""

    def one(m: re.Match) -> str:
        out = html.unescape(m[0])
        return out.replace("\xa0", " ")

    return pd.Series([REFERENCE.sub(one, t) if t and "&" in t else t for t in text], dtype=object)


def plain_text(page: Column) -> Column:
    """Visible text, one line per block, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(page, HIDDEN, ""), "[\\n]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, BLOCK, "\n"), TAG, "")
    return F.btrim(F.regexp_replace(F.regexp_replace(_decoded(text), BLANK, " "), BREAK, "\n"), F.lit(" \n"))


def urn(*parts: Column) -> Column:
    """A record identifier from the digest of its parts."""
    h = F.md5(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), p), F.lit("-")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _labelled(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), sha256(text))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of fetched pages (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    length = F.octet_length(payload).cast("string")
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), length, F.lit(CRLF * 2))
    return pages.select(urn(F.lit("response"), F.col("page_id").cast("string"), F.col("url")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"))


def derivatives(records: DataFrame) -> DataFrame:
    """Two records per response: record_id, warc_type, refers_to, target_uri, date, content_type, content_length,
    block_digest, source_payload_digest, headers (the WARC header lines) and block."""
    payload = F.coalesce("payload", F.lit(""))
    src = records.withColumn("payload", payload).withColumn("digest", _labelled(payload))
    title = F.btrim(F.regexp_replace(_decoded(F.regexp_extract("payload", TITLE, 1)), "[ \\t\\r\\n\\f\\x0B]+", " "), F.lit(" "))
    flat = lambda value: F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = F.concat(
        line("title", title),
        line("language", F.regexp_extract("payload", LANG, 1)),
        line("outlinks", F.regexp_count("payload", F.lit(LINK)).cast("string")),
        line("source-payload-length", F.octet_length("payload").cast("string")),
        line("source-payload-digest", F.col("digest")),
        line("source-http-headers", F.replace(F.replace(F.coalesce("http_headers", F.lit("")), F.lit(CRLF * 2), F.lit("")), F.lit(CRLF), F.lit(" | "))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    out = src.withColumn("made", F.explode(kinds)).select("record_id", "target_uri", "date", "digest", "made.*")
    out = out.withColumn("own", urn(F.col("warc_type"), F.col("record_id"))).withColumn("size", F.octet_length("block").cast("long")).withColumn("block_digest", _labelled(F.col("block")))
    maybe = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    headers = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("own")), line("WARC-Refers-To", F.col("record_id")),
        maybe("WARC-Target-URI", flat(F.col("target_uri"))), maybe("WARC-Date", F.col("date")), maybe("WARC-Refers-To-Target-URI", flat(F.col("target_uri"))), maybe("WARC-Refers-To-Date", F.col("date")),
        line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("size").cast("string")),
    )
    return out.select(F.col("own").alias("record_id"), "warc_type", F.col("record_id").alias("refers_to"), "target_uri", "date", "content_type", F.col("size").alias("content_length"), "block_digest", F.col("digest").alias("source_payload_digest"), headers.alias("headers"), "block")


def serialised(made: DataFrame) -> Column:
    """A derivative as the text of a WARC record."""
    return F.concat(made["headers"], F.lit(CRLF), made["block"], F.lit(CRLF * 2))


def _sql_text(s: str) -> str:
    """A string as a DuckDB literal; line ends as chr() so that the SQL stays on one reading."""
    parts = []
    for piece in s.replace("\r", "\0\r").replace("\n", "\0\n").split("\0"):
        if piece[:1] in ("\r", "\n"):
            parts.append(f"chr({ord(piece[0])})")
            piece = piece[1:]
        if piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(parts or ["''"]) + ")"


def oracle_sql() -> str:
    """DuckDB SQL over pages for the rows of derivatives(responses(pages))."""
    q = _sql_text
    urn_sql = lambda x: f"'<urn:uuid:' || substr({x},1,8) || '-' || substr({x},9,4) || '-' || substr({x},13,4) || '-' || substr({x},17,4) || '-' || substr({x},21,12) || '>'"

    def decoded(x: str) -> str:
        for name, char in ENTITIES:
            x = f"replace({x}, {q(name)}, {q(char)})"
        return x

    sub = lambda x, pattern, to: f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"
    text = sub(sub(sub(sub("payload", HIDDEN, ""), "[\\n]+", " "), BLOCK, "\n"), TAG, "")
    text = f"trim({sub(sub(decoded(text), BLANK, ' '), BREAK, chr(10))}, {q(' ' + chr(10))})"
    title = f"trim({sub(decoded(f'regexp_extract(payload, {q(TITLE)}, 1)'), '[ \\t\\r\\n\\f\\x0B]+', ' ')}, ' ')"
    line = lambda name, value: f"'{name}: ' || {value} || {q(CRLF)}"
    fields = " || ".join([
        line("title", title), line("language", f"regexp_extract(payload, {q(LANG)}, 1)"), line("outlinks", f"CAST(len(regexp_extract_all(payload, {q(LINK)})) AS VARCHAR)"),
        line("source-payload-length", "CAST(strlen(payload) AS VARCHAR)"), line("source-payload-digest", "digest"),
        line("source-http-headers", f"replace(replace(http_headers, {q(CRLF * 2)}, ''), {q(CRLF)}, ' | ')"),
    ])
    target = f"replace(replace(target_uri, {q(chr(13))}, '%0D'), {q(chr(10))}, '%0A')"
    head = q(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: ")
    headers = " || ".join([
        q(f"WARC/1.1{CRLF}"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "own"), line("WARC-Refers-To", "record_id"),
        f"coalesce({line('WARC-Target-URI', target)}, '')", f"coalesce({line('WARC-Date', 'date')}, '')", f"coalesce({line('WARC-Refers-To-Target-URI', target)}, '')", f"coalesce({line('WARC-Refers-To-Date', 'date')}, '')",
        line("WARC-Block-Digest", "block_digest"), line("WARC-Source-Payload-Digest", "digest"), line("Content-Type", "content_type"), line("Content-Length", "CAST(content_length AS VARCHAR)"),
    ])
    return f"""
WITH p AS (SELECT md5('=response|' || coalesce('=' || page_id, '-') || '|' || coalesce('=' || url, '-')) AS h, url AS target_uri, '{DATE}' AS date, coalesce(html, '') AS payload FROM pages),
r AS (SELECT {urn_sql('h')} AS record_id, target_uri, date, payload, {head} || CAST(strlen(payload) AS VARCHAR) || {q(CRLF * 2)} AS http_headers, 'sha256:' || sha256(payload) AS digest FROM p),
m AS (SELECT record_id, target_uri, date, digest, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, {fields} AS block FROM r
UNION ALL SELECT record_id, target_uri, date, digest, 'conversion', 'text/plain; charset=utf-8', {text} FROM r),
d AS (SELECT *, md5('=' || warc_type || '|=' || record_id) AS h, CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest FROM m),
o AS (SELECT *, {urn_sql('h')} AS own FROM d)
SELECT own AS record_id, warc_type, record_id AS refers_to, target_uri, date, content_type, content_length, block_digest, digest AS source_payload_digest, {headers} AS headers, block FROM o
"""
