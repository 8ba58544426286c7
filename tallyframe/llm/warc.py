"""WARC derivatives: linked metadata and plain-text conversion records of responses.

A response becomes two records that refer to it (WARC-Refers-To) and to each other
(WARC-Concurrent-To): ``metadata`` holds its title, language, outlinks and digests
as warc-fields, ``conversion`` its text. Both keep the response's target, date,
payload digest and HTTP headers. Record ids follow from the response's id and the
kind, so a repeated run makes the same records.

Null pages give empty blocks; a null target is left out of the headers; rows with
equal id and target have equal record ids. A record is never dropped, and an empty
table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterable
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import annotated, field

#: Base of the name-based record ids.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tallyframe:derivatives")
METADATA, CONVERSION = "metadata", "conversion"

_REST = r"(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"
_LAST = r"(?=[\s/>])[^>]*+>"
#: Comments, and elements whose content is no markup; these alone go on to the end of the page where nothing ends them.
_RAW = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style){_LAST}.*?(?:</\1{_LAST}|\Z)", re.S | re.I)
#: Tags of elements that show nothing; svg may close itself.
_UNSEEN = re.compile(rf"<(?:(/)(noscript|template|svg){_LAST}|(noscript|template){_LAST}|(svg){_REST})", re.I)
#: A head ends by its tag or, as that may be left out, before the first tag or text that cannot stand in it.
_HEAD = re.compile(
    rf"<head{_REST}(?:\s++|<title{_REST}[^<]*+(?:<(?!(?:/title|head)[\s/>])[^<]*+)*+</title{_LAST}"
    rf"|<(?:base|basefont|bgsound|link|meta|noframes|noscript|template){_REST}"
    rf"|</(?!(?:head|body|html|br)[\s/>])[A-Za-z][^>]*+>|<[!?][^>]*+>)*+(?:</head{_LAST})?",
    re.I,
)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
_BASE = re.compile(r"<base\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[!/?A-Za-z][^>]*+(?:>|\Z)")
_BLANKS = re.compile(r"[^\S\n]+")
_BREAKS = re.compile(r" ?\n[ \n]*")
#: Elements that end a line of text.
_BLOCKS = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
)


def plain_text(page: str) -> str:
    """The visible text, a line per block element, blanks joined."""
    shown = _HEAD.sub(" ", _seen(_RAW.sub(" ", page)))
    parted = _TAG.sub(lambda m: "\n" if (m[2] or "").lower() in _BLOCKS else "", _BREAKS.sub(" ", shown))
    text = entities.unescape(parted).replace("\r", "\n")
    return _BREAKS.sub("\n", _BLANKS.sub(" ", text)).strip()


def _seen(page: str) -> str:
    """The page without the elements that show nothing; one without an end tag hides only its tag."""
    opened: dict[str, list[int]] = {"noscript": [], "template": [], "svg": []}
    hidden: list[tuple[int, int]] = []
    for m in _UNSEEN.finditer(page):
        name = (m[2] or m[3] or m[4]).lower()
        if not m[1]:
            if not (m[4] and m[0].endswith("/>")):
                opened[name].append(m.start())
        elif opened[name]:
            start = opened[name].pop()
            while hidden and hidden[-1][0] >= start:
                hidden.pop()
            hidden.append((start, m.end()))
    parts, at = [], 0
    for start, end in hidden:
        if start > at:
            parts.append(page[at:start])
        at = max(at, end)
    return " ".join([*parts, page[at:]])


def title_of(page: str) -> str:
    found = _TITLE.search(page)
    return " ".join(entities.unescape(_TAG.sub("", found[1])).split()) if found else ""


def outlinks(page: str, target: str | None) -> list[str]:
    """Absolute targets of the links, in order, each once."""
    base = _BASE.search(page)
    root = _joined(target or "", entities.unescape(next(filter(None, base.groups()), "")) if base else "")
    shown = re.sub(r"<!--.*?(?:-->|\Z)", " ", page, flags=re.S)
    links = (entities.unescape(next(filter(None, m.groups()), "")).strip() for m in _LINK.finditer(shown))
    return list(dict.fromkeys(_joined(root, x) for x in links if x and not x.lower().startswith(("javascript:", "#"))))


def _joined(root: str, link: str) -> str:
    try:
        return urljoin(root, link)
    except ValueError:  # not an address
        return link


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def record_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {source}')}>"


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table (page_id, url, html); ids follow from page id and target."""
    page = F.coalesce(pages["html"], F.lit(""))
    hashed = F.md5(F.concat_ws(" ", F.coalesce(pages["page_id"].cast("string"), F.lit("")), pages["url"]))
    part = lambda at, n: F.substring(hashed, at, n)
    return pages.select(
        pages["page_id"].alias("page_id"),
        F.concat(
            F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">")
        ).alias("record_id"),
        pages["url"].alias("target"),
        F.lit(None).cast("string").alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
            F.octet_length(page).cast("string"),
            F.lit("\r\n"),
        ).alias("http_headers"),
        pages["html"].alias("payload"),
    )


def _fields(pairs: Iterable[tuple[str, str | None]]) -> str:
    """Header lines; line breaks in a value become blanks."""
    return "".join(f"{name}: {' '.join(value.split())}\r\n" for name, value in pairs if value)


RECORDS = (
    field("record_type", "string"),
    field("record_id", "string"),
    field("concurrent_to", "string"),
    field("content_type", "string"),
    field("block", "string"),
    field("content_length", "long"),
    field("block_digest", "string"),
)


def derivatives(sources: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Two records per response, with the kept columns of the response.

    ``sources`` has record_id, target, date, http_headers and payload (a string).
    """
    made = (field("payload_digest", "string"), field("n_links", "long"), field("records", T.StructType(list(RECORDS)), many=True))

    def step(parts):
        for columns in parts:
            digests, counts, records = [], [], []
            for source, target, date, http, payload in zip(*(c.to_pylist() for c in columns)):
                page = payload or ""
                payload_digest = digest(page.encode())
                links = outlinks(page, target)
                lang = _LANG.search(page)
                block = _fields([
                    ("title", title_of(page)),
                    ("language", lang[1] if lang else None),
                    ("source-date", date),
                    ("source-payload-digest", payload_digest),
                    *(("source-http-header", line) for line in (http or "").splitlines()),
                    *(("outlink", link) for link in links),
                ])
                text = plain_text(page)
                ids = {kind: record_id(source or "", kind) for kind in (METADATA, CONVERSION)}
                digests.append(payload_digest)
                counts.append(len(links))
                records.append([
                    _record(METADATA, ids[METADATA], ids[CONVERSION], "application/warc-fields", block),
                    _record(CONVERSION, ids[CONVERSION], ids[METADATA], "text/plain; charset=utf-8", text),
                ])
            yield digests, counts, records

    inputs = ["record_id", "target", "date", "http_headers", "payload"]
    kept = [*dict.fromkeys([*keep, "record_id", "target", "date", "http_headers"])]
    out = annotated(sources, inputs, step, made, kept).withColumn("r", F.explode("records"))
    own = [F.col("row")[c].alias(c) for c in keep if c not in ("record_id", "target", "date", "http_headers")]
    return out.select(
        *own,
        *[F.col(f"r.{f.name}").alias(f.name) for f in RECORDS],
        F.col("row.record_id").alias("refers_to"),
        F.col("row.target").alias("target"),
        F.col("row.date").alias("date"),
        F.col("row.http_headers").alias("http_headers"),
        "payload_digest",
        "n_links",
    )


def _record(kind: str, own: str, other: str, content_type: str, block: str) -> dict:
    raw = block.encode("utf-8", "replace")
    return {
        "record_type": kind,
        "record_id": own,
        "concurrent_to": other,
        "content_type": content_type,
        "block": raw.decode(),
        "content_length": len(raw),
        "block_digest": digest(raw),
    }


def serialised(records: DataFrame) -> Column:
    """A record as WARC text: version, headers, an empty line, the block and two empty lines."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", records["record_type"]),
        line("WARC-Record-ID", records["record_id"]),
        line("WARC-Date", records["date"]),
        line("WARC-Target-URI", records["target"]),
        line("WARC-Refers-To", records["refers_to"]),
        line("WARC-Concurrent-To", records["concurrent_to"]),
        line("WARC-Block-Digest", records["block_digest"]),
        line("Content-Type", records["content_type"]),
        line("Content-Length", records["content_length"].cast("string")),
        F.lit("\r\n"),
        records["block"],
        F.lit("\r\n\r\n"),
    )
