"""WARC derivatives: metadata and plain-text conversion records made from responses.

Each derived record names the response that it comes from (WARC-Refers-To, with its target and date), and has its own
id, block and payload digests and length. The metadata record has every header of the source, its WARC headers as well as
its HTTP headers, in their order. Ids are name-based, so that a task run again writes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonlake.llm.common import map_rows
from photonlake.llm.html_text import whole_text

#: Name space of record ids.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:photonlake:warc")
END = "\r\n"


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {name}')}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean(value: str) -> str:
    """A header's value on one line."""
    return " ".join(value.split())


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC/1.1 record; Content-Length is added."""
    head = "".join(f"{k}: {clean(v)}{END}" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return f"WARC/1.1{END}{head}{END}".encode("utf-8", "surrogatepass") + block + (END * 2).encode()


class Headers(dict):
    """Header values by name in lower case (of repeated names the first), and as pairs in their order with their names as written."""

    def __init__(self, lines: list[str]):
        self.pairs: list[tuple[str, str]] = []
        for line in lines:
            if line[:1] in (" ", "\t") and self.pairs:
                name, value = self.pairs[-1]
                self.pairs[-1] = name, f"{value} {line.strip()}"
                continue
            name, colon, value = line.partition(":")
            if colon:
                self.pairs.append((name.strip(), value.strip()))
        super().__init__((k.lower(), v) for k, v in reversed(self.pairs))


#: Bytes that are unpacked at a time.
PIECE = 1 << 16
_RECORD = re.compile(rb"WARC/[0-9]+\.[0-9]+\r\n")


def members(data: bytes | memoryview) -> Iterator[bytes | None]:
    """A WARC file's bytes, piece by piece; those of a .warc.gz, one member for each record, are unpacked. None stands where a member is broken: what follows it up to the next one is left out."""
    view = memoryview(data)
    if bytes(view[:2]) != b"\x1f\x8b":
        for at in range(0, len(view), PIECE):
            yield bytes(view[at : at + PIECE])
        return
    at = 0
    while at < len(view):
        unpack, begun = zlib.decompressobj(wbits=31), at
        try:
            while at < len(view) and not unpack.eof:
                given = view[at : at + PIECE]
                out = unpack.decompress(given, PIECE * 16)
                at += len(given)
                yield out
                while unpack.unconsumed_tail and not unpack.eof:
                    yield unpack.decompress(unpack.unconsumed_tail, PIECE * 16)
            if not unpack.eof:
                raise zlib.error("cut off")
            at -= len(unpack.unused_data)
        except zlib.error:
            yield None
            at = _next_member(view, begun + 1)
            continue
        while at < len(view) and view[at] == 0:  # padding
            at += 1
        if at < len(view) and bytes(view[at : at + 2]) != b"\x1f\x8b":
            yield None
            at = _next_member(view, at)


def _next_member(view: memoryview, at: int) -> int:
    """Where the next member may begin, or the end."""
    step = PIECE * 16
    while at < len(view):
        found = bytes(view[at : at + step + 2]).find(b"\x1f\x8b\x08")
        if found >= 0:
            return at + found
        at += step
    return len(view)


def scan(data: bytes | memoryview) -> Iterator[tuple[Headers, bytes] | str]:
    """Headers and block of each record of a WARC file's bytes, plain or packed. A broken place gives one line that says what is wrong, and reading goes on with the next record after it. Only
    what isn't read yet of a record is held, never the unpacked file."""
    held, start, passed, lost = bytearray(), 0, 0, False
    pieces = members(data)
    ended = cut = False  # no piece is left; the piece after these is broken

    def more() -> bool:
        """One more piece behind those held; False at the end or before a broken place."""
        nonlocal ended, cut, start, passed
        if ended or cut:
            return False
        if start > PIECE * 16:
            del held[:start]
            passed, start = passed + start, 0
        got = next(pieces, b"")
        if got is None:
            cut = True
            return False
        if not got:
            got = next((x for x in pieces if x is None or x), b"")
            if got is None:
                cut = True
                return False
            ended = not got
        held.extend(got)
        return not ended

    while True:
        while len(held) - start < 2 and more():
            pass
        if start >= len(held):
            if cut:
                yield f"no record at byte {passed + start}: a packed member is broken"
                cut = lost = False
                continue
            return
        if held[start : start + 2] == b"\r\n":
            start += 2
            continue
        if lost:  # look for the next record
            while not (found := _RECORD.search(held, start)):
                start = max(start, len(held) - 16)
                if not more():
                    break
            start, lost = (found.start() if found else len(held)), False
            continue
        seen = start
        while (head := held.find(b"\r\n\r\n", seen)) < 0:
            if len(held) - start >= 5 and not held.startswith(b"WARC/", start):
                break
            before = len(held) - start
            if not more():
                break
            seen = start + max(0, before - 3)
        problem = "no record" if head < 0 or not held.startswith(b"WARC/", start) else ""
        block = b""
        if not problem:
            headers = Headers(held[start:head].decode("utf-8", "replace").split("\r\n")[1:])
            size = headers.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                problem = "no length"
            else:
                after = head + 4 - start
                while len(held) - start < after + int(size) and more():
                    pass
                block = bytes(held[start + after : start + after + int(size)])
                problem = "record is cut off" if len(block) != int(size) else ""
        if problem:
            yield f"{problem} at byte {passed + start}"
            start, lost = start + 1, True
            continue
        yield headers, block
        start += after + len(block)


def parse(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """The records of `scan`. Raises ValueError where one is broken."""
    for found in scan(data):
        if isinstance(found, str):
            raise ValueError(found)
        yield found


def response(url: str | None, html: str | None, name: str, date: str) -> bytes:
    """A response record around a page, as a crawler would have written it."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    http = f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: {len(payload)}{END}{END}".encode() + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", name)), ("WARC-Date", date), ("WARC-Target-URI", url or "urn:unknown"), ("Content-Type", "application/http; msgtype=response")]
    return record([*headers, ("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(http))], http)


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of an HTTP response; a block without headers is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", Headers([]), block
    first, *rest = head.decode("latin-1").split("\r\n")
    return first, Headers(rest), payload


def unchunked(payload: bytes) -> bytes:
    """The body of a chunked payload. Raises ValueError if it isn't one, as where the crawler had taken the chunks apart already."""
    out, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        size = payload[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            raise ValueError(f"no chunk at byte {at}")
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if len(payload) < end + 2 + n:
            raise ValueError("a chunk is cut off")
        out.append(payload[end + 2 : end + 2 + n])
        at = end + 4 + n


class Broken(ValueError):
    """A body that can't be decoded to its end; got is what could."""

    def __init__(self, problem: str, got: bytes):
        super().__init__(problem)
        self.got = got


def _inflated(payload: bytes) -> bytes:
    """All members of a gzip body. Raises Broken if one is cut off, or if something else follows."""
    out, view = [], memoryview(payload)
    while True:
        unpack = zlib.decompressobj(wbits=31)
        try:
            out.append(unpack.decompress(view))
        except zlib.error as e:
            raise Broken(str(e), b"".join(out)) from e
        if not unpack.eof:
            raise Broken("cut off", b"".join(out))
        view = view[len(view) - len(unpack.unused_data) :]
        if not bytes(view).strip(b"\0"):
            return b"".join(out)


def _frames(payload: bytes) -> bytes:
    """All frames of a zstd body. Raises Broken if one is cut off, or if something else follows."""
    import zstandard

    out, left = [], payload
    while left:
        unpack = zstandard.ZstdDecompressor().decompressobj()
        try:
            out.append(unpack.decompress(left))
        except zstandard.ZstdError as e:
            raise Broken(str(e), b"".join(out)) from e
        if not unpack.eof:
            raise Broken("cut off", b"".join(out))
        left = unpack.unused_data
    return b"".join(out)


def _deflated(payload: bytes) -> bytes:
    """A zlib or bare deflate body. Raises Broken if it is cut off or something follows it."""
    unpack = zlib.decompressobj(wbits=15 if payload[:1] == b"\x78" else -15)
    try:
        out = unpack.decompress(payload)
    except zlib.error as e:
        raise Broken(str(e), b"") from e
    if not unpack.eof:
        raise Broken("cut off", out)
    if unpack.unused_data:
        raise Broken(f"{len(unpack.unused_data)} bytes follow", out)
    return out


def unpacked(payload: bytes, encoding: str) -> bytes:
    """A payload without its content encoding: all members of gzip and all frames of zstd, each to its end. Raises ValueError for one that isn't known, and Broken for one that doesn't fit. An empty payload is one in
    any encoding."""
    kinds = {"gzip": _inflated, "x-gzip": _inflated, "deflate": _deflated, "zstd": _frames}
    if encoding in ("", "identity") or not payload:
        return payload
    if encoding not in kinds:
        raise ValueError(f"{encoding} is not known")
    try:
        return kinds[encoding](payload)
    except Broken as e:
        raise Broken(f"{encoding}: {e}", e.got) from e


def body_of(http: Headers, payload: bytes) -> tuple[bytes, str]:
    """The body without transfer and content encodings, and what went wrong: of a body that is cut off or followed by something else, what could be decoded; of one in an encoding that
    isn't known, or nothing of which could, the body as it is."""
    problem = ""
    if "chunked" in http.get("transfer-encoding", "").lower():
        try:
            payload = unchunked(payload)
        except ValueError as e:
            problem = str(e)
    for encoding in reversed(http.get("content-encoding", "").lower().split(",")):
        try:
            payload = unpacked(payload, encoding.strip())
        except ValueError as e:
            problem = f"{problem}; {e}".lstrip("; ")
            if not getattr(e, "got", b""):
                return payload, problem
            payload = e.got
    return payload, problem


_META = re.compile(rb"""<meta[^>]{0,200}charset\s*=\s*["']?([\w-]+)""", re.I)
#: Types of content that have a text.
_TEXTUAL = re.compile(r"^$|text/|html|xml|json|javascript")


def text_of(kind: str, body: bytes) -> str | None:
    """The plain text of a body of some content type; None if it has none."""
    kind = kind.lower()
    if not _TEXTUAL.search(kind.partition(";")[0].strip()):
        return None
    charset = kind.partition("charset=")[2].split(";")[0].strip("\"' ")
    if not charset and (found := _META.search(body[:1024])):
        charset = found[1].decode()
    try:
        page = body.decode(charset or "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    return whole_text(page) if "html" in kind or not kind else page


def derive(headers: Headers, block: bytes) -> dict[str, object] | None:
    """Both records derived from a response, with their linking fields; None for records of another type. A response without a text (an image, say) has no conversion."""
    if headers.get("warc-type") != "response":
        return None
    status, http, payload = split_http(block)
    source, target, date = headers.get("warc-record-id", ""), headers.get("warc-target-uri", ""), headers.get("warc-date", "")
    body, problem = body_of(http, payload)
    text = text_of(http.get("content-type", ""), body)
    text_block = None if text is None else text.encode("utf-8", "surrogatepass")
    payload_digest = headers.get("warc-payload-digest") or digest(payload)
    facts = [("sourceStatus", status), ("sourcePayloadDigest", payload_digest), ("sourceBlockDigest", headers.get("warc-block-digest") or digest(block)), ("sourceLength", str(len(payload)))]
    facts += [("textLength", str(len(text_block)))] if text_block is not None else []
    facts += [("sourceDecodingProblem", problem)] if problem else []
    facts += [("sourceWarcHeader", f"{k}: {v}") for k, v in headers.pairs] + [("sourceHttpHeader", f"{k}: {v}") for k, v in http.pairs]
    facts_block = "".join(f"{k}: {clean(v)}{END}" for k, v in facts).encode("utf-8", "surrogatepass")
    ids = {kind: record_id(kind, source) for kind in ("metadata", "conversion")}
    links = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date)]

    def derived(kind: str, type_: str, data: bytes) -> bytes:
        own = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", date), ("WARC-Target-URI", target), ("Content-Type", type_)]
        return record([*own, *links, ("WARC-Block-Digest", d := digest(data)), ("WARC-Payload-Digest", d)], data)

    there = text_block is not None
    return {
        "refers_to": source, "target_uri": target, "warc_date": date, "source_payload_digest": payload_digest, "source_length": len(payload),
        "metadata_id": ids["metadata"], "metadata_digest": digest(facts_block), "conversion_id": ids["conversion"] if there else None,
        "conversion_digest": digest(text_block) if there else None, "text_length": len(text_block) if there else None,
        "metadata_record": derived("metadata", "application/warc-fields", facts_block), "conversion_record": derived("conversion", "text/plain; charset=utf-8", text_block) if there else None,
    }


FIELDS = "refers_to string, target_uri string, warc_date string, source_payload_digest string, source_length long, metadata_id string, metadata_digest string, conversion_id string, conversion_digest string, text_length long"
RECORDS = FIELDS + ", metadata_record binary, conversion_record binary"


def derive_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Derivatives of every response in a column of WARC bytes, plain or .warc.gz (one or more records each; null and empty have none).

    Other types of record are passed over. Each broken place gives a row whose column problem says what is wrong and whose other columns are null: such records are left
    out of the derivatives, and can be counted. Repeated files give repeated rows. A file is one cell, so it is at most 2 GB.
    """

    def rows(part):
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for data in part["content"]:
            out: dict[str, list] = {n: [] for n in [*names, "problem"]}
            for found in scan(data or b""):
                made = {"problem": found} if isinstance(found, str) else derive(*found)
                if made:
                    for n, column in out.items():
                        column.append(made.get(n))
            yield out

    return map_rows(files.select(F.col(content).alias("content")), rows, RECORDS + ", problem string", slices=100)


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id and content: a response record for every page; a null id, url or html is taken as empty, and repeated rows give equal records."""

    def rows(part):
        yield {"page_id": part["page_id"], "content": [response(u, h, f"{i} {u}", date) for i, u, h in zip(part["page_id"], part["url"], part["html"])]}

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), rows, "page_id long, content binary", slices=200)


def page_derivatives(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """page_id with the linking fields and both records' SHA-256, for every page, repeated rows included. Null and empty html give records of no text; an empty
    table gives no rows; other columns are neither read nor returned."""
    made = FIELDS.split(", ")

    def rows(part):
        out: dict[str, list] = {"page_id": part["page_id"]} | {f.split()[0]: [] for f in made} | {"metadata_sha256": [], "conversion_sha256": []}
        for i, u, h in zip(part["page_id"], part["url"], part["html"]):
            (headers, block), = parse(response(u, h, f"{i} {u}", date))
            row = derive(headers, block)
            for f in made:
                out[f.split()[0]].append(row[f.split()[0]])
            for kind in ("metadata", "conversion"):
                out[f"{kind}_sha256"].append(hashlib.sha256(row[f"{kind}_record"]).hexdigest())
        yield out

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), rows, f"page_id long, {FIELDS}, metadata_sha256 string, conversion_sha256 string", slices=200)
