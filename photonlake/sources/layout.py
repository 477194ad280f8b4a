"""Binary layout of image files: the parts of PNG, JPEG, WEBP, BMP and other files as rows; and dates from EXIF."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "path string, part int, name string, offset long, length long, detail string, description string, fields map<string, string>"
# Names of JPEG markers.
MARKERS = {0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xC4: "DHT", 0xDD: "DRI", 0xFE: "COM", 0xC0: "SOF0", 0xC1: "SOF1", 0xC2: "SOF2"}


def hex_dump(data: bytes, offset: int = 0, most: int = 1024) -> str:
    """Sixteen bytes a line with their offset and printable characters; a note where it is cut."""
    lines = []
    for at in range(0, min(len(data), most), 16):
        row = data[at : min(at + 16, most)]
        digits = " ".join(f"{b:02X}" for b in row[:8]) + ("  " if len(row) >= 8 else "") + " ".join(f"{b:02X}" for b in row[8:])
        letters = "".join(chr(b) if 32 <= b <= 126 else "." for b in row)
        lines.append(f"0x{offset + at:04X}:   {(digits.rstrip() + ' ' * (2 if len(row) == 8 else 1)):<50} |{letters}|\n")
    return "".join(lines) + ("... (truncated) ...\n" if len(data) > most else "")


@F.pandas_udf(T.StringType())
def hex_dumps(data: pd.Series) -> pd.Series:
    """Hex dump of each value of a binary column; null for null."""
    return data.map(lambda b: None if b is None else hex_dump(bytes(b)))


#: What the parts are, by the beginning of their names.
DESCRIPTIONS = {
    "PNG Signature": "marks the file as PNG", "IHDR": "size and pixel format", "PLTE": "colours of an indexed image", "IDAT": "compressed pixels", "IEND": "end of the image", "eXIf": "EXIF directory",
    "tEXt": "text", "zTXt": "compressed text", "iTXt": "text in UTF-8", "sRGB": "standard colour space", "gAMA": "gamma", "cHRM": "primary colours and white point", "iCCP": "colour profile", "pHYs": "pixels by unit",
    "tIME": "time of the last change", "tRNS": "transparency", "bKGD": "background colour", "SOI": "start of the image", "EOI": "end of the image", "SOF": "size and pixel format", "DQT": "quantisation tables",
    "DHT": "Huffman tables", "DRI": "restart interval", "SOS": "start of a scan", "APP": "data of an application", "COM": "comment", "Image Data": "compressed pixels", "RIFF": "container", "VP8X": "size and features",
    "VP8L": "pixels without loss", "VP8": "compressed pixels", "ALPH": "transparency", "ANIM": "animation", "ANMF": "a frame", "ICCP": "colour profile", "EXIF": "EXIF directory", "XMP": "XMP text",
    "File Header": "size of the file and place of the pixels", "Info Header": "size and pixel format", "Palette": "colours of an indexed image", "Pixel Data": "pixels", "Trailing Data": "bytes after the end",
}
COLORS = {0: "grey", 2: "RGB", 3: "indexed", 4: "grey and alpha", 6: "RGB and alpha"}


def described(name: str) -> str:
    """What a part is; empty if that isn't known."""
    known = [k for k in DESCRIPTIONS if name.startswith(k)]
    return DESCRIPTIONS[max(known, key=len)] if known else ""


def _named(names: str, values: tuple) -> dict[str, str]:
    return dict(zip(names.split(), map(str, values)))


def fields_of(name: str, part: bytes) -> dict[str, str]:
    """The values that a part of an image file holds, by name; none of parts that are cut off or of other kinds."""
    body = part[8:]
    try:
        if name == "IHDR":
            out = _named("width height bit_depth color_type compression filter interlace", struct.unpack(">IIBBBBB", body[:13]))
            return out | {"color": COLORS.get(body[9], "unknown")}
        if name in ("tEXt", "zTXt", "iTXt"):
            key, _, rest = body[:-4].partition(b"\0")
            text = rest.decode("latin-1")
            if name == "zTXt":
                text = zlib.decompress(rest[1:]).decode("latin-1")
            elif name == "iTXt":
                packed, (_, _, data) = rest[:1] == b"\1", (rest[2:].split(b"\0", 2) + [b"", b""])[:3]
                text = (zlib.decompress(data) if packed else data).decode("utf-8", "replace")
            return {"key": key.decode("latin-1"), "text": text}
        if name == "sRGB":
            return _named("intent", (body[0],))
        if name == "gAMA":
            return _named("gamma", (struct.unpack(">I", body[:4])[0] / 100_000,))
        if name == "pHYs":
            return _named("x y unit", struct.unpack(">IIB", body[:9]))
        if name == "tIME":
            return _named("year month day hour minute second", struct.unpack(">HBBBBB", body[:7]))
        if name.startswith("SOF"):
            return _named("precision height width components", struct.unpack(">BHHB", part[4:10]))
        if name == "DRI":
            return _named("interval", struct.unpack(">H", part[4:6]))
        if name == "COM":
            return {"text": part[4:].decode("utf-8", "replace")}
        if name == "APP0" and part[4:9] == b"JFIF\0":
            return _named("major minor unit x y", struct.unpack(">BBBHH", part[9:16]))
        if name == "VP8X":
            return {"flags": str(body[0]), "width": str(1 + int.from_bytes(body[4:7], "little")), "height": str(1 + int.from_bytes(body[7:10], "little"))}
        if name == "VP8 " and body[3:6] == b"\x9d\x01\x2a":
            return _named("width height", tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10])))
        if name == "VP8L" and body[:1] == b"\x2f":
            bits = int.from_bytes(body[1:5], "little")
            return _named("width height", (1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)))
        if name == "File Header":
            return _named("size pixels_at", (struct.unpack("<I", part[2:6])[0], struct.unpack("<I", part[10:14])[0]))
        if name == "Info Header" and len(part) >= 40:
            return _named("header width height planes bits compression", struct.unpack("<IiiHHI", part[:20]))
    except (struct.error, IndexError, ValueError, zlib.error):
        pass
    return {}


def _png(b: bytes) -> Iterator[tuple]:
    yield "PNG Signature", 0, 8, ""
    at = 8
    while at + 8 <= len(b):
        size, kind = struct.unpack(">I4s", b[at : at + 8])
        end = min(len(b), at + 12 + size)
        detail = ""
        if kind == b"IHDR" and len(b) >= at + 21:
            w, h, depth, color = struct.unpack(">IIBB", b[at + 8 : at + 18])
            detail = f"{w} x {h}, depth {depth}, color {color}"
        elif kind in (b"tEXt", b"zTXt", b"iTXt"):
            detail = b[at + 8 : end].split(b"\0", 1)[0].decode("latin-1")
        yield kind.decode("latin-1"), at, end - at, detail
        if kind == b"IEND":
            at = end
            break
        at = end
    if at < len(b):
        yield "Trailing Data", at, len(b) - at, ""


def _jpeg(b: bytes) -> Iterator[tuple]:
    at = 0
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            end = at
            while True:  # entropy-coded data runs to the next marker that isn't stuffing or a restart
                end = b.find(b"\xff", end)
                if end < 0 or end + 1 >= len(b):
                    end = len(b)
                    break
                if b[end + 1] != 0 and not 0xD0 <= b[end + 1] <= 0xD7:
                    break
                end += 2
            yield "Image Data", at, end - at, ""
            at = end
            continue
        kind = b[at + 1]
        name = MARKERS.get(kind, f"APP{kind - 0xE0}" if 0xE0 <= kind <= 0xEF else f"Marker {kind:02X}")
        if kind in (0xD8, 0xD9) or 0xD0 <= kind <= 0xD7:
            yield name, at, 2, ""
            at += 2
            continue
        if at + 4 > len(b):
            break
        size = min(len(b) - at, 2 + struct.unpack(">H", b[at + 2 : at + 4])[0])
        detail = ""
        if kind in (0xC0, 0xC1, 0xC2) and size >= 9:
            h, w = struct.unpack(">HH", b[at + 5 : at + 9])
            detail = f"{w} x {h}"
        yield name, at, max(2, size), detail
        at += max(2, size)


def _webp(b: bytes) -> Iterator[tuple]:
    yield "RIFF Header", 0, 12, f"{struct.unpack('<I', b[4:8])[0]} bytes"
    at = 12
    while at + 8 <= len(b):
        kind, size = struct.unpack("<4sI", b[at : at + 8])
        end = min(len(b), at + 8 + size + size % 2)
        detail = ""
        if kind == b"VP8X" and len(b) >= at + 18:
            detail = f"{1 + int.from_bytes(b[at + 12 : at + 15], 'little')} x {1 + int.from_bytes(b[at + 15 : at + 18], 'little')}"
        yield kind.decode("latin-1"), at, end - at, detail
        at = end


def _bmp(b: bytes) -> Iterator[tuple]:
    yield "File Header", 0, 14, f"{struct.unpack('<I', b[2:6])[0]} bytes"
    start, size = struct.unpack("<II", b[10:18])
    detail = "{} x {}, {} bits".format(*struct.unpack("<ii", b[18:26]), struct.unpack("<H", b[28:30])[0]) if len(b) >= 30 and size >= 40 else ""
    head = min(len(b), 14 + size)
    yield "Info Header", 14, head - 14, detail
    if head < start <= len(b):
        yield "Palette", head, start - head, ""
    if start < len(b):
        yield "Pixel Data", start, len(b) - start, ""


def parts(data: bytes) -> list[tuple]:
    """(name, offset, length, detail) of a file's parts; a file of another kind is a head of up to 1024 bytes and the rest."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return list(_png(data))
    if data[:2] == b"\xff\xd8":
        return list(_jpeg(data))
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return list(_webp(data))
    if data[:2] == b"BM" and len(data) >= 18:
        return list(_bmp(data))
    head = min(len(data), 1024)
    return [x for x in (("Header", 0, head, ""), ("Data", head, len(data) - head, "")) if x[2]]


def laid_out(files: DataFrame) -> DataFrame:
    """Parts of each file (path, content), with what they are and the values that they hold; null content has none."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files_ = [(p, bytes(c)) for p, c in zip(batch["path"], batch["content"]) if c is not None]
            out = [(p, k, *x, described(x[0]), fields_of(x[0], c[x[1] : x[1] + x[2]])) for p, c in files_ for k, x in enumerate(parts(c))]
            yield pd.DataFrame(out, columns=["path", "part", "name", "offset", "length", "detail", "description", "fields"])

    return files.select("path", "content").mapInPandas(rows, SCHEMA)


def exif_block(data: bytes) -> bytes:
    """The TIFF data that holds a file's EXIF: the file itself, a JPEG's APP1 segment, a PNG's eXIf or a WEBP's EXIF chunk, wherever in the file that is; empty without one."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n" or (data[:4] == b"RIFF" and data[8:12] == b"WEBP"):
        png = data[:1] == b"\x89"
        at = 8 if png else 12
        while at + 8 <= len(data):
            size, kind = (struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]) if png else (struct.unpack("<I", data[at + 4 : at + 8])[0], data[at : at + 4])
            if kind in (b"eXIf", b"EXIF"):
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 12 + size if png else 8 + size + size % 2
        return b""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0" and size > 8:
            return data[at + 10 : at + 2 + size]
        if size < 2:
            break
        at += 2 + size
    # Segments that can't be followed: the mark is looked for in the whole file.
    at = data.find(b"Exif\0\0")
    return data[at + 6 :] if at >= 0 else b""


def exif_dates(data: bytes) -> dict[int, str]:
    """EXIF's DateTime (0x0132), DateTimeOriginal (0x9003) and DateTimeDigitized (0x9004) of a JPEG, TIFF, PNG or WEBP file, as they stand."""
    tiff = exif_block(data)
    if tiff[:2] not in (b"II", b"MM"):
        return {}
    e, out = "<" if tiff[:2] == b"II" else ">", {}

    def directory(pos: int, deep: bool) -> None:
        if pos + 2 > len(tiff):
            return
        for k in range(struct.unpack(e + "H", tiff[pos : pos + 2])[0]):
            entry = tiff[pos + 2 + 12 * k : pos + 14 + 12 * k]
            if len(entry) < 12:
                return
            tag, kind, count, value = struct.unpack(e + "HHII", entry)
            if tag in (0x0132, 0x9003, 0x9004) and kind == 2 and count > 4:
                out[tag] = tiff[value : value + count].rstrip(b"\0").decode("latin-1")
            elif tag == 0x8769 and not deep:
                directory(value, True)

    directory(struct.unpack(e + "I", tiff[4:8])[0] if len(tiff) >= 8 else len(tiff), False)
    return out


def with_exif(files: DataFrame) -> DataFrame:
    """path, original, digitized and changed of each file (path, content)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [exif_dates(bytes(c)) if c is not None else {} for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "original": [x.get(0x9003) for x in found], "digitized": [x.get(0x9004) for x in found], "changed": [x.get(0x0132) for x in found]}, dtype=object)

    return files.select("path", F.col("content")).mapInPandas(rows, "path string, original string, digitized string, changed string")
