"""Metadata of image files: EXIF, XMP, IPTC and text chunks, as maps of containers to fields."""

from __future__ import annotations

import re
import struct
import xml.etree.ElementTree as ElementTree
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the fields that are read and written.
EXIF_TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "XResolution", 0x011B: "YResolution", 0x0128: "ResolutionUnit", 0x0131: "Software",
    0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "ISOSpeedRatings", 0x9003: "DateTimeOriginal", 0x920A: "FocalLength",
    0xA001: "ColorSpace", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA434: "LensModel",
}
IPTC_FIELDS = {5: "ObjectName", 25: "Keywords", 55: "DateCreated", 80: "Byline", 90: "City", 101: "Country", 105: "Headline", 110: "Credit", 116: "CopyrightNotice", 120: "Caption"}
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def read_exif(data: bytes) -> dict[str, str]:
    """Fields of a TIFF-structured block."""
    if data[:2] not in (b"II", b"MM"):
        return {}
    order = "<" if data[:2] == b"II" else ">"
    out: dict[str, str] = {}

    def walk(at: int, depth: int) -> None:
        if depth > 3 or at + 2 > len(data):
            return
        (n,) = struct.unpack_from(order + "H", data, at)
        for i in range(n):
            place = at + 2 + 12 * i
            if place + 12 > len(data):
                return
            tag, kind, count = struct.unpack_from(order + "HHI", data, place)
            size = _SIZES.get(kind, 0) * count
            spot = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            if not size or spot + size > len(data):
                continue
            if tag in (0x8769, 0x8825):
                walk(struct.unpack_from(order + "I", data, spot)[0], depth + 1)
            elif tag in EXIF_TAGS:
                if kind == 2:
                    value = data[spot : spot + count].split(b"\0")[0].decode("utf-8", "replace")
                elif kind in (5, 10):
                    pairs = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, spot)
                    value = " ".join(f"{a}/{b}" for a, b in zip(pairs[::2], pairs[1::2], strict=True))
                else:
                    value = " ".join(map(str, struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I', 7: 'B', 9: 'i'}[kind]}", data, spot)))
                out[EXIF_TAGS[tag]] = value

    if len(data) >= 8:
        walk(struct.unpack_from(order + "I", data, 4)[0], 0)
    return out


def write_exif(fields: dict[str, str]) -> bytes:
    """A block of text fields and Orientation."""
    codes = {v: k for k, v in EXIF_TAGS.items()}
    entries, tail = [], b""
    known = sorted((codes[k], v) for k, v in fields.items() if k in codes)
    start = 8 + 2 + 12 * len(known) + 4
    for tag, value in known:
        if tag == 0x0112:
            entries.append(struct.pack("<HHIHH", tag, 3, 1, int(value), 0))
            continue
        raw = value.encode() + b"\0"
        if len(raw) <= 4:
            entries.append(struct.pack("<HHI", tag, 2, len(raw)) + raw.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHII", tag, 2, len(raw), start + len(tail)))
            tail += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<IH", 8, len(known)) + b"".join(entries) + bytes(4) + tail


def read_xmp(text: str) -> dict[str, str]:
    """Properties by their local names; lists are joined by commas."""
    try:
        root = ElementTree.fromstring(text[text.index("<") :].strip())
    except (ElementTree.ParseError, ValueError):
        return {}
    out: dict[str, str] = {}
    local = lambda tag: tag.rpartition("}")[2]
    for node in root.iter():
        if local(node.tag) != "Description":
            continue
        out |= {local(k): v for k, v in node.attrib.items() if local(k) != "about"}
        for child in node:
            items = [x.text or "" for x in child.iter() if local(x.tag) == "li"]
            out[local(child.tag)] = ", ".join(items) if items else (child.text or "").strip()
    return out


def write_xmp(fields: dict[str, str]) -> str:
    rdf = ElementTree.Element("rdf:RDF", {"xmlns:rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xmlns:xmp": "http://ns.adobe.com/xap/1.0/"})
    about = ElementTree.SubElement(rdf, "rdf:Description", {"rdf:about": ""})
    for k, v in fields.items():
        ElementTree.SubElement(about, f"xmp:{k}").text = v
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/">{ElementTree.tostring(rdf, "unicode")}</x:xmpmeta>'


def read_iptc(data: bytes) -> dict[str, str]:
    """Fields of record 2; repeated ones are joined by commas."""
    out: dict[str, str] = {}
    at = 0
    while at + 5 <= len(data):
        if data[at] != 0x1C:
            break
        record, field, size = struct.unpack_from(">BBH", data, at + 1)
        value = data[at + 5 : at + 5 + size].decode("utf-8", "replace")
        if record == 2 and field in IPTC_FIELDS:
            name = IPTC_FIELDS[field]
            out[name] = f"{out[name]}, {value}" if name in out else value
        at += 5 + size
    return out


def write_iptc(fields: dict[str, str]) -> bytes:
    codes = {v: k for k, v in IPTC_FIELDS.items()}
    return b"".join(struct.pack(">BBBH", 0x1C, 2, codes[k], len(v.encode())) + v.encode() for k, v in fields.items() if k in codes)


def read(content: bytes) -> dict[str, dict[str, str]]:
    """All containers of a file."""
    out: dict[str, dict[str, str]] = {}
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
            (size,) = struct.unpack_from(">H", content, at + 2)
            body = content[at + 4 : at + 2 + size]
            if body[:6] == b"Exif\0\0":
                out["exif"] = read_exif(body[6:])
            elif body.startswith(b"http://ns.adobe.com/xap/1.0/\0"):
                out["xmp"] = read_xmp(body.partition(b"\0")[2].decode("utf-8", "replace"))
            elif body.startswith(b"Photoshop 3.0\0") and (k := body.find(b"8BIM\x04\x04")) >= 0:
                skip = k + 6 + (body[k + 6] // 2 + 1) * 2
                (length,) = struct.unpack_from(">I", body, skip)
                out["iptc"] = read_iptc(body[skip + 4 : skip + 4 + length])
            at += 2 + size
    elif content[:4] == b"\x89PNG":
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack_from(">I4s", content, at)
            body = content[at + 8 : at + 8 + size]
            if kind == b"eXIf":
                out["exif"] = read_exif(body)
            elif kind == b"iTXt" and body.startswith(b"XML:com.adobe.xmp\0"):
                packed, text = body[18], body[20:].split(b"\0", 2)[2]
                out["xmp"] = read_xmp((zlib.decompress(text) if packed else text).decode("utf-8", "replace"))
            at += 12 + size
    elif content[:4] in (b"II*\0", b"MM\0*"):
        out["exif"] = read_exif(content)
    return {k: v for k, v in out.items() if v}


PATH = re.compile(r"(\w+)\.(\w+)")


def query(column: Column | str, path: str) -> Column:
    """The value at container.Field of a metadata map, null where there is none."""
    m = PATH.fullmatch(path)
    if not m:
        raise ValueError(f"{path} isn't of the form container.Field")
    return F.try_element_at(F.try_element_at(column, F.lit(m[1].lower())), F.lit(m[2]))


def dump(column: Column | str) -> Column:
    """A metadata map as JSON."""
    return F.to_json(column)


def color_space(column: Column | str) -> Column:
    """Colour space that the metadata tell: EXIF's 1 is sRGB, anything else is unknown."""
    return F.when(query(column, "exif.ColorSpace") == "1", "srgb").otherwise("unknown")
