"""Headers and EXIF tags of files put together byte by byte."""

import struct
import zlib

from prismspark.operators import headers


def block(order, entries, cut=None):
    """A TIFF block of (tag, kind, values) with its directory at 8 and its longer values behind it."""
    e = "<" if order == "II" else ">"
    at, heads, tail = 8 + 2 + 12 * len(entries) + 4, b"", b""
    for tag, kind, values in entries:
        code = {3: "H", 4: "I", 9: "i"}.get(kind)
        data = values if kind in (1, 2, 7) else struct.pack(f"{e}{len(values)}{code}", *values) if code else b"".join(struct.pack(f"{e}2{'I' if kind == 5 else 'i'}", *v) for v in values)
        n = len(values)
        heads += struct.pack(f"{e}HHI", tag, kind, n) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack(f"{e}I", at + len(tail)))
        tail += b"" if len(data) <= 4 else data + b"\0" * (len(data) % 2)
    whole = order.encode() + struct.pack(f"{e}HI", 42, 8) + struct.pack(f"{e}H", len(entries)) + heads + bytes(4) + tail
    return whole[:cut]


ENTRIES = [(256, 4, [640]), (257, 3, [480]), (258, 3, [8, 8, 8]), (271, 2, b"Maker of it\0"), (272, 2, b"M1\0"), (274, 3, [6]), (282, 5, [(72, 1)]), (283, 5, [(1, 0)]), (318, 10, [(-1, 2), (3, 4)]), (700, 7, b"abcdef"), (40000, 9, [-5]), (271, 2, b"again\0")]
TAGS = {"ImageWidth": "640", "ImageLength": "480", "BitsPerSample": "(8, 8, 8)", "Make": "Maker of it", "Model": "M1", "Orientation": "6", "XResolution": "72.0", "YResolution": "nan", "WhitePoint": "(-0.5, 0.75)", "XMLPacket": "616263646566", "40000": "-5"}


def jpeg(exif=b"", channels=3):
    app = b"\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif if exif else b""
    other = b"\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + bytes(9)
    return b"\xff\xd8" + other + app + b"\xff\xdb" + struct.pack(">H", 67) + bytes(65) + b"\xff\xff\xc2" + struct.pack(">HBHHB", 8 + 3 * channels, 8, 33, 77, channels) + bytes(3 * channels) + b"\xff\xda\x00\x08" + bytes(50)


def png(exif=b"", colour=6, depth=8):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 300, 200, depth, colour, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + (chunk(b"eXIf", exif) if exif else b"") + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")


def test_headers_and_tags(spark):
    files = {
        "jpeg_le": jpeg(block("II", ENTRIES)), "jpeg_be": jpeg(block("MM", ENTRIES)), "jpeg": jpeg(channels=1), "png_be": png(block("MM", ENTRIES)), "png": png(colour=0, depth=16), "tiff_le": block("II", ENTRIES), "tiff_be": block("MM", ENTRIES),
        "gif": b"GIF89a" + struct.pack("<HH", 5, 6) + bytes(9), "bmp": b"BM" + bytes(16) + struct.pack("<iiHH", 10, -20, 1, 24), "text": b"hello", "empty": b"", "null": None,
        "cut_values": jpeg(block("II", ENTRIES, 200)), "cut_directory": png(block("MM", ENTRIES, 60)), "bad_order": jpeg(b"XX*\0" + bytes(30)), "far": block("II", [])[:4] + struct.pack("<I", 10_000), "many": block("II", [])[:8] + b"\xff\xff" + bytes(20), "cut_jpeg": jpeg(block("II", ENTRIES))[:30], "cut_png": png()[:20],
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "name STRING, content BINARY")
    rows = headers.image_headers(df)
    found = {r.name: r for r in rows.collect()}
    head = {k: (r.format, r.mode, r.width, r.height, r.exif) for k, r in found.items()}
    for k in ("jpeg_le", "jpeg_be", "png_be", "tiff_le", "tiff_be"):
        assert found[k].exif == "success" and found[k].tags == TAGS, k
    assert head["jpeg_le"][:4] == ("JPEG", "RGB", 77, 33) and head["jpeg"] == ("JPEG", "L", 77, 33, "none") and head["png_be"][:4] == ("PNG", "RGBA", 300, 200) and head["png"] == ("PNG", "I;16", 300, 200, "none")
    assert head["tiff_be"][:4] == ("TIFF", None, 640, 480) and head["gif"] == ("GIF", "P", 5, 6, "none") and head["bmp"] == ("BMP", "RGB", 10, 20, "none")
    assert head["text"] == head["empty"] == (None, None, None, None, "none") and head["null"] == (None,) * 5
    assert {k: found[k].exif for k in ("cut_values", "cut_directory", "bad_order", "far", "many")} == dict.fromkeys(("cut_values", "cut_directory", "bad_order", "far", "many"), "damaged")
    assert found["cut_values"].tags["Orientation"] == "6" and found["cut_directory"].tags["ImageWidth"] == "640" and found["bad_order"].tags == {}
    assert head["cut_jpeg"][0] == "JPEG" and head["cut_jpeg"][2] is None and head["cut_png"][2] == 300
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
