"""Headers of image files and their EXIF tags, followed by offsets inside the binary column with built-in functions.

Read are PNG, JPEG, GIF, BMP and TIFF headers, and the first tag directory of an EXIF block (JPEG APP1, PNG eXIf, a TIFF file
itself) in either byte order. Results: format, mode, width, height (null where the format is not known or the header is
cut off), tags (name or number to text), exif: `success`, `none` (no block) or `damaged` (a block whose byte order, directory
or values do not lie in the file; the tags that do are given). Null contents give nulls; of a tag that repeats the first
counts. Text is read to its first zero byte; several numbers stand in brackets; bytes and unknown kinds are in hex.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .planes import counted, let

# Names of tags of the first directory.
TAGS = {
    254: "NewSubfileType", 256: "ImageWidth", 257: "ImageLength", 258: "BitsPerSample", 259: "Compression", 262: "PhotometricInterpretation", 269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model",
    273: "StripOffsets", 274: "Orientation", 277: "SamplesPerPixel", 278: "RowsPerStrip", 279: "StripByteCounts", 282: "XResolution", 283: "YResolution", 284: "PlanarConfiguration", 296: "ResolutionUnit", 305: "Software",
    306: "DateTime", 315: "Artist", 316: "HostComputer", 318: "WhitePoint", 319: "PrimaryChromaticities", 513: "JpegIFOffset", 514: "JpegIFByteCount", 529: "YCbCrCoefficients", 531: "YCbCrPositioning", 532: "ReferenceBlackWhite",
    700: "XMLPacket", 18246: "Rating", 33432: "Copyright", 34665: "ExifOffset", 34853: "GPSInfo", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject",
}
#: Bytes of one value of each kind: byte, text, short, long, rational, signed byte, undefined, signed ones, floats.
KIND_BYTES = [0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8]
#: Segments or chunks that a walk through a file may take; a file has a few dozen.
WALK = 1000


def text_at(content: Column, at: Column, n) -> Column:
    """The hex of n bytes from a place (from 0), shorter at the end of the file."""
    return F.hex(F.substring(content, (at + 1).cast("int"), n if isinstance(n, Column) else F.lit(n)))


def number(content: Column, at: Column, n: int, big: Column | bool = True) -> Column:
    """An unsigned number of n bytes; null where the file ends before."""
    def read(h: Column) -> Column:
        turned = F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))])
        ordered = h if big is True else turned if big is False else F.when(big, h).otherwise(turned)
        return F.when(F.length(h) == 2 * n, F.conv(ordered, 16, 10).cast("bigint"))

    return F.when(at >= 0, let(text_at(content, at, n), read))


def walked(content: Column, start: int, step) -> Column:
    """A fold over the parts of a file; the state has pos, done, width, height, channels, exif and its end."""
    none = F.lit(None).cast("bigint")
    state = F.struct(F.lit(start).cast("bigint").alias("pos"), F.lit(False).alias("done"), none.alias("width"), none.alias("height"), none.alias("channels"), none.alias("exif"), none.alias("end"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), state, lambda s, _: F.when(s["done"], s).otherwise(step(s)))


def state(s: Column, **changes) -> Column:
    kinds = {"done": "boolean"}
    return F.struct(*[(changes[n].cast(kinds.get(n, "bigint")) if n in changes else s[n]).alias(n) for n in ("pos", "done", "width", "height", "channels", "exif", "end")])


def jpeg_walk(content: Column) -> Column:
    def step(s: Column) -> Column:
        pos = s["pos"]

        def by_marker(m: Column) -> Column:
            size = F.substring(m, 1, 2).eqNullSafe("FF") & F.substring(m, 3, 2).rlike("^C[0-35-79A-BD-F]$")
            is_exif = (m == "FFE1") & (text_at(content, pos + 4, 6) == "457869660000")
            further = pos + 2 + number(content, pos + 2, 2)
            sized = state(s, pos=further, width=number(content, pos + 7, 2), height=number(content, pos + 5, 2), channels=number(content, pos + 9, 1))
            ends = ~F.substring(m, 1, 2).eqNullSafe("FF") | (F.length(m) < 4) | m.isin("FFDA", "FFD9") | further.isNull()
            alone = m.rlike("^FF(01|D[0-8]|FF)$")
            return F.when(alone & (F.length(m) == 4), state(s, pos=pos + F.when(m == "FFFF", 1).otherwise(2))).when(ends, state(s, done=F.lit(True))).when(size, sized).when(is_exif, state(s, pos=further, exif=F.coalesce(s["exif"], pos + 10), end=F.coalesce(s["end"], further))).otherwise(state(s, pos=further))

        return let(text_at(content, pos, 2), by_marker)

    return walked(content, 2, step)


def png_walk(content: Column) -> Column:
    def step(s: Column) -> Column:
        pos = s["pos"]
        kind, length = text_at(content, pos + 4, 4), number(content, pos, 4)
        ends = length.isNull() | kind.isin("49444154", "49454E44")
        return F.when(ends, state(s, done=F.lit(True))).when(kind == "65584966", state(s, pos=pos + 12 + length, exif=F.coalesce(s["exif"], pos + 8), end=F.coalesce(s["end"], pos + 8 + length))).otherwise(state(s, pos=pos + 12 + length))

    return walked(content, 8, step)


def value_text(content: Column, at: Column, kind: Column, n: Column, big: Column) -> Column:
    """The values of one tag as text."""
    count = lambda: counted(F.least(n, F.octet_length(content).cast("bigint")))
    plain = lambda size, signed: F.transform(count(), lambda k: let(number(content, at + k * size, size, big), lambda v: (F.when(signed & (v >= 1 << (8 * size - 1)), v - (1 << (8 * size))).otherwise(v)).cast("string")))
    signed = kind >= 6

    def ratio(k: Column) -> Column:
        fix = lambda v: F.when(signed & (v >= 1 << 31), v - (1 << 32)).otherwise(v)
        return F.coalesce(F.try_divide(fix(number(content, at + k * 8, 4, big)), fix(number(content, at + k * 8 + 4, 4, big))).cast("string"), F.lit("nan"))

    listed = F.when(kind.isin(3, 8), plain(2, signed)).when(kind.isin(4, 9), plain(4, signed)).when(kind.isin(5, 10), F.transform(count(), ratio))
    several = let(listed, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))).otherwise(F.concat(F.lit("("), F.array_join(v, ", "), F.lit(")"))))
    raw = F.substring(content, (at + 1).cast("int"), n.cast("int"))
    return F.when(kind == 2, F.substring_index(F.decode(raw, "ISO-8859-1"), "\x00", 1)).when(kind.isin(3, 4, 5, 8, 9, 10), several).otherwise(F.lower(F.hex(F.substring(content, (at + 1).cast("int"), (n * F.get(F.array(*map(F.lit, KIND_BYTES)), kind.cast("int"))).cast("int")))))


def exif(content: Column, base: Column, end: Column) -> Column:
    """status, tags of the block from base to end; null for no block."""
    names = F.create_map(*[x for k, v in TAGS.items() for x in (F.lit(k).cast("bigint"), F.lit(v))])
    size = F.least(F.octet_length(content).cast("bigint"), end)
    order = text_at(content, base, 2)
    sizes = F.array(*map(F.lit, KIND_BYTES))

    def directory(big: Column) -> Column:
        def entries(start: Column) -> Column:
            def one(k: Column) -> Column:
                e = start + 2 + k * 12

                def placed(v: Column) -> Column:
                    bytes_ = v["n"] * F.coalesce(F.get(sizes, v["kind"].cast("int")), F.lit(0))
                    at = F.when(bytes_ <= 4, e + 8).otherwise(base + number(content, e + 8, 4, big))
                    whole = F.coalesce(v["kind"].between(1, 12) & (at + bytes_ <= size) & (e + 12 <= size), F.lit(False))
                    return let(at, lambda a: F.struct(F.coalesce(F.try_element_at(names, v["tag"]), v["tag"].cast("string")).alias("name"), F.when(whole, value_text(content, a, v["kind"], v["n"], big)).alias("text")))

                return let(F.struct(number(content, e, 2, big).alias("tag"), number(content, e + 2, 2, big).alias("kind"), number(content, e + 4, 4, big).alias("n")), placed)

            n = number(content, start, 2, big)
            # More entries than the file has room for are damage.
            room = F.floor((size - start - 2) / 12)
            return F.when(n.isNotNull() & (start > 0), let(F.transform(counted(F.least(n, room + 1)), one), lambda found: F.struct((~F.exists(found, lambda t: t["text"].isNull() | t["name"].isNull()) & (n <= room)).alias("whole"), F.filter(found, lambda t: t["text"].isNotNull()).alias("found"))))

        return F.when(number(content, base + 2, 2, big) == 42, let(base + number(content, base + 4, 4, big), entries))

    read = F.when(order.isin("4949", "4D4D"), let(order == "4D4D", directory))

    def given(r: Column) -> Column:
        first = lambda t: F.filter(t, lambda e, i: F.array_position(F.transform(t, lambda o: o["name"]), e["name"]) == i + 1)
        tags = F.map_from_entries(first(F.coalesce(r["found"], F.array().cast("array<struct<name:string,text:string>>"))))
        return F.struct(F.when(r["whole"].eqNullSafe(True), "success").otherwise("damaged").alias("status"), tags.alias("tags"))

    return F.when(base.isNotNull(), let(read, given))


def image_headers(files: DataFrame, *, content: str = "content") -> DataFrame:
    """files with format, mode, width, height, exif and tags in place of the contents."""
    data = F.col(content)
    head = text_at(data, F.lit(0), 8)
    png, jpeg, gif, bmp = F.startswith(head, F.lit("89504E470D0A1A0A")), F.startswith(head, F.lit("FFD8")), head.rlike("^474946383[79]61"), F.startswith(head, F.lit("424D"))
    tiff = head.rlike("^(49492A00|4D4D002A)")
    form = F.when(png, "PNG").when(jpeg, "JPEG").when(gif, "GIF").when(bmp, "BMP").when(tiff, "TIFF")
    out = files.withColumn("format", form).withColumn("walk", F.when(jpeg, jpeg_walk(data)).when(png, png_walk(data)))
    out = out.withColumn("block", exif(data, F.when(tiff, F.lit(0).cast("bigint")).otherwise(F.col("walk.exif")), F.when(tiff, F.octet_length(data).cast("bigint")).otherwise(F.col("walk.end"))))
    tag = lambda name: F.expr("try_cast(element_at(block.tags, '" + name + "') AS BIGINT)")
    signed = lambda v: F.when(v >= 1 << 31, (1 << 32) - v).otherwise(v)
    depth, colour = number(data, F.lit(24), 1), number(data, F.lit(25), 1)
    modes = F.when(png, F.when((colour == 0) & (depth == 1), "1").when((colour == 0) & (depth == 16), "I;16").when(colour == 0, "L").when(colour == 2, "RGB").when(colour == 3, "P").when(colour == 4, "LA").when(colour == 6, "RGBA"))
    modes = modes.when(jpeg, F.when(F.col("walk.channels") == 1, "L").when(F.col("walk.channels") == 3, "RGB").when(F.col("walk.channels") == 4, "CMYK")).when(gif, "P")
    bits = number(data, F.lit(28), 2, False)
    modes = modes.when(bmp, F.when(bits == 1, "1").when(bits == 8, "P").when(bits.isin(16, 24, 32), "RGB"))
    width = F.when(png, number(data, F.lit(16), 4)).when(jpeg, F.col("walk.width")).when(gif, number(data, F.lit(6), 2, False)).when(bmp, number(data, F.lit(18), 4, False)).when(tiff, tag("ImageWidth"))
    height = F.when(png, number(data, F.lit(20), 4)).when(jpeg, F.col("walk.height")).when(gif, number(data, F.lit(8), 2, False)).when(bmp, signed(number(data, F.lit(22), 4, False))).when(tiff, tag("ImageLength"))
    rows = out.withColumns({"mode": modes, "width": width, "height": height, "exif": F.when(data.isNotNull(), F.coalesce("block.status", F.lit("none"))), "tags": F.col("block.tags")})
    return rows.drop(content, "walk", "block")
