"""Frames of uncompressed video as rows: a data source for Y4M files and for folders or files of binary PGM images.

`spark.read.format("raw_frames").load(path)` lists the files under a path and deals their frames out in ranges: a range of
a Y4M file is found by its offset, so that one long file is read by many tasks. Frames come as grey levels, averaged over
areas to a small size as the video operators want them. Compressed video needs a decoder, which is not here.

Options: `path` (a file or folder), `size` (width x height of the frames given, 64x64; `none` keeps theirs), `frames` (in a
partition, 256). Paths are opened by pyarrow: local or mounted folders, and the stores that it knows.

Columns: video (path of the file; of PGM images the folder), idx, pts (seconds; null without a frame rate), kind (`I`, as
every frame stands alone), height, width (of the source), frame (levels, row by row), status, error. A file that cannot be
read, or not any more from some frame on, gives one row with status `unreadable` and its error after the frames before it;
a file without frames gives one with status `empty`. Depths over 8 bits are brought to 0 .. 255.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismspark.session import ship

SCHEMA = "video STRING, idx BIGINT, pts DOUBLE, kind STRING, height INT, width INT, frame ARRAY<DOUBLE>, status STRING, error STRING"
HEADER_BYTES = 4096
#: Samples of all planes for a width and height, by the colour space of a Y4M header.
CHROMA = {
    "mono": lambda w, h: w * h,
    "444": lambda w, h: 3 * w * h,
    "422": lambda w, h: w * h + 2 * ((w + 1) // 2) * h,
    "420": lambda w, h: w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2),
    "411": lambda w, h: w * h + 2 * ((w + 3) // 4) * h,
}
PGM = re.compile(rb"P5(?:\s+|\s*#[^\n]*\n\s*)+(\d+)(?:\s+|\s*#[^\n]*\n\s*)+(\d+)(?:\s+|\s*#[^\n]*\n\s*)+(\d+)\s")


@dataclass
class Frames(InputPartition):
    """Some frames of one video: first .. last - 1 of a Y4M file, or some PGM files from number first on."""

    video: str
    files: tuple[str, ...]
    first: int
    last: int
    error: str = ""


@dataclass
class Layout:
    """What the header of a Y4M file says."""

    width: int
    height: int
    rate: float | None
    sample_bytes: int
    depth: int
    start: int
    frame_bytes: int


def opened(path: str):
    if "://" in path:
        store, path = fs.FileSystem.from_uri(path)
    else:
        store = fs.LocalFileSystem()
        path = path.removeprefix("file:")
    return store, path


def layout(head: bytes) -> Layout:
    """Raises ValueError for a header that is none."""
    line, found, _ = head.partition(b"\n")
    parts = line.decode("ascii", "replace").split(" ")
    if not found or parts[0] != "YUV4MPEG2":
        raise ValueError("no Y4M header")
    given = {p[0]: p[1:] for p in parts[1:] if p}
    width, height = int(given.get("W", 0)), int(given.get("H", 0))
    space = given.get("C", "420")
    kind = re.match(r"(mono|4\d\d)", space)
    if width <= 0 or height <= 0 or not kind or kind[1] not in CHROMA or "alpha" in space:
        raise ValueError(f"unknown size or colour space: {line[:80]!r}")
    deep = re.search(r"(?:p|mono)(\d{2})$", space)
    depth = int(deep[1]) if deep else 8
    top, _, bottom = given.get("F", "").partition(":")
    rate = int(top) / int(bottom) if top.isdigit() and bottom.isdigit() and int(bottom) and int(top) else None
    sample = 2 if depth > 8 else 1
    return Layout(width, height, rate, sample, depth, len(line) + 1, CHROMA[kind[1]](width, height) * sample)


def averaged(image: np.ndarray, size: tuple[int, int] | None) -> list[float]:
    """Means over the areas of a grid of size (width, height), parts of pixels counted by their share."""
    image = image.astype(np.float64)
    if size is not None:
        for axis, n in ((0, size[1]), (1, size[0])):
            edges = np.linspace(0, image.shape[axis], n + 1)
            sums = np.concatenate((np.zeros_like(image.take([0], axis)), image.cumsum(axis)), axis)
            low = np.minimum(edges.astype(int), image.shape[axis] - 1)
            at = sums.take(low, axis) + image.take(low, axis) * np.expand_dims(edges - low, 1 - axis)
            image = np.diff(at, axis=axis) / (image.shape[axis] / n)
    return image.ravel().tolist()


class RawFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FrameReader(self.options)


class FrameReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        size = options.get("size", "64x64").lower()
        self.size = None if size == "none" else tuple(int(v) for v in size.split("x"))
        self.step = max(1, int(options.get("frames", "256")))

    def partitions(self) -> list[Frames]:
        store, root = opened(self.path)
        info = store.get_file_info(root)
        listed = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        found, folders = [], {}
        for file in sorted((f for f in listed if f.type == fs.FileType.File), key=lambda f: f.path):
            if file.path.endswith(".y4m"):
                try:
                    with store.open_input_file(file.path) as f:
                        shape = layout(f.read(HEADER_BYTES))
                    # Frames with parameters are longer: the count is then too large, and the last ranges find no frame.
                    n = -(-max(0, file.size - shape.start) // (shape.frame_bytes + 6))
                    found += [Frames(file.path, (), k, min(n, k + self.step)) for k in range(0, max(1, n), self.step)]
                except (ValueError, OSError) as failure:
                    found.append(Frames(file.path, (), 0, 0, repr(failure)))
            elif file.path.endswith(".pgm"):
                folders.setdefault(file.path.rpartition("/")[0], []).append(file.path)
        for folder, files in folders.items():
            found += [Frames(folder, tuple(files[k : k + self.step]), k, k + len(files[k : k + self.step])) for k in range(0, len(files), self.step)]
        return found

    def row(self, video: str, idx: int, rate: float | None, image: np.ndarray) -> tuple:
        return video, idx, idx / rate if rate else None, "I", image.shape[0], image.shape[1], averaged(image, self.size), "success", None

    def read(self, part: Frames) -> Iterator[tuple]:
        failed = lambda idx, status, error: (part.video, idx, None, None, None, None, None, status, error)
        if part.error:
            yield failed(0, "unreadable", part.error)
            return
        store, _ = opened(self.path)
        idx = part.first
        try:
            if part.files:
                for idx, path in enumerate(part.files, part.first):
                    try:
                        with store.open_input_file(path) as f:
                            yield self.row(part.video, idx, None, pgm(f.read()))
                    except (ValueError, OSError) as failure:
                        yield failed(idx, "unreadable", repr(failure))
                return
            with store.open_input_file(part.video) as f:
                shape = layout(f.read(HEADER_BYTES))
                at, size = self.seek(f, shape, part.first), f.size()
                if part.first == 0 and at >= size:
                    yield failed(0, "empty", "no frames")
                while idx < part.last and at < size:
                    f.seek(at)
                    mark = f.read(min(256, size - at))
                    line, end, _ = mark.partition(b"\n")
                    if not line.startswith(b"FRAME") or not end or at + len(line) + 1 + shape.frame_bytes > size:
                        yield failed(idx, "unreadable", f"broken or cut off at byte {at}")
                        return
                    f.seek(at + len(line) + 1)
                    luma = f.read(shape.width * shape.height * shape.sample_bytes)
                    image = np.frombuffer(luma, "<u2" if shape.sample_bytes == 2 else np.uint8).reshape(shape.height, shape.width)
                    yield self.row(part.video, idx, shape.rate, image / float(1 << (shape.depth - 8)) if shape.depth > 8 else image)
                    at, idx = at + len(line) + 1 + shape.frame_bytes, idx + 1
        except (ValueError, OSError) as failure:
            yield failed(idx, "unreadable", repr(failure))

    @staticmethod
    def seek(f, shape: Layout, first: int) -> int:
        """Where frame number first begins: by its offset, or if frames have parameters by reading the lines before it."""
        at = shape.start + first * (shape.frame_bytes + 6)
        f.seek(shape.start)
        if first == 0 or f.read(6) == b"FRAME\n":
            if first == 0 or at >= f.size():
                return at
            f.seek(at)
            if f.read(6) == b"FRAME\n":
                return at
        at = shape.start
        for _ in range(first):
            f.seek(at)
            line, end, _ = f.read(256).partition(b"\n")
            if not line.startswith(b"FRAME") or not end:
                return f.size()
            at += len(line) + 1 + shape.frame_bytes
        return at


def pgm(data: bytes) -> np.ndarray:
    """The grey image of a binary PGM file, brought to 0 .. 255."""
    head = PGM.match(data)
    if not head:
        raise ValueError("no binary PGM header")
    width, height, most = (int(v) for v in head.groups())
    if not 0 < most < 65536:
        raise ValueError(f"largest level {most}")
    kind = np.dtype(">u2" if most > 255 else "u1")
    if width * height == 0 or len(data) - head.end() < width * height * kind.itemsize:
        raise ValueError("cut off")
    image = np.frombuffer(data, kind, width * height, head.end()).reshape(height, width)
    return image if most == 255 else image * (255.0 / most)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(RawFrames)


def frames(spark: SparkSession, path: str, **options) -> DataFrame:
    """The rows of the source, registered first."""
    register(spark)
    return spark.read.format("raw_frames").options(**options).load(path)
