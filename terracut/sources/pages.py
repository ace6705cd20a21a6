"""Page and swatch images as a Spark source and sink: PNG and netpbm files to gray rows (sheet_id, y, gray), and back.

A folder holds one image a sheet, named by the sheet. Files are opened through pyarrow's file systems, so a folder may be local,
HDFS or an object store. Images are read row by row: a task holds some rows at a time, whatever the page's size. A PGM
page is cut into bands of rows, one partition each; a PNG page is one partition, as its rows can only be unpacked in order.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

GRAY_ROWS = "sheet_id string, y int, gray binary"
ARROW = pa.schema([("sheet_id", pa.string()), ("y", pa.int32()), ("gray", pa.binary())])
# The PNG signature, channels of a PNG colour type (gray, RGB, gray and alpha, RGB and alpha), and the weights of red, green and blue in 16,384ths.
SIGNATURE, CHANNELS, LUMA = b"\x89PNG\r\n\x1a\n", {0: 1, 2: 3, 4: 2, 6: 4}, (4899, 9617, 1868)
#: Rows of a PGM page that are one partition, rows of one Arrow batch, bytes read of a PNG at a time.
BAND, BATCH, PIECE = 512, 64, 1 << 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def to_gray(row: np.ndarray) -> bytes:
    """Gray bytes of a row of pixels (width, channels); alpha is ignored, as a page is opaque."""
    if row.shape[1] < 3:
        return row[:, 0].tobytes()
    return ((row[:, :3].astype(np.int64) @ np.array(LUMA) + 8192) >> 14).astype(np.uint8).tobytes()


def unfiltered(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """A PNG row (width, channels) without its filter. Sums are modulo 256; filters of the row above alone or of the left alone are whole-row sums."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line, axis=0, dtype=np.uint8)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError(f"no PNG filter {kind}")
    out, up = [[0] * line.shape[1]], above.tolist()
    corner = [0] * line.shape[1]
    for pixel, high in zip(line.tolist(), up, strict=True):
        left = out[-1]
        if kind == 3:
            out.append([(v + (a + b) // 2) & 255 for v, a, b in zip(pixel, left, high, strict=True)])
        else:
            # Of left, above and corner the one nearest to left + above - corner, in this order where they tie.
            out.append([(v + min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]) & 255 for v, a, b, c in zip(pixel, left, high, corner, strict=True)])
        corner = high
    return np.array(out[1:], np.uint8).reshape(line.shape)


def png_rows(file: pa.NativeFile) -> Iterator[bytes]:
    """Gray rows of an 8-bit PNG without interlacing; others are an error. Its checksums are verified."""
    if file.read(8) != SIGNATURE:
        raise ValueError("no PNG file")
    size, unpacker, waiting = None, zlib.decompressobj(), bytearray()
    done = False
    while not done:
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("the PNG file ends early")
        length, name = struct.unpack(">I4s", head)
        check, left, body = zlib.crc32(name), length, b""
        while left:
            piece = file.read(min(left, PIECE))
            if not piece:
                raise ValueError("the PNG file ends early")
            check, left = zlib.crc32(piece, check), left - len(piece)
            if name == b"IHDR":
                body += piece
            elif name == b"IDAT":
                if size is None:
                    raise ValueError("the PNG file has no header")
                full = True
                while full:
                    # A small piece may unpack to many rows; at most PIECE bytes come at once, and a full answer may have more behind it.
                    got = unpacker.decompress(piece, PIECE)
                    waiting += got
                    piece, full = unpacker.unconsumed_tail, len(got) == PIECE
                    while len(waiting) > stride and y < height:
                        line = np.frombuffer(bytes(waiting[1 : stride + 1]), np.uint8).reshape(width, channels)
                        above = unfiltered(waiting[0], line, above)
                        del waiting[: stride + 1]
                        y += 1
                        yield to_gray(above)
        if struct.unpack(">I", file.read(4).rjust(4, b"\0"))[0] != check:
            raise ValueError(f"the PNG file's {name!r} part is damaged")
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlaced = size = struct.unpack(">IIBBBBB", body)
            if depth != 8 or colour not in CHANNELS or interlaced:
                raise ValueError(f"PNG of depth {depth}, colour type {colour}, interlacing {interlaced}: 8 bits, no palette and no interlacing are read")
            channels, y = CHANNELS[colour], 0
            stride, above = width * channels, np.zeros((width, channels), np.uint8)
        done = name == b"IEND"
    if size is None or y < height:
        raise ValueError("the PNG file has too few rows")


def netpbm_size(file: pa.NativeFile) -> tuple[int, int, int, int]:
    """width, height, channels and the first pixel's place of a binary PGM or PPM file of 8 bits."""
    head, words = b"", []
    while len(words) < 4:
        byte = file.read(1)
        if not byte:
            raise ValueError("the netpbm file ends early")
        if byte == b"#":
            while file.read(1) not in (b"\n", b""):
                pass
        elif byte.isspace():
            words += [head] if head else []
            head = b""
        else:
            head += byte
    if words[0] not in (b"P5", b"P6") or int(words[3]) != 255:
        raise ValueError(f"netpbm {words[0]!r} up to {words[3]!r}: P5 and P6 up to 255 are read")
    return int(words[1]), int(words[2]), 1 if words[0] == b"P5" else 3, file.tell()


@dataclass
class Band(InputPartition):
    """Rows first up to, not including, last of one file; a PNG's only band has no last."""

    path: str
    sheet: str
    first: int = 0
    last: int | None = None


class PageReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.sheets = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on sheet_id choose files; Spark applies all others."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet_id",):
                chosen = {f.value}
            elif isinstance(f, In) and f.attribute == ("sheet_id",):
                chosen = set(f.value)
            else:
                yield f
                continue
            self.sheets = chosen if self.sheets is None else self.sheets & chosen

    def partitions(self) -> list[Band]:
        files, folder = opened(self.path)
        bands = []
        for found in files.get_file_info(fs.FileSelector(folder)):
            stem, _, kind = found.base_name.rpartition(".")
            sheet = unquote(stem)
            if kind not in ("png", "pgm", "ppm") or found.base_name.startswith((".", "_")) or (self.sheets is not None and sheet not in self.sheets):
                continue
            if kind == "png":
                bands.append(Band(found.path, sheet))
                continue
            with files.open_input_file(found.path) as file:
                height = netpbm_size(file)[1]
            bands += [Band(found.path, sheet, y, min(y + BAND, height)) for y in range(0, height, BAND)]
        # Spark wants one partition at least, of an empty folder too.
        return sorted(bands, key=lambda b: (b.sheet, b.first)) or [Band("", "")]

    def read(self, band: Band) -> Iterator[pa.RecordBatch]:
        if not band.path:
            return
        files, _ = opened(self.path)
        with files.open_input_file(band.path) as file:
            rows: list[bytes] = []
            y = band.first
            for row in png_rows(file) if band.last is None else self.netpbm_rows(file, band):
                rows.append(row)
                if len(rows) == BATCH:
                    yield self.batch(band.sheet, y, rows)
                    y, rows = y + len(rows), []
            if rows:
                yield self.batch(band.sheet, y, rows)

    @staticmethod
    def netpbm_rows(file: pa.NativeFile, band: Band) -> Iterator[bytes]:
        width, _, channels, start = netpbm_size(file)
        file.seek(start + band.first * width * channels)
        for _ in range(band.first, band.last):
            row = file.read(width * channels)
            if len(row) < width * channels:
                raise ValueError(f"{band.path} ends early")
            yield to_gray(np.frombuffer(row, np.uint8).reshape(width, channels))

    @staticmethod
    def batch(sheet: str, y: int, rows: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sheet] * len(rows)), pa.array(range(y, y + len(rows)), pa.int32()), pa.array(rows, pa.binary())], schema=ARROW)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task under their temporary names, with their final ones."""

    files: list[tuple[str, str]]


class PageWriter(DataSourceWriter):
    """Files get their names when all tasks are done, so repeated and failed attempts leave no half page behind."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def write(self, rows: Iterator) -> Written:
        files, folder = opened(self.path)
        files.create_dir(folder, recursive=True)
        done = []
        for sheet, page in groupby(rows, key=lambda r: r["sheet_id"]):
            final = f"{folder}/{quote(sheet, safe='')}.{self.kind}"
            hidden = f"{folder}/_{uuid.uuid4().hex}"
            with files.open_output_stream(hidden) as out:
                self.page(out, page)
            done.append((hidden, final))
        return Written(done)

    def page(self, out: pa.NativeFile, rows: Iterator) -> None:
        first = next(rows)
        width, height = first["width"], first["height"]
        if self.kind == "pgm":
            out.write(f"P5\n{width} {height}\n255\n".encode())
        else:
            out.write(SIGNATURE + self.part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)))
        packer, at = zlib.compressobj(), 0

        def put(gray: bytes) -> None:
            packed = gray if self.kind == "pgm" else packer.compress(b"\0" + gray)
            if packed:
                out.write(packed if self.kind == "pgm" else self.part(b"IDAT", packed))

        while first is not None:
            if first["y"] < at:
                raise ValueError(f"sheet {first['sheet_id']}: row {first['y']} stands twice or before the page")
            for _ in range(at, first["y"]):
                put(b"\xff" * width)
            put(bytes(first["gray"] or b"").ljust(width, b"\xff"))
            at, first = first["y"] + 1, next(rows, None)
        if self.kind == "png":
            out.write(self.part(b"IDAT", packer.flush()) + self.part(b"IEND", b""))

    @staticmethod
    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        for m in messages:
            for hidden, final in m.files if m else []:
                files.move(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        for m in messages:
            for hidden, _ in m.files if m else []:
                files.delete_file(hidden)


class Pages(DataSource):
    """Format "pages": options path, and for writing kind (png or pgm)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return GRAY_ROWS

    def reader(self, schema) -> PageReader:
        return PageReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"], self.options.get("kind", "png"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Gray rows of all PNG, PGM and PPM images in a folder. Filters on sheet_id are pushed down: only those files are opened.

    Turns on the session's filter pushdown for Python sources, which this source needs. Other files, and those whose names begin
    with a dot or an underscore, are passed over; damaged images are an error. An empty folder gives no rows.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pages)
    return spark.read.format("pages").option("path", path).load()


def write_pages(rows: DataFrame, path: str, kind: str = "png") -> None:
    """One image for each sheet_id of gray rows (more columns are ignored), added to a folder; a sheet's older image of that kind is replaced.

    Missing rows and short ends of rows are white, null gray is a white row; rows without sheet or y are left out. Rows that stand twice are
    an error. A sheet's rows are sorted and written by one task, one row at a time.
    """
    if kind not in ("png", "pgm"):
        raise ValueError(f"kind {kind}: png or pgm")
    rows.sparkSession.dataSource.register(Pages)
    t = rows.select(F.col("sheet_id").cast("string").alias("sheet_id"), F.col("y").cast("int").alias("y"), "gray").where("sheet_id IS NOT NULL AND y IS NOT NULL")
    size = t.groupBy("sheet_id").agg((F.max("y") + 1).alias("height"), F.greatest(F.max(F.octet_length("gray")), F.lit(1)).cast("int").alias("width"))
    t.join(size, "sheet_id").repartition("sheet_id").sortWithinPartitions("sheet_id", "y").write.format("pages").option("path", path).option("kind", kind).mode("append").save()
