"""Vector compression: each part of a vector becomes the index of its nearest codebook entry, found by partial-distance search.

Components are integers, so distances are exact. A part's dimensions are taken in descending order of the codebook's
variance: the first ones tell entries apart best. Entries are taken in blocks; after each dimension a mask drops those
whose sum so far strictly exceeds the vector's best complete distance. Equal distances stay, so ties go to the lower index.

Codebooks are refined in rounds: every task adds up its vectors by part and entry, Spark adds the tasks' sums, and the
driver gets one row for each entry in use: 16 x 64 at most, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Entries whose distances are completed together; each block starts with the best distance of those before.
BLOCK = 16
#: Vectors that are searched together: bounds the arrays of distances.
SLICE = 4096
#: Largest magnitude of an integer component; squared distances of parts of up to 256 dimensions then fit 64 bits.
MOST = 1 << 26
#: Rows of one label are dealt over so many keys when its sum is joined back.
SALTS = 64


def usable(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector and components are neither null nor infinite nor NaN."""
    sound = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & sound)


def integers(column: pa.Array, width: int) -> np.ndarray:
    """The vectors as rows of floor(SCALE * x), with zeros behind shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(np.asarray(column.offsets)) if len(column) else np.zeros(0, np.int64)
    flat = np.floor(np.asarray(column.flatten(), np.float64) * SCALE)
    if len(flat) and np.abs(flat).max() > MOST:
        raise ValueError(f"components beyond {MOST // SCALE} in magnitude")
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.astype(np.int64)
    return out


def by_variance(book: np.ndarray) -> np.ndarray:
    """The dimensions of a codebook (entries x dimensions) in descending order of their variance, ties by number."""
    n = len(book)
    # n * n * variance, in whole numbers.
    spread = [n * sum(x * x for x in column) - sum(column) ** 2 for column in book.T.tolist()]
    return np.array(sorted(range(book.shape[1]), key=lambda j: (-spread[j], j)), np.int64)


def nearest(parts: np.ndarray, book: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry for each row of parts, by partial distances."""
    best = np.full(len(parts), np.iinfo(np.int64).max)
    index = np.zeros(len(parts), np.int64)
    for low in range(0, len(book), BLOCK):
        entries = book[low : low + BLOCK]
        row = np.repeat(np.arange(len(parts)), len(entries))
        entry = np.tile(np.arange(len(entries)), len(parts))
        so_far = np.zeros(len(row), np.int64)
        for j in order:
            so_far += (parts[row, j] - entries[entry, j]) ** 2
            stays = so_far <= best[row]
            row, entry, so_far = row[stays], entry[stays], so_far[stays]
        # The least distance of each row, at its lowest entry; earlier blocks win ties.
        first = np.lexsort((entry, so_far, row))
        row, entry, so_far = row[first], entry[first], so_far[first]
        lead = np.ones(len(row), bool)
        lead[1:] = row[1:] != row[:-1]
        row, entry, so_far = row[lead], entry[lead], so_far[lead]
        closer = so_far < best[row]
        best[row[closer]], index[row[closer]] = so_far[closer], entry[closer] + low
    return index, best


def assigned(vectors: np.ndarray, books: np.ndarray, orders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every part (vectors x parts)."""
    index, error = (np.empty((len(vectors), len(books)), np.int64) for _ in range(2))
    cut = vectors.reshape(len(vectors), len(books), books.shape[2])
    for p, (book, order) in enumerate(zip(books, orders, strict=True)):
        for low in range(0, len(vectors), SLICE):
            here = slice(low, low + SLICE)
            index[here, p], error[here, p] = nearest(cut[here, p], book, order)
    return index, error


def first_books(kept: DataFrame, id_col: str, vector_col: str, width: int) -> np.ndarray:
    """The parts of the ENTRIES vectors with the smallest ids (null ids last, ties by components): parts x entries x dimensions."""
    rows = kept.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).orderBy(F.col("i").asc_nulls_last(), "v").limit(ENTRIES).toArrow()
    return integers(rows["v"], width).reshape(rows.num_rows, PARTS, width // PARTS).transpose(1, 0, 2)


def refined(kept: DataFrame, vector_col: str, books: np.ndarray) -> np.ndarray:
    """Each entry becomes the componentwise floor of the mean of the parts that are nearest to it; others stay."""
    orders, width = [by_variance(b) for b in books], books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            vectors = integers(batch.column(0), width)
            index, _ = assigned(vectors, books, orders)
            cut = vectors.reshape(len(vectors), len(books), books.shape[2])
            for p in range(len(books)):
                n[p] += np.bincount(index[:, p], minlength=books.shape[1])
                np.add.at(sums[p], index[:, p], cut[:, p])
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_pylist([{"part": int(p), "entry": int(e), "n": int(n[p, e]), "sums": sums[p, e].tolist()} for p, e in zip(part, entry, strict=True)], pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))

    tasks = kept.select(vector_col).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(books.shape[2])]
    out = books.copy()
    for r in tasks.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect():  # PARTS * ENTRIES rows at most
        out[r["part"], r["entry"]] = [r[f"s{j}"] // r["n"] for j in range(books.shape[2])]
    return out


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> np.ndarray:
    """Codebooks (parts x entries x dimensions) of all usable vectors."""
    kept = usable(vectors, vector_col)
    longest: Row = kept.agg(F.max(F.size(vector_col)).alias("n")).collect()[0]
    width = -(-(longest["n"] or 0) // PARTS) * PARTS
    books = first_books(kept, id_col, vector_col, width)
    for _ in range(ROUNDS if books.size else 0):
        books = refined(kept, vector_col, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray, vector_col: str = "embedding") -> DataFrame:
    """All columns of the usable vectors with code (array of entry numbers) and error (sum of squared distances).

    The columns travel as one struct, so their names cannot clash; an own code or error gives way.
    """
    kept = usable(vectors, vector_col)
    carried = [F.col(f"`{c}`") for c in vectors.columns if c not in ("code", "error")]
    packed = kept.select(F.struct(*carried).alias("row"), F.col(vector_col).alias("v"))
    orders, width = [by_variance(b) for b in books], books.shape[0] * books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = integers(batch.column(1), width)
            index, error = assigned(vectors, books, orders)
            codes = pa.FixedSizeListArray.from_arrays(pa.array(index.ravel().astype(np.int32)), len(books)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), codes, pa.array(error.sum(1))], names=["row", "code", "error"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, code array<int>, error long").select("row.*", "code", "error")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: id, code (two hex digits a part), error, label_error, codebooks_sha256.

    Vectors that are null or hold a null, infinite or NaN component are dropped. Components x become floor(256 x);
    components beyond 2**18 in magnitude are an error, as distances might not fit. Vectors shorter than the longest,
    or than a multiple of 16, count as if zeros followed; an empty one is all zeros. With fewer than 64 vectors,
    codebooks have as many entries. Repeated rows are vectors of their own. Null ids come last where ids are ordered,
    ties in order of components. label_error adds up the errors of equal labels, nulls being equal. Only the three
    columns are read, so others cannot clash. An empty table gives an empty table.
    """
    own = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v"), F.col(label_col).alias("l"))
    books = train(own, "i", "v")
    coded = encode(own, books, "v")
    # Rows of one label may be a third of all: they are dealt by a salt, and the sums, one a label, are repeated for each.
    sums = coded.groupBy(F.col("l").alias("label")).agg(F.sum("error").alias("label_error")).select("label", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("of"))
    salted = coded.withColumn("salt", F.pmod(F.xxhash64("i", "error"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, F.col("l").eqNullSafe(F.col("label")) & (F.col("salt") == F.col("of")))
    text = F.concat_ws("", F.transform("code", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")))
    return joined.select(F.col("i").alias(id_col), text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
