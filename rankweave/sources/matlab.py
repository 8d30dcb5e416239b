"""MATLAB level-5 files as a Spark data source.

The driver reads tags only: which variables a file holds, where their numbers lie and of which type they are. A split is a range of rows by a range of columns of one
variable, of a bounded number of elements; its task reads just these numbers, or, as a compressed variable has no places to jump to, inflates it as a stream and keeps
just these. Files are opened by URI (a local or mounted path, or any file system that Arrow knows), so they must be readable from every executor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rankweave.functions.columns import binarized

#: Elements of a split, and bytes that are inflated at a time.
ELEMENTS = 1 << 20
CHUNK = 1 << 20
SCHEMA = "row long, col int, values array<double>"

# Fixed values of the format: codes of number types, of elements, and classes of arrays.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
SPARSE = 5
NUMERIC = range(6, 16)
COMPLEX = 0x08


class Plain:
    """Bytes of a file from a place on."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start = file, start

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(self.start + offset)
        return self.file.read(n)


class Inflated:
    """Bytes of a compressed element, read forward in bounded chunks; reading further back begins anew."""

    def __init__(self, file, start: int) -> None:
        self.file, self.start = file, start
        self._anew()

    def _anew(self) -> None:
        self.read, self.place, self.held, self.stream = self.start, 0, b"", zlib.decompressobj()

    def at(self, offset: int, n: int) -> bytes:
        if offset < self.place:
            self._anew()
        out = bytearray()
        while len(out) < n:
            skip = offset + len(out) - self.place
            got = self.held[skip : skip + n - len(out)]
            out += got
            if len(out) == n or not self._more():
                break
        return bytes(out)

    def _more(self) -> bool:
        self.place += len(self.held)
        more = self.stream.unconsumed_tail
        if not more and not self.stream.eof:
            self.file.seek(self.read)
            more = self.file.read(CHUNK)
            self.read += len(more)
        self.held = self.stream.decompress(more, CHUNK) if more else b""
        return bool(more)


@dataclass(frozen=True)
class Element:
    """Where the numbers of an element are: their type, the first byte and how many bytes."""

    kind: int
    start: int
    size: int
    end: int


@dataclass(frozen=True)
class Variable:
    """A matrix of a file: the place and kind of what holds it, its shape, and its parts (values; of a sparse one rows, column starts and values)."""

    name: str
    start: int
    compressed: bool
    order: str
    shape: tuple[int, ...]
    sparse: bool
    numeric: bool
    parts: tuple[Element, ...]

    def bytes_of(self, file) -> Plain | Inflated:
        return (Inflated if self.compressed else Plain)(file, self.start)


def opened(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _element(of: Plain | Inflated, offset: int, order: str) -> Element:
    tag = of.at(offset, 8)
    if len(tag) < 8:
        raise ValueError("the file ends within an element")
    kind, size = struct.unpack(order + "II", tag)
    if kind >> 16:
        return Element(kind & 0xFFFF, offset + 4, kind >> 16, offset + 8)
    return Element(kind, offset + 8, size, offset + 8 + size + -size % 8)


def _variable(of: Plain | Inflated, offset: int, start: int, compressed: bool, order: str) -> Variable:
    flags = _element(of, offset, order)
    (word,) = struct.unpack(order + "I", of.at(flags.start, 4))
    dims = _element(of, flags.end, order)
    shape = struct.unpack(order + f"{dims.size // 4}i", of.at(dims.start, dims.size))
    name = _element(of, dims.end, order)
    text = of.at(name.start, name.size).decode("ascii", "replace")
    sparse, numeric = word & 0xFF == SPARSE, (word & 0xFF in NUMERIC or word & 0xFF == SPARSE) and not word >> 8 & COMPLEX
    parts, at = [], name.end
    while numeric and len(parts) < (3 if sparse else 1):
        parts.append(_element(of, at, order))
        at = parts[-1].end
    return Variable(text, start, compressed, order, shape, sparse, numeric, tuple(parts))


def variables(path: str) -> dict[str, Variable]:
    """The variables of a file, by name."""
    found = {}
    with opened(path) as file:
        head, size = file.read(128), file.size()
        if len(head) < 128 or head[126:] not in (b"IM", b"MI"):
            raise ValueError(f"{path} is not a MATLAB level-5 file")
        order = "<" if head[126:] == b"IM" else ">"
        if struct.unpack(order + "H", head[124:126])[0] != 0x0100:
            raise ValueError(f"{path} is of another version than level 5")
        at = 128
        while at + 8 <= size:
            kind, n = struct.unpack(order + "II", Plain(file, at).at(0, 8))
            if kind == COMPRESSED:
                of, inner = Inflated(file, at + 8), 8
                if struct.unpack(order + "I", of.at(0, 4))[0] == MATRIX:
                    v = _variable(of, inner, at + 8, True, order)
                    found[v.name] = v
            elif kind == MATRIX and n:
                v = _variable(Plain(file, at + 8), 0, at + 8, False, order)
                found[v.name] = v
            at += 8 + n
    return found


def numbers(of: Plain | Inflated, v: Variable, part: int, first: int, n: int) -> np.ndarray:
    """Numbers ``first`` to ``first + n`` of a part of a variable."""
    kind = np.dtype(v.order + NUMBERS[v.parts[part].kind])
    raw = of.at(v.parts[part].start + first * kind.itemsize, n * kind.itemsize)
    if len(raw) < n * kind.itemsize:
        raise ValueError(f"the file ends within variable {v.name}")
    return np.frombuffer(raw, kind)


@dataclass
class Range(InputPartition):
    """Rows r0 to r1 of columns c0 to c1."""

    v: Variable
    r0: int
    r1: int
    c0: int
    c1: int


def values_of(of: Plain | Inflated, at: Range) -> np.ndarray:
    """The elements of a range, rows by columns."""
    v, rows = at.v, at.v.shape[0]
    out = np.zeros((at.r1 - at.r0, at.c1 - at.c0))
    if not v.sparse:
        for c in range(at.c0, at.c1):
            out[:, c - at.c0] = numbers(of, v, 0, c * rows + at.r0, at.r1 - at.r0)
        return out
    starts = numbers(of, v, 1, at.c0, at.c1 - at.c0 + 1).astype(np.int64)
    cuts = [(int(a), min(int(b) - int(a), ELEMENTS), int(b)) for a, b in zip(starts, starts[1:], strict=False)]
    spans = []
    for c, (a, step, b) in enumerate(cuts):
        for i in range(a, b, max(1, step)):
            found = numbers(of, v, 0, i, min(step, b - i)).astype(np.int64)
            low, high = np.searchsorted(found, [at.r0, at.r1])
            spans.append((c, found[low:high] - at.r0, i + int(low)))
    for c, found, i in spans:
        if len(found):
            out[found, c] = numbers(of, v, 2, i, len(found))
    return out


class MatlabReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.name, self.elements = options["path"], options.get("variable"), int(options.get("elements", ELEMENTS))
        if not self.name:
            raise ValueError("the option variable names the variable to read")

    def partitions(self) -> list[Range]:
        held = variables(self.path)
        v = held.get(self.name)
        if v is None:
            raise ValueError(f"no variable {self.name} in {self.path}; there are {sorted(held)}")
        if not v.numeric or len(v.shape) != 2:
            raise ValueError(f"{self.name} is not a real matrix of numbers")
        n, d = v.shape
        rows = max(1, min(n, max(self.elements // max(1, d), isqrt(self.elements))))
        cols = max(1, min(d, self.elements // rows))
        return [Range(v, r, min(n, r + rows), c, min(d, c + cols)) for r in range(0, n, rows) for c in range(0, d, cols)]

    def read(self, at: Range) -> Iterator[pa.RecordBatch]:
        if at is None:  # an empty matrix has no ranges
            return
        with opened(self.path) as file:
            x = values_of(at.v.bytes_of(file), at)
        ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
        values = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at.r0, at.r1, dtype=np.int64)), pa.array(np.full(len(x), at.c0, np.int32)), values], ["row", "col", "values"])


class MatlabSource(DataSource):
    """``spark.read.format("matlab5").option("variable", "X").load(path)``: (row, col, values), the values of a row from column ``col`` on; rows and
    columns count from 0. ``elements`` bounds a split."""

    @classmethod
    def name(cls) -> str:
        return "matlab5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatlabReader:
        return MatlabReader(self.options)


def matlab_rows(spark: SparkSession, path: str, variable: str, elements: int = ELEMENTS) -> DataFrame:
    """(id, values): the rows of a matrix, numbered from 0."""
    spark.dataSource.register(MatlabSource)
    ranges = spark.read.format("matlab5").option("variable", variable).option("elements", elements).load(path)
    held = ranges.groupBy(F.col("row").alias("id")).agg(F.sort_array(F.collect_list(F.struct("col", "values"))).alias("held"))
    return held.select("id", F.flatten("held.values").alias("values"))


def matlab_samples(spark: SparkSession, path: str, features: str = "X_train", labels: str = "Y_train", elements: int = ELEMENTS) -> DataFrame:
    """Samples from two matrices of a file with a row for each sample; labels may be in {0, 1} or {-1, 1}. Matrices of different lengths raise."""
    held = variables(path)
    if features in held and labels in held and held[features].shape[0] != held[labels].shape[0]:
        raise ValueError(f"{features} and {labels} have {held[features].shape[0]} and {held[labels].shape[0]} rows")
    x = matlab_rows(spark, path, features, elements).withColumnRenamed("values", "features")
    y = matlab_rows(spark, path, labels, elements).select("id", binarized(F.col("values")).alias("labels"))
    return x.join(y, "id")
