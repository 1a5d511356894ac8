"""Numeric and sparse matrices of MATLAB files, version 5 (the format is published by its makers)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: the types of data elements that hold numbers, and three others.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
SPARSE_CLASS, NUMERIC_CLASSES = 5, range(6, 16)

Sparse = tuple[np.ndarray, np.ndarray]


def elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """Type and bytes of one element after another; short ones hold their bytes in the tag."""
    at = 0
    while at + 8 <= len(data):
        kind, size = np.frombuffer(data, order + "u4", 2, at).tolist()
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + min(kind >> 16, 4)]
            at += 8
            continue
        if at + 8 + size > len(data):
            raise ValueError("the file ends within an element")
        yield kind, data[at + 8 : at + 8 + size]
        at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _numbers(element: tuple[int, memoryview], order: str) -> np.ndarray:
    kind, data = element
    return np.frombuffer(data, order + NUMBERS[kind])


def matrices(data: bytes) -> Iterator[tuple[str, np.ndarray | Sparse]]:
    """Name and value of each matrix: dense ones flat, in order of columns; of sparse ones the rows and columns of all stored places. Other variables go."""
    if len(data) < 128 or data[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MATLAB file of version 5")
    order = "<" if data[126:128] == b"IM" else ">"
    for kind, body in elements(memoryview(data)[128:], order):
        if kind == COMPRESSED:
            kind, body = next(elements(memoryview(zlib.decompress(body)), order))
        if kind != MATRIX:
            continue
        flags, shape, name, *parts = elements(body, order)
        label, what = bytes(name[1]).decode("latin-1"), int(_numbers(flags, order)[0]) & 0xFF
        if what == SPARSE_CLASS:
            rows, ends = (_numbers(p, order).astype(np.int64) for p in parts[:2])
            ends = ends[: int(_numbers(shape, order)[1]) + 1]
            yield label, (rows[: ends[-1]], np.repeat(np.arange(len(ends) - 1), np.diff(ends)))
        elif what in NUMERIC_CLASSES and parts:
            yield label, _numbers(parts[0], order)


def relations(spark: SparkSession, path: str, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """``nodes(node, label)`` of the dense matrix ``label``, and ``edges(rel, src, dst)`` of all sparse ones, of one file.

    A file is read by one task, as the format can only be read from its beginning; what comes out is dealt in pieces.
    """
    raw = spark.read.format("binaryFile").load(path).select("content")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for name, value in matrices(content.as_py()):
                    if isinstance(value, tuple):
                        for at in range(0, len(value[0]), 1 << 16):
                            src, dst = (v[at : at + (1 << 16)] for v in value)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(src), pa.string()), pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["rel", "src", "dst"])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = next((v for n, v in matrices(content.as_py()) if n == label and not isinstance(v, tuple)), None)
                if found is None:
                    raise ValueError(f"no matrix {label!r}")
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found))), pa.array(found.astype(np.int32))], names=["node", "label"])

    return raw.mapInArrow(nodes, "node long, label int"), raw.mapInArrow(edges, "rel string, src long, dst long")
