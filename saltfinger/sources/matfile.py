"""MATLAB level-5 files of one cast as level-1 tables.

``read_variables`` loads files with Spark's binaryFile reader and emits the numeric
variables that are asked for, in pieces of a bounded number of values; ``level1``
lays them out as the fast, slow and files tables of a level-1 folder. Variables in
level-7.3 files, which are HDF5, are not read: such a file is a row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of element types and array classes of the file format.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED = 14, 15
_NUMERIC_CLASSES = range(6, 16)
_COMPLEX = 0x0800
#: The variables of a cast file by the samples they hold.
FAST, SLOW, RATES = ("sh1", "sh2", "gradT1", "gradT2"), ("U_EM", "P_slow"), ("fs_fast", "fs_slow")
TIMES = {"t_fast": FAST, "t_slow": SLOW}
#: Values of a row that goes from Python to Spark.
PIECE = 1 << 16


def _elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, bytes) of the elements in data, small ones too; ValueError if one is cut short."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element: its size and bytes are in the tag
            kind, size, start = kind & 0xFFFF, kind >> 16, at + 4
            after = at + 8
        else:
            start = at + 8
            after = start + size + (-size % 8 if kind != _COMPRESSED else 0)
        if start + size > len(data):
            raise ValueError("file ends inside a variable")
        yield kind, data[start : start + size]
        at = after


def variables(content: bytes, names: Sequence[str] | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """(name, values in column order) of the real numeric variables of a file."""
    if content[:8] == b"\x89HDF\r\n\x1a\n" or content[512:520] == b"\x89HDF\r\n\x1a\n":
        raise ValueError("level-7.3 files are HDF5, which is not read")
    mark = content[126:128]
    if len(content) < 128 or mark not in (b"IM", b"MI"):
        raise ValueError("not a level-5 file")
    order = "<" if mark == b"IM" else ">"
    for kind, body in _elements(memoryview(content)[128:], order):
        if kind == _COMPRESSED:
            (kind, body), *_ = _elements(memoryview(zlib.decompress(body)), order)
        if kind != _MATRIX or not len(body):
            continue
        parts = _elements(body, order)
        flags = struct.unpack_from(f"{order}I", next(parts)[1])[0]
        shape = np.frombuffer(next(parts)[1], f"{order}i4")
        name = bytes(next(parts)[1]).decode("latin-1")
        if flags & 0xFF not in _NUMERIC_CLASSES or flags & _COMPLEX or (names is not None and name not in names):
            continue
        kind, raw = next(parts, (9, memoryview(b"")))
        values = np.frombuffer(raw, f"{order}{_NUMBERS[kind]}").astype(np.float64)
        if len(values) != int(np.prod(shape)):
            raise ValueError(f"variable {name} has {len(values)} values for {'x'.join(map(str, shape))}")
        yield name, values


def read_variables(spark: SparkSession, path: str | Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """(path, name, first, values, error): the variables in pieces of at most ``PIECE``
    values, of which first is the number of the first. A file that cannot be read is
    a row with an error alone."""
    columns = ["path", "name", "first", "values", "error"]

    def batch(p, name, first, values, error):
        row = ([p], pa.string()), ([name], pa.string()), ([first], pa.int64()), ([values], pa.list_(pa.float64())), ([error], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(*x) for x in row], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in batches:
            for p, content in zip(own.column(0).to_pylist(), own.column(1), strict=True):
                try:
                    for name, x in variables(content.as_py(), names):
                        for a in range(0, max(len(x), 1), PIECE):
                            yield batch(p, name, a, x[a : a + PIECE], None)
                except (ValueError, KeyError, StopIteration, struct.error, zlib.error) as e:
                    yield batch(p, None, None, None, f"{type(e).__name__}: {e}")

    return spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content").mapInArrow(run, "path string, name string, first long, values array<double>, error string")


def level1(spark: SparkSession, path: str | Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fast, slow, files) of cast files, as a level-1 folder has them: samples by
    (file_id, i) with t, and a row for each file with its rates and error. Pressure
    is P. A file without one of its variables has nulls there."""
    rows = read_variables(spark, path, [*FAST, *SLOW, *RATES, *TIMES])
    rows = rows.withColumn("file_id", F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1))
    # what a file holds before the place where it breaks is left out
    sound = rows.join(rows.where("error IS NOT NULL").select("file_id").distinct(), "file_id", "left_anti")
    samples = sound.select("file_id", "name", "first", F.posexplode("values").alias("n", "value")).select("file_id", "name", (F.col("first") + F.col("n")).alias("i"), "value")

    def table(time: str) -> DataFrame:
        own = samples.where(F.col("name").isin(time, *TIMES[time])).groupBy("file_id", "i").pivot("name", [time, *TIMES[time]]).agg(F.first("value"))
        return own.withColumnRenamed(time, "t").withColumnRenamed("P_slow", "P")

    first = F.get("values", F.lit(0))
    files = rows.groupBy("file_id").agg(F.first("path").alias("source_file"), *(F.max(F.when(F.col("name") == r, first)).alias(r) for r in RATES), F.max("error").alias("error"))
    return table("t_fast"), table("t_slow"), files
