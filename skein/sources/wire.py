"""Occurrence indexes in the protocol-buffer wire format: documents, ranges and symbols from bytes.

An index is cut into its documents first, so that the documents of one large index are dealt over the tasks; a document is
then decoded into its occurrences. Packed ranges are decoded by arrays. What can't be decoded gives a row with ``error`` and stops
nothing else; unknown fields are passed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import ship

#: The numbers of the fields in the public schema of such indexes.
METADATA, DOCUMENTS, ENCODING = 1, 2, 4
PATH, OCCURRENCES = 1, 2
RANGE, SYMBOL, ROLES = 1, 2, 3
DEFINITION, UTF16 = 1, 2


def varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError(f"a number is cut off at byte {at}")
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value & ((1 << 64) - 1), at


def fields(data: bytes):
    """(number, value) of a message: numbers as integers, everything of a length as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        number, kind = key >> 3, key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 5, 2):
            size = 8 if kind == 1 else 4
            if kind == 2:
                size, at = varint(data, at)
            if at + size > len(data):
                raise ValueError(f"field {number} is cut off at byte {at}")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"field {number} has the unknown kind {kind}")
        if number == 0:
            raise ValueError(f"field 0 at byte {at}")
        yield number, value


def packed(data: bytes) -> np.ndarray:
    """The signed 32-bit numbers of a packed field, by arrays."""
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    if not len(raw):
        return np.zeros(0, np.int32)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise ValueError("a packed field is cut off")
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    if place.max() > 9:
        raise ValueError("a packed number is too long")
    low = (raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(low, starts).astype(np.uint32).view(np.int32)


def range_of(numbers) -> tuple[int, int, int, int] | None:
    """(line, column, last line, last column) of three or four numbers, none of them negative."""
    if len(numbers) not in (3, 4) or min(numbers) < 0:
        return None
    line, column, *rest = (int(x) for x in numbers)
    return (line, column, line, rest[0]) if len(rest) == 1 else (line, column, *rest)


def index_documents(indexes: DataFrame) -> DataFrame:
    """(index_id, number, utf16, document, error) of indexes (index_id, data)."""
    schema = pa.schema([("index_id", pa.int64()), ("number", pa.int64()), ("utf16", pa.bool_()), ("document", pa.binary()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for index_id, data in zip(batch.column("index_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                utf16, found, error = False, [], None
                try:
                    for number, value in fields(data or b""):
                        if number == METADATA and isinstance(value, bytes):
                            utf16 = next((v == UTF16 for n, v in fields(value) if n == ENCODING), False)
                        elif number == DOCUMENTS and isinstance(value, bytes):
                            found.append(value)
                except ValueError as wrong:
                    error = str(wrong)
                rows += [(index_id, k, utf16, x, None) for k, x in enumerate(found)]
                rows += [(index_id, len(found), utf16, None, error)] if error else []
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * 5, schema, strict=True)], schema=schema)

    ship(indexes.sparkSession)
    return indexes.select(F.col("index_id").cast("long").alias("index_id"), "data").mapInArrow(run, "index_id long, number long, utf16 boolean, document binary, error string")


def occurrences(documents: DataFrame) -> DataFrame:
    """(index_id, path, utf16, symbol, is_definition, line, column, last_line, last_column, error) of documents as above."""
    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), *[pa.int64()] * 4, pa.string()]
    names = ["index_id", "path", "utf16", "symbol", "is_definition", "line", "column", "last_line", "last_column", "error"]

    def of_document(data: bytes):
        path, found = None, []
        for number, value in fields(data):
            if number == PATH:
                path = value.decode()
            elif number == OCCURRENCES:
                numbers, symbol, roles = [], None, 0
                for n, v in fields(value):
                    if n == RANGE:
                        numbers += packed(v).tolist() if isinstance(v, bytes) else [v if v < 1 << 31 else -1]
                    elif n == SYMBOL:
                        symbol = v.decode()
                    elif n == ROLES:
                        roles = v
                place = range_of(numbers)
                found.append((symbol, bool(roles & DEFINITION), *(place or (None,) * 4), None if place else f"a range of {numbers[:5]}"))
        return path, found

    def run(batches):
        for batch in batches:
            rows = []
            for index_id, utf16, data, error in zip(*(batch.column(c).to_pylist() for c in ("index_id", "utf16", "document", "error")), strict=True):
                try:
                    path, found = of_document(data) if data is not None else (None, [(None, None, None, None, None, None, error)])
                except (ValueError, AttributeError, TypeError) as wrong:
                    path, found = None, [(None, None, None, None, None, None, str(wrong))]
                rows += [(index_id, path, utf16, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)

    ship(documents.sparkSession)
    schema = "index_id long, path string, utf16 boolean, symbol string, is_definition boolean, line long, column long, last_line long, last_column long, error string"
    return documents.select("index_id", "utf16", "document", "error").mapInArrow(run, schema)


def byte_ranges(found: DataFrame, files: DataFrame, column_to_byte) -> DataFrame:
    """Adds start and end in bytes from the texts (path, text); null where a line or column isn't there.

    Lines are found by equality: a file becomes a row for each line, with the byte at which it starts.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("l", "content"))
    before = Window.partitionBy("path").orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("first", F.coalesce(F.sum(F.octet_length("content") + 1).over(before), F.lit(0)))

    def at(rows: DataFrame, line: str, column: str, name: str) -> DataFrame:
        own = lines.select(F.col("path").alias("_p"), F.col("l").cast("long").alias("_l"), "content", "first")
        units = F.octet_length(F.encode("content", "UTF-16BE")) / 2
        there: Column = F.when(F.col("utf16"), F.col(column) <= units).otherwise(F.col(column) <= F.octet_length("content"))
        byte = F.when(F.col("utf16"), column_to_byte(F.col("content"), F.col(column), True)).otherwise(F.col(column))
        rows = rows.join(own, (F.col("path") == F.col("_p")) & (F.col(line) == F.col("_l")), "left")
        return rows.withColumn(name, F.when(there, F.col("first") + byte)).drop("_p", "_l", "content", "first")

    return at(at(found, "line", "column", "start"), "last_line", "last_column", "end")
