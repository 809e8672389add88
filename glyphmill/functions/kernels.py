"""Python functions of one text, run over Arrow batches: one pass over each row, linear in its text, no shuffle.

What built-in functions can't express, or only in time that grows with the square of a text, is written as such a
function.  Rows are told apart by their place in a batch and not by an id, so rows that share an id, or have none, are
separate documents.  Null texts give nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a kernel collects before it hands them on.
FLUSH = 20_000

_PLAIN = {
    T.StringType: pa.string(),
    T.IntegerType: pa.int32(),
    T.LongType: pa.int64(),
    T.DoubleType: pa.float64(),
    T.BooleanType: pa.bool_(),
    T.BinaryType: pa.binary(),
    T.ShortType: pa.int16(),
    T.ByteType: pa.int8(),
    T.FloatType: pa.float32(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, arrow_type(f.dataType)) for f in kind])
    return _PLAIN[type(kind)]


def struct_of(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def found(docs: DataFrame, kernel: Callable[..., Iterable[tuple]], schema: str, key: str = "doc_id", inputs: tuple[str, ...] = ("text",), where: str | None = None) -> DataFrame:
    """``key`` and the columns of ``schema``: one row for each tuple that ``kernel`` gives for a document's inputs.

    Documents whose first input is null have no rows; ``where`` is a pattern (Java) that the first input has to match,
    so that other texts never leave the JVM.
    """
    fields = struct_of(schema)
    kinds = [arrow_type(f.dataType) for f in fields]
    names = [key, *fields.names]
    chosen = docs.where(F.col(inputs[0]).isNotNull())
    if where:
        chosen = chosen.where(F.col(inputs[0]).rlike(where))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []

            def made() -> pa.RecordBatch:
                columns = list(zip(*rows)) if rows else [()] * len(kinds)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)  # noqa: B023

            for i, values in enumerate(zip(*(batch.column(1 + j) for j in range(len(inputs))))):
                for row in kernel(*(v.as_py() for v in values)):
                    at.append(i)
                    rows.append(row)
                if len(rows) >= FLUSH:
                    yield made()
                    at, rows = [], []
            yield made()

    return chosen.select(key, *inputs).mapInArrow(of, T.StructType([docs.schema[key], *fields]))


def column(kernel: Callable[..., object], kind: str | T.DataType, *inputs: Column | str) -> Column:
    """A column of what ``kernel`` gives for each row's inputs; null where the first of them is null."""
    spark_type = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    to = arrow_type(spark_type)

    def of(*columns: pa.Array) -> pa.Array:
        return pa.array([None if values[0] is None else kernel(*values) for values in zip(*(c.to_pylist() for c in columns))], to)

    # The Arrow function needs its arguments by number.
    if len(inputs) == 1:
        return F.arrow_udf(lambda a: of(a), returnType=spark_type)(*inputs)
    if len(inputs) == 2:
        return F.arrow_udf(lambda a, b: of(a, b), returnType=spark_type)(*inputs)
    return F.arrow_udf(lambda a, b, c: of(a, b, c), returnType=spark_type)(*inputs)


@lru_cache(maxsize=512)
def compiled(pattern: str) -> re.Pattern:
    r"""A pattern as Java and RE2 write it: ``\x{...}`` for code points, classes such as ``\s`` and ``\b`` in ASCII."""
    return re.compile(re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), pattern), re.ASCII)


def newline_places(text: str) -> list[int]:
    return [m.start() for m in re.finditer("\n", text)]


class Places:
    """Lines, columns (UTF-16) and byte offsets of ascending positions of a text, in one pass."""

    def __init__(self, text: str):
        self.text, self.at, self.line, self.byte, self.begin = text, 0, 1, 0, 0

    def of(self, pos: int) -> tuple[int, int, int]:
        """(line, column, byte offset); positions must not go down."""
        part = self.text[self.at : pos]
        self.byte += len(part.encode("utf-8", "surrogatepass"))
        lines = part.count("\n")
        if lines:
            self.line += lines
            self.begin = self.at + part.rindex("\n") + 1
        self.at = pos
        return self.line, 1 + len(self.text[self.begin : pos].encode("utf-16-le", "surrogatepass")) // 2, self.byte
