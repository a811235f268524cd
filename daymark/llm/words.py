"""Word rules shared by the text operators, as Python patterns and as Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run without ASCII white space.
WORD = re.compile("[^\x20\x09-\x0d]+")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def ascii_lower_column(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def crc_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def masked(docs: DataFrame) -> DataFrame:
    """The same rows with columns named d0, d1, ...: no name can clash with one an operator adds."""
    return docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])


def unmasked(frame: DataFrame, like: DataFrame) -> DataFrame:
    """Only the masked columns of ``frame``, under the names they have in ``like``."""
    return frame.select([f"d{i}" for i in range(len(like.columns))]).toDF(*like.columns)


def position(docs: DataFrame, column: str) -> str:
    """The masked name of a column."""
    return f"d{docs.columns.index(column)}"


_LONGS, _TEXTS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
#: Column kinds that ``add_columns`` can make, in Spark and in Arrow.
KINDS = {
    "bigint": (T.LongType(), pa.int64()), "double": (T.DoubleType(), pa.float64()),
    "string": (T.StringType(), pa.string()), "int": (T.IntegerType(), pa.int32()),
    "array<bigint>": (_LONGS, pa.list_(pa.int64())),
    "array<string>": (_TEXTS, pa.list_(pa.string())),
    "array<double>": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
    "array<array<bigint>>": (T.ArrayType(_LONGS), pa.list_(pa.list_(pa.int64()))),
}


def add_columns(frame: DataFrame, inputs: Sequence[str], outputs: dict[str, str],
                start: Callable[[], Callable[..., Sequence]],
                drop: Sequence[str] = ()) -> DataFrame:
    """``frame`` with columns computed in Python from the columns ``inputs``, batch by batch.

    ``start`` runs once in each task and returns a function of the input lists that gives one
    list per output. All other columns pass through untouched; columns named like an output are
    replaced and those in ``drop`` left out.
    """
    passed = [c for c in frame.columns if c not in outputs and c not in drop]
    schema = T.StructType([frame.schema[c] for c in passed])
    for name, kind in outputs.items():
        schema.add(name, KINDS[kind][0])
    kinds = [KINDS[k][1] for k in outputs.values()]
    names = [*passed, *outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = start()
        for batch in batches:
            made = compute(*[batch.column(c).to_pylist() for c in inputs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed]
                + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=names)

    return frame.mapInArrow(run, schema)
