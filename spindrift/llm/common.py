"""Helpers shared by the training-data operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts, and bytes of text, that a Python worker turns into objects at once (one text at least); a worker's memory
#: follows these, not the partition.
SLICE, SLICE_BYTES = 256, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark only (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, with its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a folder is made in local mode only: a
    machine-local folder on a cluster would not be seen by the other executors.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each action within go when it ends, else only when the driver happens to collect its garbage.

    For operators of many small jobs: each task of a shuffle leaves three files, however few rows it had."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, for helper columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(column: pa.Array) -> list[tuple[int, int]]:
    """(start, length) of runs of rows within SLICE and SLICE_BYTES."""
    n = len(column)
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)):
        return [(at, min(SLICE, n - at)) for at in range(0, n, SLICE)]
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    cut, held, at = [], 0, 0
    for i, size in enumerate(sizes):
        if i > at and (held + size > SLICE_BYTES or i - at >= SLICE):
            cut.append((at, i - at))
            at, held = i, 0
        held += size
    return cut + ([(at, n - at)] if n else [])


def map_texts(df: DataFrame, text: str, outputs: dict[str, T.DataType], start: Callable[[], Callable[[list], list]], keep: list[str] | None = None) -> DataFrame:
    """``df`` with columns computed from one text column, a bounded slice of rows at a time.

    ``start()`` runs once in each task and gives a function from a list of texts (str or None) to one list, or Arrow
    array of the type, for each column of ``outputs``. ``keep`` lists the columns of ``df`` that stay (all, if None); ``outputs`` replaces
    columns of the same name. No shuffle; the number of rows is unchanged.
    """
    stay = [c for c in (df.columns if keep is None else keep) if c not in outputs]
    # a text that stays goes to Python once, and back
    taken = df.select(*[df[f"`{c}`"] for c in stay], *([] if text in stay else [df[f"`{text}`"].alias("__text")]))
    read = stay.index(text) if text in stay else len(stay)
    schema = T.StructType([df.schema[c] for c in stay] + [T.StructField(n, t) for n, t in outputs.items()])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in batches:
            for at, n in slices(batch.column(read)):
                part = batch.slice(at, n)
                made = f(part.column(read).to_pylist())
                columns = [part.column(i) for i in range(len(stay))]
                columns += [x if isinstance(x, pa.Array) else pa.array(x, arrow.field(len(stay) + i).type) for i, x in enumerate(made)]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(n, c.type) for n, c in zip(arrow.names, columns, strict=True)]))

    return taken.mapInArrow(run, schema)
