"""Helpers shared by the operators: Arrow maps, scratch tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadflow.session import ensure_checkpoint_dir

#: Texts that a Python task holds as objects at a time.
SLICE_ROWS = 1024

#: Arrow types of the columns that operators add.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
         "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
         "array<int>": pa.list_(pa.int32()), "array<float>": pa.list_(pa.float32()),
         "array<string>": pa.list_(pa.string())}

Fields = Sequence[tuple[str, str]]


def schema_of(df: DataFrame, keep: Sequence[str], fields: Fields) -> T.StructType:
    """The kept columns of ``df`` followed by the added fields."""
    added = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in fields))
    return T.StructType([*(df.schema[c] for c in keep), *added.fields])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a bounded number of rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def map_texts(df: DataFrame, text: str, fn: Callable[[list], list[Sequence]], fields: Fields,
              keep: Sequence[str]) -> DataFrame:
    """One output row per input row: ``keep`` columns, then what ``fn`` makes of the texts.

    ``fn`` gets a list of texts (``None`` for null) and returns one sequence per
    field.  Columns not named are never shipped to Python; kept columns pass
    through as Arrow arrays without becoming Python objects.
    """
    names = list(dict.fromkeys([*keep, text]))
    at, kept = names.index(text), [names.index(c) for c in keep]
    types = [ARROW[t] for _, t in fields]
    out_names = [*keep, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            made = fn(part.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i) for i in kept),
                 *(pa.array(v, t) for v, t in zip(made, types, strict=True))], out_names)

    return df.select(*map(quoted, names)).mapInArrow(run, schema_of(df, keep, fields))


def explode_texts(df: DataFrame, text: str, fn: Callable[[list], tuple[Sequence, list[Sequence]]],
                  fields: Fields, keep: Sequence[str]) -> DataFrame:
    """Any number of output rows per input row.

    ``fn`` returns the input row index of each output row, then one sequence
    per field; the kept columns are repeated accordingly.
    """
    names = list(dict.fromkeys([*keep, text]))
    at, kept = names.index(text), [names.index(c) for c in keep]
    types = [ARROW[t] for _, t in fields]
    out_names = [*keep, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows, made = fn(part.column(at).to_pylist())
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(rows) for i in kept),
                 *(pa.array(v, t) for v, t in zip(made, types, strict=True))], out_names)

    return df.select(*map(quoted, names)).mapInArrow(run, schema_of(df, keep, fields))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def one_text(df: DataFrame, id_col: str, text: str = "__text", label: str = "__label") -> DataFrame:
    """One row (id, label, text) per id: of different texts the one with the smallest hash, ties by the text.

    A grouped minimum, combined before the shuffle, so the choice does not depend on partitioning.
    """
    first = F.min(F.struct(F.xxhash64(text).alias("hash"), F.col(text).alias("text"))).alias("__first")
    return df.groupBy(id_col, label).agg(first).select(id_col, label, F.col("__first.text").alias(text))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: one (node, root) row per node of an edge.

    ``root`` is the smallest node of the component.  Alternates large-star and
    small-star steps until the edge set is a forest of stars; each step is a
    grouped minimum (combined before the shuffle) and an equality join.  The
    edges of a round are written, so that small ones take few tasks to read
    again.  Edges never leave the executors.
    """
    def step(e: DataFrame) -> DataFrame:
        ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")),
                       F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
        both = e.select(F.inline(ends))  # large star: of every node its larger neighbours
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.repartition("u").distinct()  # small star: of every node its smaller neighbours, all in one place
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        made = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")),
                       F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
        return large.join(low, "u").select(F.inline(made)).filter("a != b").distinct()

    def stars(e: DataFrame) -> bool:
        """Whether every larger end has one edge only."""
        ends = F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("larger")),
                       F.struct(F.col("b").alias("node"), F.lit(0).alias("larger")))
        counted = e.select(F.inline(ends)).groupBy("node").agg(
            F.sum("larger").alias("larger"), F.count(F.lit(1)).alias("edges"))
        return counted.filter("larger > 0 AND edges > 1").isEmpty()

    now = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
                  .filter("a != b").distinct(), "edges")
    while not stars(now):
        now = written(step(now), "edges")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
