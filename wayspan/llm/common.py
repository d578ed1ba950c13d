"""What several of the operators share: staged tables, text batches, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters outside these.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one slice of a batch holds in Python at a time (a longer text is a slice of its own).
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a single machine where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayspan-"))
    return context.getCheckpointDir()


def col(name: str):
    """A column by its exact name, dots included."""
    return F.col(f"`{name}`")


def n_words(text: str):
    """Words of a text column; null has none."""
    return F.coalesce(F.regexp_count(col(text), F.lit(WORD)), F.lit(0)).cast("long")


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes the rows to the shared folder and reads them back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of at most ``SLICE_BYTES`` of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    begin = held = 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > SLICE_BYTES:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield batch.slice(begin)


def with_text_columns(df: DataFrame, text: str, keep: list[str], fields: list[T.StructField], setup: Callable) -> DataFrame:
    """``keep`` columns and new ``fields`` computed from the column ``text``.

    ``setup()`` runs once a task and returns a function from an Arrow string array to
    one Arrow array a field. A mapInArrow over the scan: no shuffle, bounded memory.
    """
    # columns go through Python by number: their own names may hold dots or clash
    at = f"k{keep.index(text)}" if text in keep else "text"
    source = df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], *([] if text in keep else [col(text).cast("string").alias(at)]))
    held = [f"k{i}" for i in range(len(keep))]
    schema = T.StructType([T.StructField(c, source.schema[c].dataType) for c in held] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns_of = setup()
        for batch in batches:
            for part in slices(batch, at):
                new = columns_of(part.column(at))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in held], *new], names=names)

    return source.mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])


def components(edges: DataFrame, name: str) -> DataFrame:
    """(src, dst) long edges -> (node, root): each node of an edge with the least node it reaches.

    Each round hooks every node to its least neighbour, jumps one pointer and renames
    the edges; nodes that hook vanish, at least half of those left, so rounds grow as
    the logarithm of the longest path. Every step is a keyed join, merged and not broadcast, or a partial
    aggregation; tables between rounds are staged, nothing is collected.
    """
    edges = staged(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct(), f"{name}-edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("dst", "src"))
        hook = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("up"))
        hook = staged(hook, f"{name}-hook")
        top = hook.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        jump = staged(hook.join(top.hint("merge"), "up", "left").select("node", F.coalesce("upper", "up").alias("up")), f"{name}-jump")
        levels.append(jump)
        edges = (
            edges.join(jump.select(F.col("node").alias("src"), F.col("up").alias("a")).hint("merge"), "src")
            .join(jump.select(F.col("node").alias("dst"), F.col("up").alias("b")).hint("merge"), "dst")
            .where("a <> b")
            .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))
            .distinct()
        )
        edges = staged(edges, f"{name}-edges")
    if not levels:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    out = levels.pop().select("node", F.col("up").alias("root"))
    while levels:
        above = out.select(F.col("node").alias("up"), "root")
        out = levels.pop().join(above.hint("merge"), "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return out
