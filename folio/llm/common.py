"""What the corpus operators share: shared-folder tables, byte tokenisers and Arrow row maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes handled at once in a Python worker; bounds the token lists built from them.
CHUNK_BYTES = 2 << 20

#: ASCII letters lower-cased, other ASCII but digits turned into spaces, bytes of other characters kept.
ALNUM_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes.lower and bytes.split know ASCII only)."""
    return text.lower().split()


def alnum_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and all other-than-ASCII characters, A-Z lower-cased."""
    return text.translate(ALNUM_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the checkpoint folder set in the session.

    Where neither is set, a local session (tests) gets a folder of its own; on a cluster that is an error, as a folder of
    one machine would be unseen by the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    path = path or spark.sparkContext.getCheckpointDir()
    if not path and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not path:
        path = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def shuffle_partitions(df: DataFrame, factor: int = 1) -> int:
    """Partitions for an explicit repartition: the session's, which the cluster sizes to its data."""
    return factor * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def row_ranges(sizes: Iterable[int | None], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges with at most `limit` bytes each (a single larger row stands alone)."""
    start = end = total = 0
    for i, size in enumerate(sizes):
        size = size or 0
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
        end = i + 1
    if start < end:
        yield start, end


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """The batch cut into slices of bounded text, each with its texts as UTF-8 bytes (None for null)."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    sizes = pc.binary_length(texts).to_pylist()
    for a, b in row_ranges(sizes, limit):
        yield batch.slice(a, b - a), texts.slice(a, b - a).cast(pa.binary()).to_pylist()


def give_back() -> None:
    """Hand freed memory back to the system: a worker serves many tasks and would hold on to the most that any had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_texts(
    df: DataFrame,
    text: str,
    new: T.StructType,
    make: Callable[[], Callable[[list[bytes | None], pa.RecordBatch], list]],
    keep: list[str] | None = None,
    also: list[str] = (),
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """Add columns made from texts, in Arrow batches and without a shuffle.

    make() runs once per task and gives f(texts, slice) -> one sequence per new column. Columns in keep (default: all)
    pass through; an input column named like a new one is replaced. `also` names further columns that f reads.
    """
    names = [f.name for f in new]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    read = list(dict.fromkeys([*kept, text, *also]))
    fields = [df.schema[c] for c in kept]
    schema = T.StructType([*fields, *new.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    types = [arrow.field(n).type for n in names]

    def run(batches):
        f = make()
        for batch in batches:
            for part, texts in text_slices(batch, text, limit):
                made = f(texts, part)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                columns = [c if c.type == arrow.field(n).type else c.cast(arrow.field(n).type) for c, n in zip(columns, kept)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *(pa.array(m, t) for m, t in zip(made, types))], schema=arrow
                )
        give_back()

    return df.select(*[F.col(f"`{c}`") for c in read]).mapInArrow(run, schema)


#: A key is hot above this share of the rows (there are fewer such keys than its inverse), and is dealt into so many parts.
HOT_SHARE, HOT_PARTS = 1000, 32


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key) of those that hold more than one in HOT_SHARE of the rows: fewer than HOT_SHARE keys, so it can be broadcast."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    return counts.filter((F.col("__n") > 1) & (F.col("__n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key)


def join_salted(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame, parts: int = HOT_PARTS) -> DataFrame:
    """rows joined with table (a row a key); rows of hot keys are dealt into `parts`, and the table's rows of those repeated.

    rows should be read from storage, so that a task run again deals its rows alike.
    """
    mark = F.broadcast(hot.withColumn("__hot", F.lit(True)))
    place = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(0).cast("int")
    every = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(mark, key, "left").withColumn("__salt", place).drop("__hot")
    right = table.join(mark, key, "left").withColumn("__salt", F.explode(every)).drop("__hot")
    return left.join(right, [key, "__salt"]).drop("__salt")
