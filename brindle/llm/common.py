"""Shared helpers: word splitting, Arrow mapping over rows, scratch tables and row identity."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows handed to a Python function at once; bounds what a worker holds beside the Arrow batch.
ROWS_AT_ONCE = 256

#: Bytes of lower-cased words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+: A-Z become a-z, other ASCII but digits and letters become a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded_words(text: bytes | None) -> list[bytes]:
    """Words of a text after A-Z are lower-cased; null has none."""
    return text.translate(FOLD).split() if text else []


def plain_words(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as they stand: bytes.split() breaks at exactly these six characters."""
    return text.split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct_of(schema: str | StructType) -> StructType:
    return _parse_datatype_string(schema) if isinstance(schema, str) else schema


def column_values(column: pa.Array, as_bytes: bool = False) -> list:
    """Python values of an Arrow column; as_bytes gives a string column's UTF-8 without decoding it."""
    if as_bytes and (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.to_pylist()


def map_rows(df: DataFrame, fn: Callable[..., Iterable[Sequence]], schema: str | StructType, as_bytes: bool = False, rows: int = ROWS_AT_ONCE) -> DataFrame:
    """Give fn the columns of df as lists, some rows at a time; it returns the output columns, as lists or numpy arrays of one length.

    A column named CARRIED doesn't reach fn: it comes out again as it is, as the last column.
    """
    out = struct_of(schema)
    carried = CARRIED in df.columns
    if carried:
        df = df.select(*(c for c in df.columns if c != CARRIED), CARRIED)
        out = StructType([*out.fields, df.schema[CARRIED]])
    ship(df.sparkSession)

    def run(batches):
        arrow = to_arrow_schema(out)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                own = part.columns[:-1] if carried else part.columns
                columns = [pa.array(c, type=f.type) for c, f in zip(fn(*(column_values(c, as_bytes) for c in own)), arrow)]
                if carried:
                    columns.append(part.columns[-1].cast(arrow[-1].type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, out)


#: Name of the struct in which a caller's columns travel, so that none of them can clash with an operator's own.
CARRIED = "carried_row"


def carrying(docs: DataFrame, carry: bool, *without: str) -> list[Column]:
    """The struct of all columns of docs but those named, if it is asked for. doc_id is always one, so that it is never empty."""
    return [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in without)).alias(CARRIED)] if carry else []


_SHIPPED: set[str] = set()
#: Bytes of a batch of rows that Spark hands to Python, in place of Spark's default of 64 MB: both sides hold batches, for each task.
BATCH_BYTES, BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Let Spark send this package to the executors, once a context, as --py-files would, and bound what it hands to Python at once."""
    sc = spark.sparkContext
    if spark.conf.get(BATCH) == "67108864b":  # as it is where the session doesn't set it
        spark.conf.set(BATCH, f"{BATCH_BYTES}b")
    if sc.applicationId in _SHIPPED:
        return
    import tempfile
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parents[1]
    target = f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the cluster's shared folder and read it back: later steps neither repeat its work nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/brindle-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove the files of a scratch table that no later step reads."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A session on one machine may lack it and gets a local folder; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def identified(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the given columns, with uid, a long that differs on every row.

    doc_id serves where it is never null and never repeated. Otherwise rows get a number that a
    scratch table holds still, so that a recomputed task sees the same one.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *columns)
    repeated = base.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()
    if not repeated:
        return base.withColumn("uid", F.col("doc_id"))
    return scratch(base.withColumn("uid", F.monotonically_increasing_id()), "rows")


def halves(digest: Column) -> tuple[Column, Column]:
    """The 128 bits of an MD5 in hexadecimal, as two longs."""
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17))


def spread(h: np.ndarray) -> np.ndarray:
    """Mix the bits of uint64 values (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(27)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        return h
