"""Shared helpers: scratch tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's and the contracts' ASCII white space, as a Java regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a new local one where it is unset in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_FOLDERS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_FOLDERS[-1] if _FOLDERS else scratch_dir(spark) + '/vellum'}/{uuid.uuid4().hex}/{name}"


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside are deleted at the end; what lives on is kept with `keep`."""
    folder = f"{scratch_dir(spark)}/vellum/{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    try:
        yield
    finally:
        _FOLDERS.pop()
        delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "", path: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Survives lost executors."""
    path = path or new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Materialize outside the present scratch folder."""
    held, _FOLDERS[:] = list(_FOLDERS), _FOLDERS[:-1]
    try:
        return materialize(df, name)
    finally:
        _FOLDERS[:] = held


#: Bits of a filter of ids: 8 for each id, within these bounds (8 KB to 16 MB).
FILTER_BITS = 16, 27


def id_filter(ids: DataFrame) -> bytes:
    """A one-hash Bloom filter of the only (long) column. Beyond 2^24 ids more and more others pass it, which costs shuffle
    but changes no result: whatever passes is joined exactly."""
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (8 * ids.count()).bit_length()))
    bit = F.pmod(F.xxhash64(ids.columns[0]), F.lit(1 << bits))
    at = ids.select(bit.alias("bit")).select(F.shiftright("bit", 15).alias("part"), F.col("bit").bitwiseAND(32767).alias("at"))
    out, size = bytearray((1 << bits) // 8), 32768 // 8
    for p in at.groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        out[p["part"] * size : (p["part"] + 1) * size] = p["bits"]
    return bytes(out)


def bit_test(held: bytes, hashes):
    """Which of an Arrow array of xxhash64 values may be in a filter, as a numpy array."""
    import numpy as np

    table = np.frombuffer(held, np.uint8)
    at = hashes.to_numpy() & (8 * len(table) - 1)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filtered(df: DataFrame, column: str, held, inside: bool) -> DataFrame:
    """Rows of df whose (long) column may be in a broadcast filter, or surely isn't. No shuffle."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            hit = bit_test(held.value, batch.column(0))
            yield batch.filter(pa.array(hit == inside)).select(range(1, batch.num_columns))

    rows = df.select(F.xxhash64(column).alias("__hash"), *[F.col(f"`{c}`") for c in df.columns])
    return rows.mapInArrow(run, df.schema)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a table. They go as Arrow: plain rows become an RDD of pickles, for which each executor starts
    Python workers of another kind, and their parent stays."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    fields = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields), kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def where_computed(df: DataFrame, condition: F.Column) -> DataFrame:
    """Filter by columns that are costly to compute. The optimizer would move the condition below their projections and
    compute each of them again inside it; it does not move it below a projection with a row number."""
    return df.withColumn("__row", F.monotonically_increasing_id()).where(condition & (F.col("__row") >= 0)).drop("__row")


def words_of(text) -> F.Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text column as an array; null: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")
