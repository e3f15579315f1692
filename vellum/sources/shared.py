"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str | None:
    """The folder in spark.checkpoint.dir; a local one where it is unset in local mode, as in tests; else none."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        top = "file://" + tempfile.mkdtemp(prefix="vellum-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/") if top else None


def written(df: DataFrame) -> DataFrame:
    """df written and read again, so that a loop's plan doesn't grow and a lost executor costs one step; df itself where there
    is no shared folder."""
    folder = shared_folder(df.sparkSession)
    if folder is None:
        return df
    path = f"{folder}/vellum/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stacked(parts: list[DataFrame]) -> DataFrame:
    """Tables of one schema that `written` gave, as one scan of all their files; their union where there is no shared folder."""
    if shared_folder(parts[0].sparkSession) is None or any(p.schema != parts[0].schema for p in parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out
    folders = {f.rpartition("/")[0] for p in parts for f in p.inputFiles()}
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*sorted(folders))
