"""Token counts from flat files of token ids without an index, by a separator scan.

Files are read in blocks of a fixed size. A first vectorised scan of each block finds its end-of-document ids and keeps
three numbers (how many, the last one's position, tokens); a prefix scan over a file's blocks gives each block the position
of the last separator before it and the documents before it; a second scan then emits the documents that end in the block.

What stands after a file's last separator is one more document without an end (`ended` false), whose count lacks the end
id. Empty files give no rows. A document that holds only its separator has n_tokens 1, so null and empty texts do. Repeated
rows and null or repeated doc_ids are written and counted like any other row. Texts that spell the separator are ordinary
text. Very long texts span blocks and are one document. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, new_path
from vellum.llm.files import attempt_path, filesystem, make_folder
from vellum.llm.tokens import encoded_batches

#: Tokens a block, and blocks a task where there are many.
BLOCK, BUNDLE = 4 << 20, 16
BLOCKS = "file_id long, path string, first long, n long"
WRITTEN = "file_id long, path string, n_tokens long, doc_ids array<long>"


def _writer(tokenizer: str, end_id: int, bits: int, folder: str):
    end, dtype = int(end_id).to_bytes(4, "little"), f"<u{bits // 8}"

    def run(batches):
        import numpy as np

        task, (system, base) = TaskContext.get().partitionId(), filesystem(folder)
        path, total, docs = attempt_path(base, task, ".bin"), 0, []
        kind = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64()))])
        with system.open_output_stream(path) as out:
            for doc_ids, texts in encoded_batches(batches, tokenizer, special_as_text=True):
                flat = np.frombuffer(b"".join([x for t in texts for x in (t, end)]), "<u4")
                if bits == 16 and flat.max(initial=0) > 0xFFFF:
                    raise ValueError("ids don't fit in 16 bits")
                out.write(flat.astype(dtype).tobytes())
                total += len(flat)
                docs = doc_ids
                yield pa.RecordBatch.from_pylist([{"file_id": task, "path": path, "n_tokens": len(flat), "doc_ids": docs}], schema=kind)

    return run


def write_flat(docs: DataFrame, tokenizer: str, *, end_id: int = 49407, bits: int = 16) -> tuple[DataFrame, DataFrame, str]:
    """Flat token files of docs (doc_id, text), a separator after each: (files, order of documents, folder).

    files: file_id, path, n_tokens. order: file_id, nth, doc_id. Texts that spell the separator are ordinary text.
    """
    folder = new_path(docs.sparkSession, "flat_tokens")
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    written = materialize(rows.mapInArrow(_writer(tokenizer, end_id, bits, folder), WRITTEN).withColumn("chunk", F.monotonically_increasing_id()), "written")
    files = written.groupBy("file_id", "path").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum(F.size("doc_ids")).over(Window.partitionBy("file_id").orderBy("chunk")) - F.size("doc_ids")
    order = written.select("file_id", before.alias("before"), "doc_ids").select("file_id", "before", F.posexplode("doc_ids").alias("at", "doc_id"))
    return files, order.select("file_id", (F.col("before") + F.col("at")).alias("nth"), "doc_id"), folder


def _ends(system, row: dict, end_id: int, bits: int):
    import numpy as np

    with system.open_input_file(row["path"]) as f:
        data = f.read_at(row["n"] * bits // 8, row["first"] * bits // 8)
    return np.flatnonzero(np.frombuffer(data, f"<u{bits // 8}") == end_id) + row["first"]


def _summaries(folder: str, end_id: int, bits: int):
    def run(batches):
        system, _ = filesystem(folder)
        for batch in batches:
            rows = batch.to_pylist()
            ends = [_ends(system, r, end_id, bits) for r in rows]
            extra = [pa.array([len(e) for e in ends], pa.int64()), pa.array([int(e[-1]) if len(e) else None for e in ends], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "n_ends", "last_end"])

    return run


def _documents(folder: str, end_id: int, bits: int):
    def run(batches):
        import numpy as np

        system, _ = filesystem(folder)
        for batch in batches:
            for r in batch.to_pylist():
                ends = _ends(system, r, end_id, bits)
                starts = np.concatenate([[r["prev_end"] + 1], ends[:-1] + 1]) if len(ends) else ends
                ended = np.ones(len(ends), bool)
                upto = r["first"] + r["n"]
                rest = int(ends[-1]) + 1 if len(ends) else r["prev_end"] + 1
                if r["is_last"] and rest < upto:
                    starts, ends, ended = np.append(starts, rest), np.append(ends, upto - 1), np.append(ended, False)
                nth = r["docs_before"] + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), r["file_id"]), pa.int64()), pa.array(nth, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts + 1, pa.int64()), pa.array(ended)], ["file_id", "nth", "start", "n_tokens", "ended"])

    return run


def count_tokens(files: DataFrame, folder: str, *, end_id: int = 49407, bits: int = 16, block: int = BLOCK) -> DataFrame:
    """Documents of flat files (file_id, path, n_tokens): file_id, nth, start, n_tokens (with the separator), ended."""
    firsts = files.where("n_tokens > 0").select("file_id", "path", "n_tokens", F.explode(F.expr(f"sequence(0L, n_tokens - 1, {block}L)")).alias("first"))
    blocks = firsts.select("file_id", "path", "first", F.least(F.lit(block), F.col("n_tokens") - F.col("first")).alias("n"), (F.col("first") + block >= F.col("n_tokens")).alias("is_last"))
    blocks = materialize(blocks, "blocks")
    # Blocks go to tasks in bundles once there are more of them than tasks.
    n = blocks.count()
    tasks = max(1, min(n, max(2 * files.sparkSession.sparkContext.defaultParallelism, n // BUNDLE)))
    dealt = blocks.repartition(tasks)
    summary = dealt.mapInArrow(_summaries(folder, end_id, bits), BLOCKS + ", is_last boolean, n_ends long, last_end long")
    earlier = Window.partitionBy("file_id").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    scanned = summary.select(
        "file_id", "path", "first", "n", "is_last",
        F.coalesce(F.max("last_end").over(earlier), F.lit(-1)).alias("prev_end"),
        F.coalesce(F.sum("n_ends").over(earlier), F.lit(0)).alias("docs_before"),
    )
    return scanned.repartition(tasks).mapInArrow(_documents(folder, end_id, bits), "file_id long, nth long, start long, n_tokens long, ended boolean")
