"""Token ids and masks in Arrow IPC files of fixed-size-list batches.

Rows are put in ascending doc_id order by a range shuffle (ties: by a hash of the text, so that a doc_id on many rows is
dealt over tasks); each task writes its range of ids as rows of `width` ids and a mask (false: padding), in batches of
equal size, so row i of a file is found by division and read without a copy. A second file holds each document's id, start
and count. A document's start in the whole corpus is the tokens of the files before plus its start in its own file.

Rows: null and empty texts hold only the end id. Repeated rows and null doc_ids (first) are written like any other row. An
empty table gives no file and an empty result.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialize, new_path
from vellum.llm.files import attempt_path, filesystem, make_folder
from vellum.llm.tokens import encoded_batches

MANIFEST = "task long, path string, index_path string, n_docs long, n_tokens long"
BATCH = 256
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(width: int, kind) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, width)), ("mask", pa.list_(pa.bool_(), width))])


def _writer(tokenizer: str, end_id: int, width: int, bits: int, folder: str):
    end, kind, dtype = int(end_id).to_bytes(4, "little"), {16: pa.uint16(), 32: pa.uint32()}[bits], f"<u{bits // 8}"

    def run(batches):
        import numpy as np

        task, schema = TaskContext.get().partitionId(), _schema(width, kind)
        system, base = filesystem(folder)
        path, index_path = attempt_path(base, task, ".arrow"), attempt_path(base, task, ".index.arrow")
        n_docs = n_tokens = 0
        with system.open_output_stream(path) as out, pa.ipc.new_file(out, schema) as ids_file, system.open_output_stream(index_path) as out2, pa.ipc.new_file(out2, INDEX) as index_file:
            held, n_held, full = [], 0, width * BATCH

            def put(flat, n):
                size = -(-n // width) * width
                values, mask = np.zeros(size, dtype), np.zeros(size, bool)
                values[:n], mask[:n] = flat[:n], True
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), width) for x in (values, mask)]
                ids_file.write_batch(pa.RecordBatch.from_arrays(lists, schema=schema))

            for doc_ids, texts in encoded_batches(batches, tokenizer):
                lengths = np.array([len(t) // 4 + 1 for t in texts], np.int64)
                starts = n_tokens + np.cumsum(lengths) - lengths
                index_file.write_batch(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts), pa.array(lengths)], schema=INDEX))
                n_docs, n_tokens = n_docs + len(texts), n_tokens + int(lengths.sum())
                flat = np.frombuffer(b"".join([x for t in texts for x in (t, end)]), "<u4")
                if bits == 16 and flat.max(initial=0) > 0xFFFF:
                    raise ValueError("ids don't fit in 16 bits")
                held.append(flat.astype(dtype))
                n_held += len(flat)
                if n_held >= full:
                    flat = np.concatenate(held)
                    for lo in range(0, n_held - full + 1, full):
                        put(flat[lo : lo + full], full)
                    held = [flat[n_held - n_held % full :]]
                    n_held %= full
            if n_held:
                put(np.concatenate(held), n_held)
        if n_docs:
            yield pa.RecordBatch.from_pylist([{"task": task, "path": path, "index_path": index_path, "n_docs": n_docs, "n_tokens": n_tokens}], schema=pa.schema([("task", pa.int64()), ("path", pa.string()), ("index_path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
        else:
            for p in (path, index_path):
                system.delete_file(p)

    return run


def write(docs: DataFrame, tokenizer: str, *, end_id: int = 2, width: int = 2048, bits: int = 16, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write docs (doc_id, text); returns the manifest (task, path, index_path, n_docs, n_tokens, start) and the folder."""
    folder = folder or new_path(docs.sparkSession, "token_files")
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    manifest = materialize(ordered.mapInArrow(_writer(tokenizer, end_id, width, bits, folder), MANIFEST), "manifest")
    # One row a file.
    start = F.sum("n_tokens").over(Window.orderBy("task")) - F.col("n_tokens")
    return manifest.withColumn("start", start), folder


def sequence(system, path: str, i: int):
    """Row i of a file: (ids, mask), views of the mapped file where the file system can map it."""
    source = pa.memory_map(path) if system.type_name == "local" else system.open_input_file(path)
    reader = pa.ipc.open_file(source)
    row = reader.get_batch(i // BATCH).slice(i % BATCH, 1)
    return row.column(0).flatten(), row.column(1).flatten()


def _reader(folder: str):
    def run(batches):
        import numpy as np

        system, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source = pa.memory_map(row["path"]) if system.type_name == "local" else system.open_input_file(row["path"])
                with source, system.open_input_file(row["index_path"]) as index_source:
                    ids_file, index_file = pa.ipc.open_file(source), pa.ipc.open_file(index_source)
                    ahead, b = np.zeros(0, "<u4"), 0
                    for k in range(index_file.num_record_batches):
                        index = index_file.get_batch(k)
                        n = index.column("n_tokens").to_numpy()
                        parts, have = [ahead], len(ahead)
                        while have < n.sum():
                            got = ids_file.get_batch(b)
                            b += 1
                            flat = got.column("ids").flatten().to_numpy()
                            keep = got.column("mask").flatten().to_numpy(zero_copy_only=False)
                            parts.append((flat if keep.all() else flat[keep]).astype("<u4"))
                            have += len(parts[-1])
                        flat = np.concatenate(parts)
                        ends = np.cumsum(n)
                        crc = [zlib.crc32(flat[e - m : e]) for e, m in zip(ends, n)]
                        ahead = flat[ends[-1] :]
                        start = pa.array(index.column("start").to_numpy() + row["start"])
                        yield pa.RecordBatch.from_arrays([index.column("doc_id"), start, pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32 of its little-endian 32-bit ids."""
    files = manifest.select("path", "index_path", "start")
    return files.repartition(max(1, files.count())).mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")
