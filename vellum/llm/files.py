"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def attempt_path(folder: str, task: int, suffix: str) -> str:
    """A name of its own for each attempt: only the attempt whose manifest row Spark keeps counts, others are never read."""
    return f"{folder}/part-{task:06d}-{uuid.uuid4().hex}{suffix}"


def make_folder(uri: str) -> None:
    system, path = filesystem(uri)
    system.create_dir(path, recursive=True)
