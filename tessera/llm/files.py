"""Files that tasks write and read in the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

from tessera.session import checkpoint_dir, opened


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of the session; it is made by its first writer."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def new_file(folder: str, name: str):
    """Output stream of a new file of ``folder`` and its path.

    Each attempt of a task writes a name of its own; a file counts only if the task that wrote it reports it.
    """
    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    file = f"{name}-{uuid.uuid4().hex}"
    return system.open_output_stream(f"{base}/{file}", compression=None), f"{folder}/{file}"


def read_file(path: str) -> bytes:
    system, at = opened(path)
    with system.open_input_file(at) as stream:
        return stream.read()
