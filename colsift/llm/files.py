"""Files that tasks write in a shared folder: under a temporary name first, listed in a manifest once they are whole.

A task that is run again writes other names; only the files in the manifest, which holds the rows of the attempts Spark accepted, count.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


# Names that Hadoop and pyarrow have for the same stores.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder; a clear error where pyarrow has none for it."""
    scheme, sep, rest = uri.partition("://")
    if sep:
        uri = SCHEMES.get(scheme, scheme) + sep + rest
    else:
        uri = uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri
    try:
        return fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError) as error:
        raise ValueError(f"tasks write files through pyarrow, which can't open {uri} ({error}); name a spark.checkpoint.dir that it can") from error


class Rolling:
    """One file of a task at a time."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.system, self.root = opened(folder)
        self.system.create_dir(f"{self.root}/tmp", recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.stream = self.system.open_output_stream(f"{self.root}/tmp/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def commit(self) -> str:
        """Give the whole file its final name."""
        self.stream.close()
        self.system.move(f"{self.root}/tmp/{self.name}", f"{self.root}/{self.name}")
        return self.name


def content(folder: str, name: str):
    system, root = opened(folder)
    return system.open_input_file(f"{root}/{name}")
