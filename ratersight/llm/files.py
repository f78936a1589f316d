"""Binary files in the shared folder, written and range-read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _of(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace(":/", ":///", 1))


@contextmanager
def writing(folder: str, name: str) -> Iterator:
    """A stream to a file that appears under its name only when it is complete; a repeated task replaces it whole."""
    system, path = _of(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, f"{path}/{name}")


class Ranges:
    """Random access to one file: size, and read(start, length)."""

    def __init__(self, folder: str, name: str):
        system, path = _of(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        self.size = self.file.size()

    def read(self, start: int, length: int) -> bytes:
        got = self.file.read_at(length, start)
        if len(got) != length:
            raise ValueError(f"{length} bytes at {start} asked for, {len(got)} there")
        return got

    def close(self) -> None:
        self.file.close()
