"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path)


def write_whole(path: str, parts) -> None:
    """Write byte strings to a file that appears under its name when it is complete.

    A task that runs again, or twice at once, puts the same file in its place.
    """
    fs, at = open_folder(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    half = f"{at}.{uuid.uuid4().hex}.half"
    with fs.open_output_stream(half) as out:
        for part in parts:
            out.write(part)
    fs.move(half, at)


class Ranges:
    """A file to read at given places."""

    def __init__(self, path: str) -> None:
        fs, at = open_folder(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()

    def __call__(self, start: int, length: int) -> bytes:
        data = self.file.read_at(length, start)
        if len(data) != length:
            raise ValueError(f"file ends before {start + length}")
        return data

    def close(self) -> None:
        self.file.close()
