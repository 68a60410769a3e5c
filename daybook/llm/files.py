"""Files that tasks write to and read from the shared folder, by any URI that pyarrow knows.

A task writes under a name of its own and reports it in its rows; the rows that Spark commits name the files that
count, so a retried or speculative task leaves at most a file that nothing refers to.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def fresh(folder: str, suffix: str) -> str:
    """A new name in ``folder``, which is made if it isn't there."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def open_output(uri: str):
    system, path = located(uri)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    system, path = located(uri)
    return system.open_input_file(path)


def file_tasks(files: int, most: int = 10_000) -> int:
    """Tasks that deal with so many files: one each, or several one behind the other."""
    return max(1, min(files, most))


def read_all(uri: str) -> bytes:
    with open_input(uri) as f:
        return f.read()


def write_all(uri: str, data: bytes) -> None:
    with open_output(uri) as f:
        f.write(data)


def remove(uri: str) -> None:
    """Delete a file; one that is gone already, as a retried task finds it, is no error."""
    system, path = located(uri)
    try:
        system.delete_file(path)
    except FileNotFoundError:
        pass
