"""Files that tasks write and read by range in the shared folder, on any store pyarrow knows."""

from __future__ import annotations

from pyarrow import fs


def folder(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme is a file path."""
    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file://"):
            path = "file://" + path.removeprefix("file:")
        store, root = fs.FileSystem.from_uri(path)
    else:
        store, root = fs.LocalFileSystem(), path
    store.create_dir(root, recursive=True)
    return store, root.rstrip("/")


def opened_for_write(store: fs.FileSystem, path: str):
    return store.open_output_stream(path, compression=None)


def opened_for_read(store: fs.FileSystem, path: str):
    return store.open_input_file(path)


def opened_as_stream(store: fs.FileSystem, path: str):
    """A file that is read from its start to its end in small steps."""
    return store.open_input_stream(path, compression=None, buffer_size=1 << 20)
