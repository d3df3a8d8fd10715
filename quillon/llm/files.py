"""Binary files in the shared folder, written and range-read by executors through Arrow's file systems."""

from __future__ import annotations

import contextlib


def _at(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


@contextlib.contextmanager
def writing(path: str):
    """A stream into a new file; its folder is made if need be.  A failed attempt's file stays unnamed in any manifest."""
    system, inner = _at(path)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inner, compression=None) as out:
        yield out


@contextlib.contextmanager
def reading(path: str):
    """A file for reading at offsets: read_at(n, offset), size()."""
    system, inner = _at(path)
    with system.open_input_file(inner) as source:
        yield source
