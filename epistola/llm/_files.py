"""Files that tasks write into the shared folder under final names."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def normal(uri: str) -> str:
    """file:/x and file:///x alike, in the form that pyarrow takes."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def make_dir(uri: str) -> None:
    where, path = _open(normal(uri))
    where.create_dir(path, recursive=True)


def put(uri: str, name: str, blocks) -> None:
    """Writes blocks under a temporary name and moves the file to its final one, so that a task that is lost and run again leaves one whole file."""
    where, path = _open(normal(uri))
    where.create_dir(path, recursive=True)
    temporary = f"{path}/_tmp-{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(temporary, compression=None) as out:
        for block in blocks:
            out.write(block)
    where.move(temporary, f"{path}/{name}")


def names(uri: str) -> list[str]:
    where, path = _open(normal(uri))
    return sorted(x.base_name for x in where.get_file_info(fs.FileSelector(path, recursive=False)) if x.is_file)


def read(uri: str, name: str) -> bytes:
    where, path = _open(normal(uri))
    with where.open_input_stream(f"{path}/{name}", compression=None) as file:
        return file.read()


def there(uri: str, name: str) -> bool:
    where, path = _open(normal(uri))
    return where.get_file_info(f"{path}/{name}").is_file
