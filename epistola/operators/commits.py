"""Files that are written once: a name is taken by one writer alone, and what stands under it is whole."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Writes a file anew: readers see the one before or this one."""
    where, name = opened(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    temporary = f"{os.path.dirname(name)}/.tmp-{uuid.uuid4().hex}"
    with where.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    where.move(temporary, name)


def put_new(path: str, data: bytes) -> bool:
    """Writes a file only if none has the name; False where there is one.

    On a local folder the whole file is linked to its name, which fails if that is taken. Elsewhere Hadoop's rename without
    overwriting decides, which is atomic on HDFS; a store whose rename is not needs one writer.
    """
    where, name = opened(path)
    where.create_dir(os.path.dirname(name), recursive=True)
    temporary = f"{os.path.dirname(name)}/.tmp-{uuid.uuid4().hex}"
    with where.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    if isinstance(where, fs.LocalFileSystem):
        try:
            os.link(temporary, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext

    jvm = SparkContext._active_spark_context._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri())
    options = SparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        files.rename(jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0] + "/" + os.path.basename(temporary)), target, options)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" not in str(error.java_exception):
            raise
        where.delete_file(temporary)
        return False


def get(path: str) -> bytes | None:
    where, name = opened(path)
    if not where.get_file_info(name).is_file:
        return None
    with where.open_input_stream(name, compression=None) as file:
        return file.read()


def note(path: str) -> dict | None:
    """A small JSON file; None where there is none."""
    data = get(path)
    return None if data is None else json.loads(data)
