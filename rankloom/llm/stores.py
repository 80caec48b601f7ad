"""Files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def arrow_uri(uri: str) -> str:
    """The URI by pyarrow's names of the file systems that Hadoop names otherwise."""
    scheme, rest = uri.split("://", 1)
    if scheme in ("s3a", "s3n"):
        return f"s3://{rest}"
    if scheme in ("wasb", "wasbs"):
        return f"abfs{scheme[4:]}://{rest.replace('.blob.', '.dfs.', 1)}"
    return uri


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """A URI of file, hdfs, s3 (s3a), gs or abfs (wasb); the driver has qualified every path (see :func:`rankloom.llm.work.qualified`)."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    if "://" not in uri:
        raise ValueError(f"{uri} names no file system")
    return fs.FileSystem.from_uri(arrow_uri(uri))


def create_file(uri: str):
    where, path = locate(uri)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_file(uri: str):
    where, path = locate(uri)
    return where.open_input_stream(path, compression=None, buffer_size=1 << 20)
