"""Files of the shared folder as tasks of Python data sources see them, through Arrow's file systems."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    local = re.fullmatch(r"(?:file:/{1,3})?(/?[^:]*)", path)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return fs.FileSystem.from_uri(path)


def listed(store: fs.FileSystem, folder: str) -> list[str]:
    """Paths of the files of a folder, in order; none if there is no such folder."""
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File)


def read(store: fs.FileSystem, path: str) -> str:
    with store.open_input_stream(path) as file:
        return file.read().decode("utf-8")


def put(store: fs.FileSystem, path: str, text: str) -> None:
    """Writes a file that readers see as a whole or not at all."""
    beside = f"{path}.writing"
    with store.open_output_stream(beside) as file:
        file.write(text.encode("utf-8"))
    store.move(beside, path)
