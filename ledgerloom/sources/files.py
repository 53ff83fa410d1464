"""Files of a folder, as the data sources' readers and writers see them: through pyarrow's file systems (local, HDFS, the usual object stores)."""

from __future__ import annotations

import fnmatch
import re

from pyarrow import fs as pafs


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path within it, of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(path)


def listed(path: str, pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files under a folder, or of the file itself, in order; names beginning with `_` or `.` are left out."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
    hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(root) :].split("/"))
    return sorted((f.path, f.size) for f in found if f.is_file and not hidden(f.path) and fnmatch.fnmatch(f.base_name, pattern))


def source_of(path: str) -> str:
    """What a file is called in its rows: the value of a `source_file=` folder above it, else its name without the ending."""
    given = re.search(r"/source_file=([^/]+)/", path)
    return given[1] if given else re.sub(r"(?<=[^/])\.[^./]*$", "", path.rsplit("/", 1)[-1])
