"""Files on any file system that Arrow knows, by path or URI."""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager
from fnmatch import fnmatchcase

from pyarrow.fs import FileSelector, FileSystem, FileType


#: What a folder of parts holds, in order; written last, so that files of lost
#: task attempts are never read.
MANIFEST = "_parts"


def at(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(path)


def size(path: str) -> int:
    fs, p = at(path)
    info = fs.get_file_info(p)
    if info.type != FileType.File:
        raise FileNotFoundError(path)
    return info.size


def listed(path: str) -> list[str]:
    """The files that path means, by name: itself, those in the folder (of its
    manifest, or all but hidden ones), or those that match a pattern in its last
    part."""
    if (known := manifest(path)) is not None:
        return [name for name, *_ in known]
    fs, p = at(path)
    lead = path[: len(path) - len(p)] if path.endswith(p) else ""
    top, _, last = p.rpartition("/")
    if re.search(r"[*?\[]", last):
        found = [f for f in fs.get_file_info(FileSelector(top or ".")) if f.type == FileType.File and fnmatchcase(f.base_name, last)]
    elif fs.get_file_info(p).type == FileType.Directory:
        found = [f for f in fs.get_file_info(FileSelector(p)) if f.type == FileType.File and f.base_name[0] not in "._"]
    else:
        size(path)
        return [path]
    if not found:
        raise FileNotFoundError(path)
    return [lead + f.path for f in sorted(found, key=lambda f: f.path)]


def read(path: str, offset: int, n: int) -> bytes:
    fs, p = at(path)
    with fs.open_input_file(p) as f:
        return f.read_at(n, offset)


@contextmanager
def opened(path: str):
    """A file to read from at any place."""
    fs, p = at(path)
    with fs.open_input_file(p) as f:
        yield f


def begin(path: str, parts: bool) -> str:
    """A write's own mark; makes the folder that its tasks write to, hidden
    beside path unless parts are to stay (then path itself). Tasks of a write
    that was aborted find no hidden folder any more."""
    mark = uuid.uuid4().hex
    fs, p = at(path if parts else beside(path, mark))
    fs.create_dir(p, recursive=True)
    return mark


def beside(path: str, mark: str) -> str:
    top, _, last = path.rpartition("/")
    return f"{top}/.{last}.part-{mark}"


def part_name(path: str, mark: str) -> str:
    """A name for what one task attempt writes, to be joined later."""
    return f"{beside(path, mark)}/{uuid.uuid4().hex}"


def folder_part(folder: str, mark: str, at: int, ending: str) -> str:
    """A name in a folder of parts for what one task attempt writes."""
    return f"{folder}/part-{at:06d}-{mark}-{uuid.uuid4().hex}{ending}"


def clear(path: str, mark: str, parts: bool) -> None:
    """Delete what the tasks of a write left, those that were killed too."""
    fs, p = at(path if parts else beside(path, mark))
    if parts:
        remove(f.path if path == p else path[: len(path) - len(p)] + f.path for f in fs.get_file_info(FileSelector(p, allow_not_found=True)) if f"-{mark}-" in f.base_name)
    elif fs.get_file_info(p).type == FileType.Directory:
        fs.delete_dir(p)


def manifest(folder: str) -> list[list] | None:
    """The rows of a folder's manifest, file paths first; None without one."""
    name = f"{folder.rstrip('/')}/{MANIFEST}"
    fs, p = at(name)
    if re.search(r"[*?\[]", name) or fs.get_file_info(p).type != FileType.File:
        return None
    rows = json.loads(read(name, 0, size(name)))
    return [[f"{folder.rstrip('/')}/{row[0]}", *row[1:]] for row in rows]


def write_manifest(folder: str, rows: list[list]) -> None:
    """List a folder's parts (file names first); refuses to replace a manifest."""
    fs, p = at(f"{folder}/{MANIFEST}")
    if fs.get_file_info(p).type != FileType.NotFound:
        raise FileExistsError(f"{folder} holds parts already")
    fs.create_dir(p.rpartition("/")[0], recursive=True)
    with part(f"{folder}/{MANIFEST}") as f:
        f.write(json.dumps(rows).encode())


@contextmanager
def part(path: str):
    """A stream to write path; a failure leaves no file."""
    fs, name = at(path)
    try:
        with fs.open_output_stream(name) as f:
            yield f
    except BaseException:
        remove([path])
        raise


def remove(paths) -> None:
    for p in paths:
        fs, name = at(p)
        if fs.get_file_info(name).type == FileType.File:
            fs.delete_file(name)


def join(out, parts, step: int = 8 << 20) -> None:
    """Append the parts' bytes to an open stream."""
    for p in parts:
        fs, name = at(p)
        with fs.open_input_stream(name) as f:
            while data := f.read(step):
                out.write(data)
