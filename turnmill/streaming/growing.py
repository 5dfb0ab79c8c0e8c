"""A streaming source of lines appended to files that grow.

Spark's own file source takes a file once.  Here the offset of a stream is how
many bytes of each file are read, so a batch holds only what was appended since,
and only whole lines: a half line waits for its rest.  A last line without a line
feed counts as whole once it is a JSON object, as no beginning of one is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SPLIT = 64 << 20  # bytes of a file that one task reads
_BLOCK = 1 << 16


@dataclass
class Stretch(InputPartition):
    """Bytes of a file: lines that begin in [at, to), of those that begin in [first, end)."""

    path: str
    first: int
    at: int
    to: int
    end: int


def _store(uri: str):
    """(file system, path in it, what stands before paths) of a path or URI."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri, "file://"
    found, path = fs.FileSystem.from_uri(uri)
    return found, path, uri[: uri.index(path)] if path in uri else ""


def files(pattern: str) -> dict[str, int]:
    """Sizes of the files that match a folder or glob; ``*`` and ``?`` stop at slashes."""
    from pyarrow import fs

    head = re.split(r"[*?\[]", pattern, maxsplit=1)[0]
    base = pattern if head == pattern else head.rsplit("/", 1)[0]
    store, root, before = _store(base)
    rest = pattern[len(base) :].strip("/")
    wanted = re.compile("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else c if c in "[]-" else re.escape(c) for c in rest) or "[^/]+")
    depth = rest.count("/") > 0
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=depth))
    within = lambda i: i.path[len(root) :].strip("/")
    return {before + i.path: i.size for i in found if i.is_file and not i.base_name.startswith((".", "_")) and wanted.fullmatch(within(i))}


def whole_bytes(path: str, size: int) -> int:
    """Bytes of a file of ``size`` bytes up to the end of its last whole line; reads back from the end."""
    store, name, _ = _store(path)
    with store.open_input_file(name) as f:
        tail, at = b"", size
        while at and b"\n" not in tail:
            step = min(_BLOCK, at)
            f.seek(at - step)
            tail, at = f.read(step) + tail, at - step
    rest = tail[tail.rfind(b"\n") + 1 :]
    try:
        whole = isinstance(json.loads(rest), dict)
    except ValueError:
        whole = False
    return size if whole else size - len(rest)


def lines_of(part: Stretch) -> Iterator[tuple[str, str, int]]:
    """(value, path, byte) of the lines that begin in a stretch."""
    store, name, _ = _store(part.path)
    with store.open_input_file(name) as f:
        at = part.at - (part.at > part.first)  # a line that begins here follows a line feed
        f.seek(at)
        skip, held, start, read = at < part.at, [], at, at
        while read < part.end:
            block = f.read(min(_BLOCK * 16, part.end - read))
            if not block:
                break
            read += len(block)
            pieces = block.split(b"\n")
            for piece in pieces[:-1]:
                held.append(piece)
                line, held = b"".join(held), []
                if not skip:
                    yield line.decode("utf-8", "replace"), part.path, start
                skip, start = False, start + len(line) + 1
                if start >= part.to:
                    return
            held.append(pieces[-1])
        rest = b"".join(held)
        if rest and not skip:
            yield rest.decode("utf-8", "replace"), part.path, start


class _Reader(DataSourceStreamReader):
    def __init__(self, pattern: str, split: int):
        self.pattern, self.split, self.known = pattern, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, size in files(self.pattern).items():
            if size and self.known.get(path, (None, 0))[0] != size:
                self.known[path] = (size, max(self.known.get(path, (0, 0))[1], whole_bytes(path, size)))
        return {path: end for path, (_, end) in sorted(self.known.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, to in end.items():
            first = start.get(path, 0)
            out += [Stretch(path, first, at, min(to, at + self.split), to) for at in range(first, to, self.split)]
        return out

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, int]]:
        return lines_of(partition)


class GrowingLines(DataSource):
    """``spark.readStream.format("growing_lines").load(folder or glob)``: value, source_path, and the line's first byte in its file.

    Option ``split``: bytes of a file that one task reads.  Files are found through
    ``pyarrow.fs`` (local, HDFS, object stores).  A file is read on from where it
    was left; one that shrinks is left alone until it has outgrown that place.  The
    offset names every file, so old files should be moved out of the folder.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string, source_path string, byte long"

    def streamReader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))
