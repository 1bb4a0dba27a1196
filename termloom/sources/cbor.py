"""Pages as CBOR records: a data source that scans files in parallel, and its writer.

    spark.dataSource.register(cbor.Pages)
    spark.read.format("pages_cbor").load(path)       # files of records, or folders of them
    df.write.format("pages_cbor").mode("append").save(path)

A record is a page [id, name, metadata, sections]; metadata has lists of names by kind,
a section is [heading, id, paragraphs, sections], a paragraph [id, text, names linked].
Rows have a page's sections flattened in page order, each with its path of headings.

Records have no marks where they begin, so a file is cut only where its index says so:
the writer puts the places of some records beside each file, and a scan is planned from
these alone. A file without an index is one task, read a piece at a time. Files come to
be under their names when all tasks of a write are done.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = (
    "page_id string, name string, metadata map<string,array<string>>, "
    "sections array<struct<path:array<string>,id:string,paragraphs:array<struct<id:string,text:string,links:array<string>>>>>"
)
#: Bytes of a task, about; what is read at once; bytes between two places that an index has.
SPLIT, PIECE, STEP = 32 << 20, 1 << 20, 1 << 20


# -- the encoding ----------------------------------------------------------------


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    for code, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * size:
            return bytes([kind << 5 | code]) + n.to_bytes(size, "big")
    raise ValueError("an integer beyond 64 bits")


def encode(x) -> bytes:
    """A value of None, booleans, integers, floats, bytes, texts, lists and maps."""
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", False: b"\xf4", True: b"\xf5"}[x]
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return _head(2, len(x)) + x
    if isinstance(x, str):
        data = x.encode()
        return _head(3, len(data)) + data
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    return _head(4, len(x)) + b"".join(map(encode, x))


class Input:
    """A file from a place on, read a piece at a time."""

    def __init__(self, file, at: int):
        self.file, self.data, self.k, self.base = file, b"", 0, at
        file.seek(at)

    @property
    def place(self) -> int:
        return self.base + self.k

    def take(self, n: int) -> bytes:
        if len(self.data) - self.k < n:
            self.base += self.k
            self.data, self.k = self.data[self.k :] + self.file.read(max(n, PIECE)), 0
            if len(self.data) < n:
                raise EOFError(f"a record ends too early, at byte {self.base + len(self.data)}")
        self.k += n
        return self.data[self.k - n : self.k]

    def done(self) -> bool:
        if self.k == len(self.data):
            self.base += self.k
            self.data, self.k = self.file.read(PIECE), 0
        return not self.data


_END = object()


def decode(source: Input):
    """The next value; lengths may be given or open, tags are passed over."""
    first = source.take(1)[0]
    kind, low = first >> 5, first & 31
    n: int | None = low
    if low >= 24 and low < 28:
        raw = source.take(1 << (low - 24))
        n = int.from_bytes(raw, "big")
    elif low == 31:
        n = None
    elif low >= 28:
        raise ValueError(f"no CBOR at byte {source.place - 1}")
    if kind == 0:
        return n
    if kind == 1:
        return -1 - n
    if kind in (2, 3):
        if n is None:
            parts = list(iter(lambda: decode(source), _END))
            return (b"" if kind == 2 else "").join(parts)
        data = source.take(n)
        return data if kind == 2 else data.decode()
    if kind == 4:
        return list(iter(lambda: decode(source), _END)) if n is None else [decode(source) for _ in range(n)]
    if kind == 5:
        if n is None:
            flat = list(iter(lambda: decode(source), _END))
            return dict(zip(flat[::2], flat[1::2], strict=True))
        return {decode(source): decode(source) for _ in range(n)}
    if kind == 6:
        return decode(source)
    if low == 31:
        return _END
    if low in (25, 26, 27):
        return struct.unpack({25: ">e", 26: ">f", 27: ">d"}[low], raw)[0]
    return {20: False, 21: True}.get(low)


# -- pages -----------------------------------------------------------------------


def flattened(page: list) -> Row:
    """A record as a row."""
    page_id, name, metadata, sections = page
    out, todo = [], [([], s) for s in reversed(sections)]
    while todo:
        above, (heading, own, paragraphs, inner) = todo.pop()
        path = [*above, heading]
        out.append(Row(path=path, id=own, paragraphs=[Row(id=p[0], text=p[1], links=list(p[2])) for p in paragraphs]))
        todo += [(path, s) for s in reversed(inner)]
    return Row(page_id=page_id, name=name, metadata=metadata, sections=out)


def nested(row) -> list:
    """A row as a record: a section belongs to the last one before it whose path is its own less the last heading."""
    top: list = []
    open_: list[tuple[list, list]] = []
    for s in row["sections"] or []:
        made = [s["path"][-1] if s["path"] else "", s["id"], [[p["id"], p["text"], list(p["links"] or [])] for p in s["paragraphs"] or []], []]
        while open_ and open_[-1][0] != list(s["path"][:-1]):
            open_.pop()
        (open_[-1][1][3] if open_ else top).append(made)
        open_.append((list(s["path"]), made))
    return [row["page_id"], row["name"], {k: list(v or []) for k, v in (row["metadata"] or {}).items()}, top]


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Records of a file that begin in [start, stop)."""

    file: str
    start: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Part]:
        """Ranges of about split bytes, cut at places of the files' indexes."""
        from pyarrow import fs

        files, root = _place(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        known = {f.path for f in found}
        out = []
        for f in sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".cbor")), key=lambda f: f.path):
            places = []
            if f"{f.path}.index" in known:
                with files.open_input_stream(f"{f.path}.index") as source:
                    places = json.loads(source.read())
            start = 0
            for place in places:
                if place - start >= self.split:
                    out.append(Part(f.path, start, place))
                    start = place
            if f.size > start:
                out.append(Part(f.path, start, f.size))
        return out or [Part("", 0, 0)]

    def read(self, part: Part) -> Iterator[Row]:
        if part.file:
            files, _ = _place(self.path)
            with files.open_input_file(part.file) as file:
                source = Input(file, part.start)
                while source.place < part.stop and not source.done():
                    yield flattened(decode(source))


@dataclass
class Written(WriterCommitMessage):
    name: str


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        files, root = _place(self.path)
        files.create_dir(root, recursive=True)
        name, places, at = f"part-{uuid.uuid4().hex}.cbor", [], 0
        with files.open_output_stream(f"{root}/.{name}") as out:
            for row in rows:
                if at - (places[-1] if places else 0) >= STEP:
                    places.append(at)
                data = encode(nested(row))
                out.write(data)
                at += len(data)
        with files.open_output_stream(f"{root}/.{name}.index") as out:
            out.write(json.dumps(places).encode())
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        files, root = _place(self.path)
        if self.overwrite:
            for f in files.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith("part-"):
                    files.delete_file(f.path)
        for m in messages:
            if m is not None:
                for end in (".index", ""):  # the index first: a file is never without it
                    files.move(f"{root}/.{m.name}{end}", f"{root}/{m.name}{end}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _place(self.path)
        for m in messages:
            if m is not None:
                for end in (".index", ""):
                    files.delete_file(f"{root}/.{m.name}{end}")


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pages_cbor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)
