"""Large JSON documents and logs as data sources: ranges of bytes are partitions, so that no document is one row.

    spark.dataSource.register(ResultMap)                      # or documents.register(spark)
    spark.read.format("result_map").load(path).filter("status = 'pass'")

``result_map``     seq, status, module of {"completed": {"<seq>": {...}, ...}}
``manifest``       seq, problem_id, filename of [{...}, ...]
``proof_attempts`` theorem, temperature, attempt, proof of {"<theorem>": {"<temperature>": [...]}}
``run_log``        at (byte offset of the line), line, without colour codes

Options: path (a file, a folder or a pattern), bytes (of a partition, 16 MB by default). Paths are opened through pyarrow, so
a folder that the executors share or a store that pyarrow knows will do. Comparisons of a column with values are taken over by the reader: rows that don't
pass are never handed to Spark. A range begins at the first entry that starts in it and ends with the last; a quote within a
JSON string is escaped, so an entry's key can be told at any place. ``proof_attempts`` has nested entries and is
parsed theorem by theorem, a document a partition. A document that is cut off or malformed is an error.
"""
from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringStartsWith
from pyspark.sql.types import IntegerType, LongType, StructType

#: the colour codes of terminals (a fixed value)
_COLOUR = re.compile(r"\x1b\[[0-9;]*m")
_BLOCK = 1 << 16


def _open(path: str):
    from pyarrow import fs

    where, name = (fs.FileSystem.from_uri(path) if re.match("[a-z0-9]+:", path) else (fs.LocalFileSystem(), path))
    return where, name


def _files(path: str) -> list[tuple[str, int]]:
    """Files and their sizes: the path itself, what a folder holds, or what a pattern with * matches in its folder."""
    from pyarrow import fs

    scheme = re.match("[a-z0-9]+:(//)?(?=/)", path)
    pattern = path.rpartition("/")[2] if "*" in path else None
    where, name = _open(path.rpartition("/")[0] if pattern else path)
    info = where.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(name))
    wanted = re.compile(".*".join(map(re.escape, pattern.split("*"))) if pattern else ".*")
    rows = [(f.path, f.size) for f in found if f.type == fs.FileType.File and wanted.fullmatch(f.base_name) and not f.base_name.startswith(("_", "."))]
    prefix = scheme[0] if scheme and scheme[0] != "file:" else ""
    return sorted((p if not prefix or p.startswith("/") else prefix + p, n) for p, n in rows)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _passes(filters: list[Filter]):
    """A test of rows (dicts) for the filters taken over; null never passes a comparison."""
    compare = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b,
               In: lambda a, b: a in b, StringContains: lambda a, b: b in a, StringStartsWith: lambda a, b: a.startswith(b)}

    def test(row: dict) -> bool:
        for f in filters:
            value = row[f.attribute[0]]
            if isinstance(f, IsNotNull):
                ok = value is not None
            elif isinstance(f, EqualNullSafe):
                ok = value == f.value
            else:
                ok = value is not None and f.value is not None and compare[type(f)](value, f.value)
            if not ok:
                return False
        return True

    return test, (*compare, IsNotNull, EqualNullSafe)


class _Reader(DataSourceReader):
    """Reads the entries that begin within a range."""

    split = True
    #: an entry's beginning: group 1 is what tells it, the match's end where its value begins
    entry: re.Pattern

    def __init__(self, schema: StructType, options: dict):
        if "path" not in options:
            raise ValueError("give a path")
        self.schema, self.path, self.size, self.filters = schema, options["path"], int(options.get("bytes", 16_000_000)), []

    def pushFilters(self, filters: list[Filter]):
        known = _passes([])[1]
        names = set(self.schema.fieldNames())
        for f in filters:
            if isinstance(f, known) and len(getattr(f, "attribute", ())) == 1 and f.attribute[0] in names:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        out = []
        for path, size in _files(self.path):
            step = max(1, self.size) if self.split else max(1, size)
            out += [Range(path, a, min(size, a + step)) for a in range(0, size, step)]
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        test, _ = _passes(self.filters)
        names = self.schema.fieldNames()
        for row in self.rows(part) if part.path else ():
            if test(row):
                yield tuple(row[c] for c in names)

    def rows(self, part: Range) -> Iterator[dict]:
        where, name = _open(part.path)
        with where.open_input_file(name) as f:
            # a byte more on either side: an escape before the range's first byte, a match that begins in it
            begin = max(0, part.start - 1)
            f.seek(begin)
            data = f.read(part.end - begin + _BLOCK)
            decoder, at = json.JSONDecoder(strict=False), 0
            while (m := self.entry.search(data, at)) is not None:
                place, at = begin + m.start(), m.end()
                if place >= part.end:
                    return
                if place < part.start or m.start() and data[m.start() - 1 : m.start()] == b"\\":
                    continue
                while True:
                    try:
                        value, used = _value(decoder, data, self.opens(m))
                        break
                    except ValueError:
                        more = f.read(_BLOCK)
                        if not more:
                            raise ValueError(f"{part.path}: an entry at byte {place} has no end") from None
                        data += more
                at = used
                yield self.made(m, value)
                if at > 4_000_000:  # what is behind isn't needed any more
                    data, begin, at = data[at - 1 :], begin + at - 1, 1
                if begin + len(data) < part.end + _BLOCK:
                    data += f.read(_BLOCK)

    def opens(self, m: re.Match) -> int:
        return m.end() - 1


def _value(decoder: json.JSONDecoder, data: bytes, at: int):
    """The JSON value at a byte offset, and the offset behind it; ValueError if it isn't whole yet."""
    size = 4096
    while True:
        text = data[at : at + size]
        try:
            value, used = decoder.raw_decode(text.decode("utf-8", "ignore"))
            return value, at + len(text.decode("utf-8", "ignore")[:used].encode())
        except ValueError:
            if at + size >= len(data):
                raise
            size *= 4


class _ResultReader(_Reader):
    entry = re.compile(rb'"(-?[0-9]+)"\s*:\s*\{')

    def made(self, m, value):
        return {"seq": m[1].decode(), "status": value.get("status"), "module": value.get("module")}


class _ManifestReader(_Reader):
    entry = re.compile(rb'\{\s*"(?:seq|problem_id|filename)"\s*:')

    def opens(self, m):
        return m.start()

    def made(self, m, value):
        return {"seq": value.get("seq"), "problem_id": value.get("problem_id"), "filename": value.get("filename")}


class _AttemptReader(_Reader):
    split = False

    def rows(self, part):
        where, name = _open(part.path)
        with where.open_input_file(name) as f:
            data = f.read()
        decoder, at = json.JSONDecoder(strict=False), 0
        text = data.decode()
        del data
        blank = re.compile(r"[\s,]*")
        at = blank.match(text).end()
        if text[at : at + 1] != "{":
            raise ValueError(f"{part.path}: not an object")
        at = blank.match(text, at + 1).end()
        while text[at : at + 1] != "}":
            theorem, at = decoder.raw_decode(text, at)
            by, at = decoder.raw_decode(text, re.compile(r"\s*:\s*").match(text, at).end())
            at = blank.match(text, at).end()
            for temperature, proofs in by.items():
                for k, proof in enumerate(proofs):
                    yield {"theorem": theorem, "temperature": temperature, "attempt": k, "proof": proof}


class _LogReader(_Reader):
    def rows(self, part):
        where, name = _open(part.path)
        with where.open_input_file(name) as f:
            begin = max(0, part.start - 1)
            f.seek(begin)
            held, at, first = b"", begin, part.start > 0
            while at < part.end or held:
                more = f.read(_BLOCK)
                held += more
                lines = held.split(b"\n")
                held = lines.pop() if more else b""
                for line in lines:
                    if first:  # the line that the range before ends with
                        first = False
                    elif at >= part.end:
                        return
                    elif line or more or at < part.end - len(line):
                        yield {"at": at, "line": _COLOUR.sub("", line.decode("utf-8", "replace").removesuffix("\r"))}
                    at += len(line) + 1
                if not more:
                    return


def _source(format_name: str, ddl: str, reader: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return ddl

        def reader(self, schema: StructType) -> DataSourceReader:
            return reader(schema, {k.lower(): v for k, v in self.options.items()})

    Source.__name__ = Source.__qualname__ = reader.__name__.strip("_").replace("Reader", "Source")
    return Source


ResultMap = _source("result_map", "seq string, status string, module string", _ResultReader)
Manifest = _source("manifest", "seq long, problem_id string, filename string", _ManifestReader)
ProofAttempts = _source("proof_attempts", "theorem string, temperature string, attempt int, proof string", _AttemptReader)
RunLog = _source("run_log", "at long, line string", _LogReader)


def register(spark: SparkSession) -> None:
    """Make the formats known, and let their filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ResultMap, Manifest, ProofAttempts, RunLog):
        spark.dataSource.register(source)
