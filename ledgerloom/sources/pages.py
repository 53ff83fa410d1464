"""Statement pages as a Spark data source: a task for each bounded lot of pages, not for each file.

    spark.dataSource.register(StatementPages)
    spark.read.format("statement_pages").option("path", folder).option("readers", "package.module:Reader").load()

A reader is a class with two methods. `pages(file)` says how many pages a file has, from as little
of it as it can; `page(file, number)` yields a page's rows, numbered from 1. `file` can be read and
sought. Readers stand in order of resort, separated by commas: for each page the next is asked if
one yields nothing or fails. Errors become rows, so a bad page ends nothing but itself. If the first
reader also has `begins(file, start, end)` and `begin(file, number, at)`, as TextCells, a task starts
at its own first page.
"""

from __future__ import annotations

import importlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..shipping import ship
from .documents import CELLS, PAGES, TOKENS
from .files import listed, opened, source_of

SCHEMAS = {"cells": CELLS, "tokens": TOKENS, "pages": PAGES}
#: Pages that one task reads at most, and bytes.
LOT_PAGES, LOT_BYTES = 64, 32 << 20
SEPARATORS = {"\\": "\\\\", "\n": "\\n", "\t": "\\t", "\f": "\\f"}


class TextCells:
    """Pages of plain text: lines are rows, tabs part the cells, a form feed ends a page; a line of its own that begins with `#` numbers the table.

    Blank lines are no rows. Within cells backslash, line feed, tab and form feed are written `\\\\`, `\\n`, `\\t` and `\\f`.
    """

    def __init__(self) -> None:
        self.last: tuple[Any, int, int, bytes] = (None, 1, 0, b"")  # file, the page that comes next, the byte up to which the file is read, what is read of the page and after it

    def pages(self, file: Any) -> int:
        n, last = 1, b""
        while block := file.read(1 << 20):
            n, last = n + block.count(b"\f"), block[-1:]
        return n - (last == b"\f" and n > 1)

    def page(self, file: Any, number: int) -> Iterator[tuple]:
        table, row = 0, 0
        for line in self._page(file, number).decode("utf-8", "replace").split("\n"):
            if line.startswith("#"):
                table, row = int(line[1:]), 0
            elif line:
                yield table, row, [_plain(c) for c in line.split("\t")]
                row += 1

    def begins(self, file: Any, start: int, end: int) -> np.ndarray:
        """Bytes at which the pages begin whose form feeds lie from `start` to before `end`."""
        file.seek(start)
        return np.flatnonzero(np.frombuffer(file.read(end - start), dtype=np.uint8) == 12) + start + 1

    def begin(self, file: Any, number: int, at: int) -> None:
        """Page `number` begins at byte `at`, so none before it need be read."""
        self.last = (file, number, at, b"")

    def _page(self, file: Any, number: int) -> bytes:
        """A page's bytes; the page after the last one read is found at once."""
        known, seen, at, ahead = self.last
        if known is not file or seen > number:
            seen, at, ahead = 1, 0, b""
        kept = []
        while seen <= number:
            if not ahead:
                file.seek(at)
                ahead = file.read(1 << 16)
                at += len(ahead)
                if not ahead:
                    return b"".join(kept)
            part, ended, ahead = ahead.partition(b"\f")
            if seen == number:
                kept.append(part)
            seen += len(ended)
        self.last = (file, seen, at, ahead)
        return b"".join(kept)


_BACK = {v[1]: k for k, v in SEPARATORS.items()}


def _plain(cell: str) -> str:
    return re.sub(r"\\([\\ntf])", lambda m: _BACK[m[1]], cell) if "\\" in cell else cell


@dataclass
class Lot(InputPartition):
    """Pages of files: (path, first page, last page, byte at which the first begins, if that is known)."""

    spans: list[tuple[str, int, int, int | None]]


def lots_of(files: list[tuple[str, int, int]], most_pages: int, most_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Spans of pages of (path, size, pages), each lot within both bounds but for a single page that is larger; files in order, small ones together."""
    lots: list[list[tuple[str, int, int]]] = []
    n_pages, n_bytes = most_pages, most_bytes
    for path, size, pages in files:
        each = max(1, size // max(1, pages))
        at = 1
        while at <= pages:
            if n_pages >= most_pages or n_bytes + each > most_bytes:
                lots.append([])
                n_pages, n_bytes = 0, 0
            take = min(pages - at + 1, most_pages - n_pages, max(1, (most_bytes - n_bytes) // each))
            lots[-1].append((path, at, at + take - 1))
            at, n_pages, n_bytes = at + take, n_pages + take, n_bytes + take * each
    return lots


def spans_of(parts: Iterable[tuple[str, int, list[int], int]], step: int) -> list[tuple[str, int, int, int, int]]:
    """(path, first page, last page, byte of the first, bytes), `step` pages at most, from (path, pages that begin in a part of it, bytes of every `step`-th of them, end of the part), parts in order."""
    out, current, before = [], None, 0
    for path, n, marks, end in parts:
        before = before if path == current else 0
        out += [(path, before + i * step + 1, before + min(n, (i + 1) * step), at, max(upto - at, 0)) for i, (at, upto) in enumerate(zip(marks, [*marks[1:], end], strict=False))]
        current, before = path, before + n
    return out


def spans_together(spans: Iterable[tuple[str, int, int, int, int]], most_pages: int, most_bytes: int) -> list[list[tuple[str, int, int, int]]]:
    """Lots of spans in order, small ones together, within both bounds but for a single span that is larger."""
    lots: list[list[tuple[str, int, int, int]]] = []
    n_pages, n_bytes = most_pages, most_bytes
    for path, first, last, at, size in spans:
        if n_pages + last - first + 1 > most_pages or n_bytes + size > most_bytes:
            lots.append([])
            n_pages, n_bytes = 0, 0
        lots[-1].append((path, first, last, at))
        n_pages, n_bytes = n_pages + last - first + 1, n_bytes + size
    return lots


def parts_of(files: list[tuple[str, int]], most_bytes: int) -> list[tuple[str, int, int, int]]:
    """(path, size, first byte, byte after the last) of parts of files."""
    return [(path, size, at, min(at + most_bytes, size)) for path, size in files for at in range(0, max(size, 1), most_bytes)]


def pages_begun(reader: Any, folder: str, part: tuple[str, int, int, int], step: int) -> tuple[str, int, list[int], int]:
    """(path, pages that begin in a part of it, bytes of every `step`-th of them, the part's end): a file's first page is in its first part, others where their separator is; none follows a last separator."""
    path, size, start, end = part
    system, _ = opened(folder)
    try:
        with system.open_input_file(path) as file:
            at = reader.begins(file, start, end)
    except Exception:  # noqa: BLE001  the task that reads it says why
        at = np.array([], dtype=np.int64)
    at = np.concatenate([[0] if start == 0 else [], at[at < size]]).astype(np.int64)
    return path, len(at), at[::step].tolist(), end


def find_pages(spark: SparkSession, folder: str, pattern: str = "*", pages_a_task: int = LOT_PAGES, bytes_a_task: int = LOT_BYTES, reader: type = TextCells) -> str:
    """Option `spans` of the source: where the pages of a folder begin, found by a task for each part of a file, not by the driver. `reader` has `begins`."""
    ship(spark)
    parts = parts_of(listed(folder, pattern), bytes_a_task)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [pages_begun(reader(), folder, parts[i], pages_a_task) for i in pdf["id"]]
            yield pd.DataFrame({"id": pdf["id"], "n": [n for _, n, *_ in found], "marks": [marks for *_, marks, _ in found]})

    rows = spark.range(0, len(parts), 1, max(1, len(parts))).mapInPandas(run, "id long, n long, marks array<long>").collect()  # one for each lot
    return json.dumps(spans_of([(parts[r["id"]][0], r["n"], r["marks"], parts[r["id"]][3]) for r in sorted(rows, key=lambda r: r["id"])], pages_a_task))


class StatementPages(DataSource):
    """Options: path, pattern (*), kind (cells, tokens or pages), readers, pages_a_task, bytes_a_task, spans (as find_pages gives them).

    Rows are those of the kind (source_file and page_num are put in front of what a reader yields) with `error`, null where a
    reader gave rows. A page that no reader could read gives one row of nulls with the errors; one without rows or errors gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "statement_pages"

    def schema(self) -> str:
        return f"{SCHEMAS[self.options.get('kind', 'cells')]}, error string"

    def reader(self, schema: Any) -> DataSourceReader:
        return PagesReader(dict(self.options), len(schema))


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], width: int) -> None:
        self.options, self.width = options, width

    def _readers(self) -> list[Any]:
        named = self.options.get("readers", f"{__name__}:TextCells")
        return [getattr(importlib.import_module(m), c)() for m, c in (r.strip().split(":") for r in named.split(","))]

    def partitions(self) -> list[Lot]:
        """Without `spans` files are listed and their pages counted here; a file that can't be counted is one page, whose error the task tells."""
        bound = lambda name, default: int(self.options.get(name, default))
        most_pages, most_bytes = bound("pages_a_task", LOT_PAGES), bound("bytes_a_task", LOT_BYTES)
        if "spans" in self.options:
            return [Lot(spans) for spans in spans_together(json.loads(self.options["spans"]), most_pages, most_bytes)]
        readers, files = self._readers(), listed(self.options["path"], self.options.get("pattern", "*"))
        if hasattr(readers[0], "begins"):
            begun = (pages_begun(readers[0], self.options["path"], part, most_pages) for part in parts_of(files, most_bytes))
            return [Lot(spans) for spans in spans_together(spans_of(begun, most_pages), most_pages, most_bytes)]
        counted = [(path, size, self._count(readers, path)) for path, size in files]
        return [Lot([(*span, None) for span in spans]) for spans in lots_of(counted, most_pages, most_bytes)]

    def _count(self, readers: list[Any], path: str) -> int:
        system, _ = opened(self.options["path"])
        for reader in readers:
            try:
                with system.open_input_file(path) as file:
                    return max(1, reader.pages(file))
            except Exception:  # noqa: BLE001  the next reader may know it; else the task says why
                continue
        return 1

    def read(self, partition: Lot) -> Iterator[tuple]:
        readers = self._readers()
        system, _ = opened(self.options["path"])
        for path, first, last, at in partition.spans:
            with system.open_input_file(path) as file:
                for reader in readers if at is not None else []:
                    if getattr(type(reader), "begins", None) is type(readers[0]).begins:  # it parts pages alike
                        reader.begin(file, first, at)
                for number in range(first, last + 1):
                    yield from self._rows(readers, file, source_of(path), number)

    def _rows(self, readers: list[Any], file: Any, source: str, number: int) -> Iterator[tuple]:
        errors = []
        for reader in readers:
            try:
                rows = list(reader.page(file, number))  # a page's
            except Exception as e:  # noqa: BLE001
                errors.append(f"{type(e).__name__}: {e}")
                continue
            if rows:
                yield from ((source, number, *r, None) for r in rows)
                return
        if errors:
            yield (source, number, *[None] * (self.width - 3), "; ".join(errors))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session and importable by its workers."""
    from .workbooks import Workbooks

    ship(spark)
    for source in (StatementPages, Workbooks):
        spark.dataSource.register(source)
