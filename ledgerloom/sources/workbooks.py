"""Workbooks (.xlsx) as a Spark data source: cells in, cells out.

    cells.repartition("source_file").sortWithinPartitions("source_file", "sheet_no", "row", "col").write.format("workbooks").mode("append").save(folder)
    spark.read.format("workbooks").load(folder)

A workbook is a zip of XML parts. Writers stream a sheet's rows into its part as they come and keep
none; each file is written under a name of its task's and gets its own when the job commits, so a
failed or repeated task leaves nothing. Readers take a sheet for a task and pull its rows out one by
one, without reading the other sheets.

A statement of many rows is written as volumes, each a workbook of its own with rows from 1: the first
is `name.xlsx`, the others are in the folder `source_file=name`. A volume knows how many rows come
before its own, by the hidden name _rows_before; readers add them, so rows read as they were given.
"""

from __future__ import annotations

import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..operators.workbook import FIELD_WIDTHS, LEDGER, METADATA, STYLES, WIDTHS
from .files import listed, opened, source_of

CELLS = "source_file string, sheet string, row int, col int, value string"
#: A sheet's rows, by the format.
MOST_ROWS = 1 << 20
#: Rows of a volume's sheets: a task's work, whatever the size of a statement.
VOLUME_ROWS = 1 << 17
BEFORE = "_rows_before"
_BATCH = 10_000  # cells
ALIGNMENTS = ("left", "center", "right")
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_T, _ROW, _C, _V, _IS = (f"{{{_MAIN}}}{t}" for t in ("t", "row", "c", "v", "is"))
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML 1.0 has no place for; the format writes them as _xHHHH_.
_BAD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


@lru_cache(maxsize=1 << 14)
def letters(col: int) -> str:
    """A column's name, from 1: A to Z, AA and so on."""
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


@lru_cache(maxsize=1 << 14)
def number(name: str) -> int:
    n = 0
    for c in name:
        n = 26 * n + ord(c) - 64
    return n


def _text(value: str) -> str:
    return escape(_BAD.sub(lambda m: f"_x{ord(m[0]):04X}_", value) if _BAD.search(value) else value)


def _unescaped(value: str) -> str:
    return re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), value) if "_x" in value else value


def styles_part() -> str:
    """Fonts and fills of STYLES, and a cell format for each style and alignment, in order; the first of each is the default."""
    fonts = "".join(f'<font>{"<b/>" if bold else ""}<sz val="{size}"/><color rgb="FF{colour}"/><name val="Calibri"/></font>' for _, colour, bold, size in STYLES.values())
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF{fill}"/></patternFill></fill>' for fill, *_ in STYLES.values())
    formats = "".join(
        f'<xf numFmtId="0" fontId="{i}" fillId="{i + 1}" borderId="0" xfId="0" applyFont="1" applyFill="1" applyAlignment="1"><alignment horizontal="{a}" vertical="center"/></xf>' for i in range(1, len(STYLES) + 1) for a in ALIGNMENTS
    )
    none = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    return (
        f'{_HEAD}<styleSheet xmlns="{_MAIN}"><fonts count="{len(STYLES) + 1}"><font><sz val="11"/><name val="Calibri"/></font>{fonts}</fonts><fills count="{len(STYLES) + 2}">{none}{fills}</fills>'
        f'<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{3 * len(STYLES) + 1}"><xf xfId="0"/>{formats}</cellXfs></styleSheet>'
    )


_FORMATS = {(s, a): 1 + 3 * i + j for i, s in enumerate(STYLES) for j, a in enumerate(ALIGNMENTS)}


class Book:
    """One workbook while it is written: sheets one after the other, rows in order. Rows are numbered without those of earlier volumes."""

    def __init__(self, out: Any, widths: dict[str, list[float]], before: int = 0) -> None:
        self.zip, self.widths, self.before = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), widths, before
        self.sheets: list[str] = []
        self.said: list[str] = []
        self.part, self.row, self.col, self.merged = None, 0, 0, []

    def add(self, sheet: str, row: int, col: int, span: int, value: str | None, style: str | None, align: str | None) -> None:
        if not self.sheets or sheet != self.sheets[-1]:
            if sheet in self.sheets:
                raise ValueError(f"cells of {sheet!r} don't stand together")
            self._end_sheet()
            self._begin(sheet)
        row -= self.before
        if row != self.row:
            if row < self.row or row > MOST_ROWS:
                raise ValueError(f"row {row} of {sheet!r} after row {self.row}, of {MOST_ROWS} at most")
            if len(self.said) >= _BATCH:
                self._flush()
            self.said.append(f'{"</row>" if self.row else ""}<row r="{row}">')
            self.row, self.col = row, 0
        if col <= self.col:
            raise ValueError(f"cell {letters(col)}{row} of {sheet!r} twice or out of order")
        self.col = col
        at, look = f"{letters(col)}{row}", f' s="{_FORMATS[style, align]}"' if (style, align) in _FORMATS else ""
        self.said.append(f'<c r="{at}"{look}/>' if value is None else f'<c r="{at}"{look} t="inlineStr"><is><t xml:space="preserve">{_text(value)}</t></is></c>')
        if span and span > 1:
            self.merged.append(f"{at}:{letters(col + span - 1)}{row}")

    def _flush(self) -> None:
        self.part.write("".join(self.said).encode("utf-8", "replace"))
        self.said = []

    def _begin(self, sheet: str) -> None:
        self.sheets.append(sheet)
        self.part = self.zip.open(f"xl/worksheets/sheet{len(self.sheets)}.xml", "w", force_zip64=True)
        columns = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(self.widths.get(sheet, []), 1) if w)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{f"<cols>{columns}</cols>" if columns else ""}<sheetData>'.encode())
        self.row, self.col, self.merged = 0, 0, []

    def _end_sheet(self) -> None:
        if self.part is not None:
            self._flush()
            merged = "".join(f'<mergeCell ref="{m}"/>' for m in self.merged)
            self.part.write(f"{'</row>' if self.row else ''}</sheetData>{f'<mergeCells count="{len(self.merged)}">{merged}</mergeCells>' if merged else ''}</worksheet>".encode())
            self.part.close()
            self.part = None

    def close(self) -> None:
        self._end_sheet()
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(self.sheets) + 1))
        named = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(self.sheets, 1))
        related = "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(self.sheets) + 1))
        before = f'<definedNames><definedName name="{BEFORE}" hidden="1">{self.before}</definedName></definedNames>' if self.before else ""
        last = f'<Relationship Id="rId{len(self.sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/>'
        for name, body in {
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{named}</sheets>{before}</workbook>', "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{related}{last}</Relationships>',
            "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/>{parts}</Types>',
        }.items():
            self.zip.writestr(name, _HEAD + body)
        self.zip.writestr("xl/styles.xml", styles_part())
        self.zip.close()


def _listed(column: pa.Array) -> list:
    """to_pylist, several times as fast for texts and for numbers without nulls."""
    plain = pa.types.is_string(column.type) or pa.types.is_integer(column.type) and not column.null_count
    return column.to_numpy(zero_copy_only=False).tolist() if plain else column.to_pylist()


@dataclass
class Written(WriterCommitMessage):
    """(path as written, path wanted) of a task's files."""

    files: list[tuple[str, str]]


class BooksWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = options["path"], names, overwrite
        self.columns = [c for c in options.get("columns", "").split("|") if c]
        self.rows = int(options.get("rows", MOST_ROWS))
        self.job = uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        system, root = opened(self.path)
        return system, root.rstrip("/"), f"{root.rstrip('/')}/_temporary-{self.job}"

    def _cells(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(source_file, volume) and the cell."""
        place = [self.names.index(c) for c in ("source_file", "sheet", "row", "col", "span", "value", "style", "align")]
        for batch in batches:
            source, *cell = (_listed(batch.column(i)) for i in place)
            volumes = _listed(batch.column(self.names.index("_volume"))) if "_volume" in self.names else [0] * batch.num_rows
            yield from zip(zip(source, volumes, strict=True), zip(*cell, strict=True), strict=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root, temporary = self._folder()
        widths = {LEDGER: [WIDTHS.get(c) for c in self.columns], METADATA: list(FIELD_WIDTHS)}
        files: list[tuple[str, str]] = []
        known: set[tuple] = set()
        book, current = None, None
        for of, cell in self._cells(iterator):
            if book is None or of != current:
                if book is not None:
                    book.close()
                    out.close()
                if of in known:
                    raise ValueError(f"cells of {of[0]!r} don't stand together")
                known.add(of)
                source, volume = of
                name = re.sub(r"[^A-Za-z0-9_.-]+", "_", "statement" if source in (None, "") else str(source))
                system.create_dir(temporary)
                files.append((f"{temporary}/{uuid.uuid4().hex}.xlsx", f"{root}/source_file={name}/{name}-{volume + 1}.xlsx" if volume else f"{root}/{name}.xlsx"))
                out = system.open_output_stream(files[-1][0])
                book, current = Book(out, widths, volume * self.rows), of
            book.add(*cell)
        if book is not None:
            book.close()
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """All files get their names, or none does: a name that two tasks want, or that is taken, is an error."""
        system, root, temporary = self._folder()
        moves = [f for m in messages if m is not None for f in m.files]
        wanted = [w for _, w in moves]
        twice = sorted({w for w in wanted if wanted.count(w) > 1}) if len(set(wanted)) < len(wanted) else []
        taken = [] if self.overwrite else [i.path for i in (system.get_file_info(wanted) if wanted else []) if i.type != pafs.FileType.NotFound]
        if twice or taken:
            self.abort(messages)
            raise ValueError(f"workbooks of one name: {(twice or taken)[:5]}")
        for folder in {root, *(w.rsplit("/", 1)[0] for w in wanted)}:
            system.create_dir(folder)
        for written, name in moves:
            system.move(written, name)
        self._clear(system, temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, temporary = self._folder()
        self._clear(system, temporary)

    @staticmethod
    def _clear(system: pafs.FileSystem, folder: str) -> None:
        if system.get_file_info(folder).type != pafs.FileType.NotFound:
            system.delete_dir(folder)


@dataclass
class Sheet(InputPartition):
    path: str
    sheet: str
    part: str
    before: int = 0


class BooksReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Sheet]:
        """A task for each sheet; only the files' directories are read here."""
        system, _ = opened(self.options["path"])
        wanted, out = self.options.get("sheet"), []
        for path, _ in listed(self.options["path"], self.options.get("pattern", "*.xlsx")):
            with system.open_input_file(path) as file, zipfile.ZipFile(file) as z:
                targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                book = ElementTree.fromstring(z.read("xl/workbook.xml"))
                before = next((int(n.text) for n in book.iter(f"{{{_MAIN}}}definedName") if n.get("name") == BEFORE), 0)
                for s in book.iter(f"{{{_MAIN}}}sheet"):
                    target = targets[s.get(f"{{{_REL}}}id")]
                    if wanted in (None, s.get("name")):
                        out.append(Sheet(path, s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}", before))
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.options["path"])
        with system.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
            shared = list(_shared(z)) if "xl/sharedStrings.xml" in z.namelist() else []
            with z.open(partition.part) as part:
                cells = cells_of(part, shared)
                while some := list(islice(cells, _BATCH)):
                    rows, cols, values = zip(*some, strict=True)
                    given = [pa.repeat(pa.scalar(x, pa.string()), len(some)) for x in (source_of(partition.path), partition.sheet)]
                    numbers = [pa.array([r + partition.before for r in rows], pa.int32()), pa.array(cols, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*given, *numbers, pa.array(values, pa.string())], names=["source_file", "sheet", "row", "col", "value"])


def _shared(z: zipfile.ZipFile) -> Iterator[str]:
    """A workbook's shared strings: they are one table, which every sheet needs whole."""
    with z.open("xl/sharedStrings.xml") as part:
        for _, e in ElementTree.iterparse(part):
            if e.tag == f"{{{_MAIN}}}si":
                yield _said(e)
                e.clear()


def _said(e: ElementTree.Element) -> str:
    """Text of a string, its runs joined; phonetic hints are left out."""
    if len(e) == 1 and e[0].tag == _T:
        return _unescaped(e[0].text or "")
    runs = [t.text or "" for x in e for t in ([x] if x.tag == f"{{{_MAIN}}}t" else x.findall(f"{{{_MAIN}}}t") if x.tag == f"{{{_MAIN}}}r" else [])]
    return _unescaped("".join(runs))


def cells_of(part: Any, shared: list[str]) -> Iterator[tuple[int, int, str | None]]:
    """(row, column, value) of a sheet's cells as text, one at a time; a cell without a value is null."""
    row = 0
    for _, e in ElementTree.iterparse(part):
        if e.tag != _ROW:
            continue
        row, col = int(e.get("r") or row + 1), 0
        for c in e:
            if c.tag != _C:
                continue
            name = (c.get("r") or "").rstrip("0123456789")
            col = number(name) if name else col + 1
            kind, v, inline = c.get("t"), c.find(_V), c.find(_IS)
            said = None if v is None else v.text or ""
            value = _said(inline) if inline is not None else shared[int(said)] if kind == "s" and said else {"1": "TRUE", "0": "FALSE"}.get(said, said) if kind == "b" else said
            yield row, col, value
        e.clear()


class Workbooks(DataSource):
    """Reading: (source_file, sheet, row, col, value); options path, pattern, sheet. Writing: also span, style and align; option columns, the ledger's, parted by `|`, gives widths."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: Any) -> DataSourceReader:
        return BooksReader(dict(self.options))

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        return BooksWriter(dict(self.options), schema.names, overwrite)


def write_workbooks(cells: DataFrame, path: str, columns: list[str], rows: int = VOLUME_ROWS) -> None:
    """A workbook for each statement of workbook.statement_cells, or one for each `rows` rows of it; Spark's sort, not a task's memory, puts the cells in order."""
    sheet = F.when(F.col("sheet") == LEDGER, 0).when(F.col("sheet") == METADATA, 1).otherwise(2)
    placed = cells.withColumn("_no", sheet).withColumn("_volume", F.floor((F.col("row") - 1) / rows).cast("int"))
    placed = placed.repartition("source_file", "_volume").sortWithinPartitions("source_file", "_volume", "_no", "sheet", "row", "col")
    placed.write.format("workbooks").option("columns", "|".join(columns)).option("rows", rows).mode("append").save(path)
