"""Workbooks as a Spark data source: each task writes its own areas' workbooks row by row, and none passes the driver.

    write_books(workbook_rows(passes, runs, ...), path)

A row of the table is a row of a sheet: run_id (a workbook each), sheet (its place) and title, block and ord (its place in the sheet) and
its XML, made by column expressions, in which <#> stands for its number. Rows are sorted within their task and come in Arrow batches, so a
workbook is streamed: a task holds one batch at a time, however large a sheet is. A task
writes into a folder of its own; the commit writes the manifest of the folders that count and drops those of failed or repeated attempts. With
option ``single`` the one workbook is put at ``path`` itself.

Blocks of a sheet: 0 its header, 1 its body, 2 lines below it, 3 counted names, 4 their total. Formulas may name rows by <last> (of the
body, at least 2), <top> (the first of block 3), <#> and <above>; no text holds these, as its < are escaped. A null run_id is a workbook named ``null``.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from skyloom.operators.clouds import has_cloud
from skyloom.sources import timeline
from skyloom.sources.catalogue import located
from skyloom.sources.workbook import SHEET_HEAD, SHEET_TAIL, SHEETS, cell, column, frame, row_xml, sheet_rows

LONGEST_NAME = 150
#: Rows that are compressed at once, and how hard: sheets repeat themselves, so the least effort is enough.
TOGETHER, EFFORT = 256, 1
LANES = ["Satellite", "AOI", "From (UTC)", "To (UTC)", "Off nadir (°)", "Band", "Note"]


@dataclass
class Books(WriterCommitMessage):
    """A task's folder and how many workbooks are in it."""

    place: int
    folder: str
    books: int


class _Out:
    """A stream that can only be written to: archives then need no seeking, so any file system will do."""

    def __init__(self, out):
        self.out = out

    def write(self, data: bytes) -> int:
        self.out.write(data)
        return len(data)

    def flush(self) -> None:
        self.out.flush()


def file_name(run_id: str | None) -> str:
    """A run's file; long names are cut and told apart by a digest."""
    name = quote("null" if run_id is None else run_id, safe="")
    if len(name) > LONGEST_NAME:
        name = f"{name[:LONGEST_NAME]}-{hashlib.sha256(str(run_id).encode()).hexdigest()[:16]}"
    return f"{name}.xlsx"


def write_book(out, rows: Iterator[tuple]) -> None:
    """One workbook from its rows (run_id, sheet, title, block, xml) in order."""
    titles = []
    with zipfile.ZipFile(_Out(out), "w", zipfile.ZIP_DEFLATED, compresslevel=EFFORT) as box:
        for _, own in groupby(rows, key=lambda r: r[1]):
            at, last, top, held = 0, 2, 0, []
            with box.open(f"xl/worksheets/sheet{len(titles) + 1}.xml", "w") as sheet:
                sheet.write(SHEET_HEAD.encode())
                for _, _, title, block, xml in own:
                    if not at:
                        titles.append(title)
                    at += 1
                    if block <= 1:
                        last = max(last, at)
                    elif block >= 3:
                        top = top or at
                        xml = xml.replace("<last>", str(last)).replace("<top>", str(top)).replace("<above>", str(at - 1))
                    held.append(xml.replace("<#>", str(at)))
                    if len(held) == TOGETHER:
                        sheet.write("".join(held).encode())
                        held = []
                sheet.write(("".join(held) + SHEET_TAIL).encode())
        for name, text in frame(titles).items():
            box.writestr(name, text)


class BookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.target, self.single = options["path"], options.get("single", "false").lower() == "true"
        self.folder = f"{self.target}.parts-{uuid.uuid4().hex}" if self.single else self.target

    def write(self, batches: Iterator[pa.RecordBatch]) -> Books:
        from pyspark import TaskContext

        rows = (r for batch in batches for r in zip(*[batch.column(c).to_pylist() for c in ("run_id", "sheet", "title", "block", "xml")], strict=True))
        system, folder = located(self.folder)
        place, n = TaskContext.get().partitionId(), 0
        own = f"part-{place:06d}-{os.urandom(4).hex()}"
        for run_id, book in groupby(rows, key=lambda r: r[0]):
            if not n:
                system.create_dir(f"{folder}/{own}", recursive=True)
            with system.open_output_stream(f"{folder}/{own}/{file_name(run_id)}") as out:
                write_book(out, book)
            n += 1
        return Books(place, own, n)

    def commit(self, messages: list[Books | None]) -> None:
        from pyarrow import fs

        system, folder = located(self.folder)
        parts = sorted((m for m in messages if m and m.books), key=lambda m: m.place)
        if self.single:
            if sum(m.books for m in parts) != 1:
                raise ValueError(f"a single workbook is wanted, and there are {sum(m.books for m in parts)}")
            (book,) = system.get_file_info(fs.FileSelector(f"{folder}/{parts[0].folder}"))
            system.move(book.path, located(self.target)[1])
            system.delete_dir(folder)
            return
        kept = {m.folder for m in parts}
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith("part-") and f.base_name not in kept:
                system.delete_dir(f.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/_manifest.json") as out:
            out.write(json.dumps([{"part": m.folder, "books": m.books} for m in parts]).encode())

    def abort(self, messages: list[Books | None]) -> None:
        system, folder = located(self.folder)
        for m in messages:
            if m and m.books:
                system.delete_dir(f"{folder}/{m.folder}")
        if self.single:
            system.create_dir(folder, recursive=True)
            system.delete_dir(folder)


class BookReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook_report"

    def writer(self, schema, overwrite: bool) -> BookWriter:
        return BookWriter(dict(self.options))


def _text(k: int, x: Column) -> Column:
    """Cell ``k`` of a row, as text; none for null. As ``workbook.cell`` writes it."""
    safe = x.cast("string")
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(sign), F.lit(entity))
    before, after = cell("<#>", k, "\0").split("\0")
    return F.coalesce(F.concat(F.lit(before), safe, F.lit(after)), F.lit(""))


def _number(k: int, x: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f'<c r="{column(k)}<#>"><v>'), x.cast("double").cast("string"), F.lit("</v></c>")), F.lit(""))


def _formula(text: str) -> tuple[str, str]:
    return ("=", text)


def _line(*values, bold: bool = False) -> str:
    """A row of fixed texts and formulas, whose places <last>, <top>, <#> and <above> stay as they are."""
    xml = row_xml("<#>", list(values), bold)
    for name in ("last", "top", "above", "#"):
        xml = xml.replace(f"&lt;{name}&gt;", f"<{name}>") if any(isinstance(v, tuple) for v in values) else xml
    return xml


def _row(*cells: Column) -> Column:
    return F.concat(F.lit('<row r="<#>">'), *cells, F.lit("</row>"))


def _part(sheet: int | Column, title: str | Column, block: int, order: int | Column, xml: str | Column) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(sheet).cast("int").alias("sheet"), as_column(title).alias("title"), F.lit(block).alias("block"), as_column(order).cast("long").alias("ord"), as_column(xml).alias("xml"))


def _rows(df: DataFrame, *parts: Column) -> DataFrame:
    """All parts of each row, which is read once."""
    return df.select(F.col("run_id").cast("string").alias("run_id"), F.inline(F.array(*parts)))


def workbook_rows(passes: DataFrame, runs: DataFrame, counted: DataFrame, notes: DataFrame, tz: str, hints: dict[str, str] | None = None, with_aoi: bool = False) -> DataFrame:
    """All rows of the workbooks of ``runs`` (run_id): a sheet a bucket, live counts below the passes, notes, and the timeline's bars.

    ``passes`` has a run_id. ``counted``: (run_id, ord, label), the satellites or areas to count; a label's count refers to its cell, so
    quotes in a name break no formula. ``notes``: (run_id, ord, item, value). ``hints``: a line below a bucket's rows. A run without passes has
    its headers; the sheet of satellites out of service is there only if it has rows.
    """
    bars = timeline.bars(passes)
    shown = ["satellite", "name", "left_us", "right_us", "label", "band", "hatched"]
    data = sheet_rows(bars.withColumn("__bar", F.struct(*shown)), tz, with_aoi, has_cloud(passes), keys=("run_id", "__bar"))
    names = data.columns[4:]
    kinds = dict(data.dtypes)
    numeric = lambda c: kinds[c] in ("double", "float", "int", "bigint") or kinds[c].startswith("decimal")
    body = _row(*[(_number if numeric(c) else _text)(k, F.col(f"`{c}`")) for k, c in enumerate(names)])
    buckets = list(SHEETS)
    sheet = F.array_position(F.array(*[F.lit(b) for b in buckets]), F.col("bucket")) - 1
    title = F.get(F.array(*[F.lit(t) for t in SHEETS.values()]), sheet.cast("int"))
    bar = {c: F.col(f"__bar.{c}") for c in shown}
    stamp = lambda c: F.date_format(F.timestamp_micros(bar[c]), "yyyy-MM-dd HH:mm")
    texts = [bar["satellite"], bar["name"], stamp("left_us"), stamp("right_us"), bar["label"]]
    lane = _row(*[_text(k, c) for k, c in enumerate(texts)], _number(5, bar["band"]), _text(6, F.when(bar["hatched"], "not operational")))
    parts = [_rows(data, _part(sheet, title, 1, F.col("tca_us"), body), _part(4, "Timeline", 1, F.col("tca_us"), lane))]
    fixed: dict[str, list[Column]] = {b: [] for b in buckets}
    for k, bucket in enumerate(buckets):
        fixed[bucket].append(_part(k, SHEETS[bucket], 0, 0, _line(*names, bold=True)))
        if k and hints and bucket in hints:
            fixed[bucket] += [_part(k, SHEETS[bucket], 2, n, line) for n, line in enumerate((_line(), _line(hints[bucket])))]
    below = (_line(), _line(), _line("Passes per AOI" if with_aoi else "Passes per satellite"))
    always = fixed["passes"] + fixed["marginal"] + [_part(0, SHEETS["passes"], 2, n, line) for n, line in enumerate(below)]
    always.append(_part(0, SHEETS["passes"], 4, 0, _line("Total", _formula("SUM(B<top>:B<above>)"))))
    always += [_part(3, "Method", 0, 0, _line("Item", "Value", bold=True)), _part(4, "Timeline", 0, 0, _line(*LANES, bold=True))]
    parts += [_rows(runs, *always), _rows(passes.where("bucket = 'nonoperational'").select("run_id").distinct(), *fixed["nonoperational"])]
    count = _line(None, _formula("COUNTIF(A2:A<last>,A<#>)")).removeprefix('<row r="<#>">').removesuffix("</row>")
    parts.append(_rows(counted, _part(0, SHEETS["passes"], 3, F.col("ord"), _row(_text(0, F.col("label")), F.lit(count)))))
    parts.append(_rows(notes, _part(3, "Method", 1, F.col("ord"), _row(_text(0, F.col("item")), _text(1, F.col("value"))))))
    return reduce(DataFrame.unionByName, parts)


def write_books(rows: DataFrame, path: str, single: bool = False) -> None:
    """A workbook a run in a folder of parts, or the only run's at ``path``. Ties of a time are put in order of their text."""
    rows.sparkSession.dataSource.register(BookReport)
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", "sheet", "block", "ord", "xml")
    ordered.write.format("workbook_report").option("single", str(single).lower()).mode("overwrite").save(path)
