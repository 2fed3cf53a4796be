"""Report documents as a Spark data source: each task writes its own documents, and the commit puts the report in place.

    spark.dataSource.register(JsonReport)
    documents.write.format("json_report").mode("overwrite").save(path)

The table has run_id and json. A task writes a part with a document a line; a part counts only once its message is committed, so tasks may fail
or run twice. The report is one contract document at ``path`` (copied from the parts piece by piece, so the driver holds none of it whole), or, with
option ``parts``, a folder of the parts and a manifest of their sizes. Documents are in the table's order: sort it by ranges.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from skyloom.sources.catalogue import located
from skyloom.sources.contract import root

PIECE = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """A part: its place among the tasks, its file, and how many documents it has."""

    place: int
    file: str
    documents: int


class ReportWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.target, self.whole = options["path"], options.get("parts", "false").lower() != "true"
        self.folder = f"{self.target}.parts-{uuid.uuid4().hex}" if self.whole else self.target

    def write(self, rows: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        system, folder = located(self.folder)
        system.create_dir(folder, recursive=True)
        place = TaskContext.get().partitionId()
        file, n = f"{folder}/part-{place:06d}-{os.urandom(4).hex()}.json", 0
        with system.open_output_stream(file) as out:
            for row in rows:
                out.write(row["json"].encode() + b"\n")
                n += 1
        return Part(place, file, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.documents), key=lambda m: m.place)
        system, folder = located(self.folder)
        if not self.whole:
            from pyarrow import fs

            kept = {m.file for m in parts}
            for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if f.base_name.startswith("part-") and f.path not in kept:
                    system.delete_file(f.path)
            with system.open_output_stream(f"{folder}/_manifest.json") as out:
                out.write(json.dumps([{"part": m.file.rpartition("/")[2], "documents": m.documents} for m in parts]).encode())
            return
        target = located(self.target)[1]
        before, _, after = root(["{}", "{}"]).partition("{},{}")
        single = sum(m.documents for m in parts) == 1
        with system.open_output_stream(f"{folder}/report") as out:
            out.write((root(["{"]) if single else before).encode())
            # A line break becomes a comma once something follows it; a single document's brace is in the head already.
            held, skip = b"", int(single)
            for m in parts:
                with system.open_input_stream(m.file) as text:
                    while piece := text.read(PIECE):
                        piece = held + piece[skip:]
                        piece, held, skip = (piece[:-1], b"\n", 0) if piece.endswith(b"\n") else (piece, b"", 0)
                        out.write(piece.replace(b"\n", b","))
            out.write(b"" if single else after.encode())
        system.move(f"{folder}/report", target)
        system.delete_dir(folder)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = located(self.folder)
        for m in messages:
            if m:
                system.delete_file(m.file)
        if self.whole:
            system.create_dir(folder, recursive=True)
            system.delete_dir(folder)


class JsonReport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_report"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(dict(self.options))


def write_report(documents: DataFrame, path: str, parts: bool = False) -> None:
    """Documents of (run_id, json), in order of run_id, as one report, or as a folder of parts."""
    documents.sparkSession.dataSource.register(JsonReport)
    ordered = documents.select("run_id", "json").repartitionByRange("run_id").sortWithinPartitions("run_id")
    ordered.write.format("json_report").option("parts", str(parts).lower()).mode("overwrite").save(path)
