"""Lines of text as files with a head and a tail, written in two phases: nothing is seen before every task is done, and a failed job leaves nothing."""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: What one sitemap, and one index of sitemaps, may hold.
SITEMAP_LINES, SITEMAP_BYTES = 50_000, 50 << 20
SITEMAP_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
INDEX_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'
BOM = "\ufeff"


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, in their order: (name, lines)."""

    partition: int
    files: list[tuple[str, int]] = field(default_factory=list)


class LineFiles(DataSource):
    """The target of `write_lines`. Options: path, prefix, suffix, head, tail, newline, lines, bytes (limits of a file, head and tail included), index (the address under which the files will be found)."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LineWriter(dict(self.options), overwrite)


class LineWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.prefix, self.suffix, self.index = options.get("prefix", "part-"), options.get("suffix", ".txt"), options.get("index", "")
        self.newline, self.head, self.tail = options.get("newline", "\n"), options.get("head", ""), options.get("tail", "")
        self.lines, self.bytes = int(options.get("lines", 1 << 62)), int(options.get("bytes", 1 << 62))
        self.pending = f"_pending-{uuid.uuid4().hex}"
        system, base = self._system()
        if not overwrite and self._own(system, base):
            raise FileExistsError(f"{self.path} holds files {self.prefix}*{self.suffix} already")

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def _own(self, system, base: str) -> list[str]:
        """Files of earlier exports of this kind."""
        from pyarrow import fs

        names = [i.base_name for i in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.is_file]
        return [n for n in names if n == "_SUCCESS" or n.endswith(self.suffix) and n.startswith(self.prefix) or self.index and n.startswith("sitemap_index") and n.endswith(".xml")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, base = self._system()
        system.create_dir(f"{base}/{self.pending}", recursive=True)
        done = Written(TaskContext.get().partitionId())
        newline = self.newline.encode()
        head = (self.head + self.newline if self.head else "").encode()
        tail = (self.tail + self.newline if self.tail else "").encode()
        out, name, count, size = None, "", 0, 0

        def close() -> None:
            out.write(tail)
            out.close()
            done.files.append((name, count))

        for batch in iterator:
            for value in batch.column(0).to_pylist():
                line = (value or "").encode() + newline
                if out is not None and (count >= self.lines or size + len(line) + len(tail) > self.bytes):
                    close()
                    out = None
                if out is None:  # a name of its own: attempts of one task never meet
                    name, count, size = uuid.uuid4().hex, 0, len(head)
                    stream = system.open_output_stream(f"{base}/{self.pending}/{name}", compression=None)
                    out = _Gzip(stream) if self.suffix.endswith(".gz") else stream
                    out.write(head)
                out.write(line)
                count, size = count + 1, size + len(line)
        if out is not None:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        system, base = self._system()
        system.create_dir(base, recursive=True)
        for name in self._own(system, base) if self.overwrite else ():
            system.delete_file(f"{base}/{name}")
        names = []
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for pending, _ in message.files:
                names.append(f"{self.prefix}{len(names) + 1:05d}{self.suffix}")
                system.move(f"{base}/{self.pending}/{pending}", f"{base}/{names[-1]}")
        if self.index:
            for k in range(0, len(names), SITEMAP_LINES):
                entries = "".join(f"<sitemap><loc>{self.index.rstrip('/')}/{n}</loc></sitemap>\n" for n in names[k : k + SITEMAP_LINES])
                self._put(system, f"{base}/sitemap_index{'' if k == 0 else f'-{k // SITEMAP_LINES + 1:05d}'}.xml", f"{INDEX_HEAD}\n{entries}</sitemapindex>\n")
        self._clear(system, base)
        self._put(system, f"{base}/_SUCCESS", "")

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._system())

    def _clear(self, system, base: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{base}/{self.pending}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/{self.pending}")

    def _put(self, system, path: str, content: str) -> None:
        with system.open_output_stream(path, compression=None) as out:
            out.write(content.encode())


class _Gzip:
    """A compressed stream that closes the one below it."""

    def __init__(self, below) -> None:
        self.below, self.packer = below, gzip.GzipFile(fileobj=below, mode="wb", mtime=0)

    def write(self, data: bytes) -> None:
        self.packer.write(data)

    def close(self) -> None:
        self.packer.close()
        self.below.close()


def write_lines(texts: DataFrame, path: str, mode: str = "error", **options: object) -> None:
    """The one column of texts, in the order of its partitions, as files prefix00001suffix and so on under path (options: LineFiles).

    mode: error (files of that kind must not be there) or overwrite (they are replaced when all is written). Nulls are empty lines; no rows give no file but _SUCCESS.
    """
    texts.sparkSession.dataSource.register(LineFiles)
    given = {k: str(v) for k, v in options.items() if v is not None}
    texts.write.format(LineFiles.name()).options(path=path, **given).mode("overwrite" if mode == "overwrite" else "append").save()


def write_csv(rows: DataFrame, path: str, order: list[str | Column], columns: list[str] | None = None, names: list[str] | None = None, mode: str = "error", lines: int | None = None) -> None:
    """Columns of rows (all, if none are named) as CSV for spreadsheets: byte order mark, header line of names, CRLF, quotes where needed, in an order; every file of at most `lines` rows has its own header."""
    from ..operators.generators import csv_lines

    columns = columns or rows.columns
    quoted = ['"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\r\n') else n for n in names or columns]
    _write_sorted(csv_lines(rows, False, columns, order), path, mode, suffix=".csv", newline="\r\n", head=BOM + ",".join(quoted), lines=lines)


def write_tsv(rows: DataFrame, path: str, order: list[str | Column], columns: list[str] | None = None, names: list[str] | None = None, mode: str = "error", lines: int | None = None) -> None:
    """Columns of rows as lines of cells with tabs between, in an order, with a header in every file."""
    from ..operators.generators import tsv_lines

    columns = columns or rows.columns
    _write_sorted(tsv_lines(rows, columns, order), path, mode, suffix=".tsv", head="\t".join(names or columns), lines=lines)


def _write_sorted(texts: DataFrame, path: str, mode: str, **options: object) -> None:
    order = texts.columns[1:]
    write_lines(texts.repartitionByRange(*order).sortWithinPartitions(*order).select("line"), path, mode, **options)
