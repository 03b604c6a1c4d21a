"""HTML calendar pages to rows, and a paged API as a streaming source."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
_ITEM = r"(?is)<li[^>]*>(.*?)</li>"
_CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
_SPAN = r"(?is)<span[^>]*>(.*?)</span>"


def page_rows(html: Column) -> Column:
    """ARRAY<ARRAY<STRING>> of cells without tags: the table layout, or the list layout where there is no table row."""
    cells = lambda p: lambda r: F.transform(F.regexp_extract_all(r, F.lit(p), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    rows = F.regexp_extract_all(html, F.lit(_ROW), F.lit(1))
    items = F.regexp_extract_all(html, F.lit(_ITEM), F.lit(1))
    return F.when(F.size(rows) > 0, F.transform(rows, cells(_CELL))).otherwise(F.transform(items, cells(_SPAN)))


def flag_country(url: Column) -> Column:
    """The file name of a flag image without its extension."""
    return F.nullif(F.regexp_extract(url, r"/([^/]+)\.(?:png|jpg|svg|gif)", 1), F.lit(""))


def stars(html: Column) -> Column:
    return F.regexp_count(html, F.lit("★|icon-star"))


class PagedSource(DataSource):
    """Pages of numbered JSON lines files as a stream; the cursor is the offset.

    Options: ``path``, a folder with files 0.json, 1.json, ... that driver and
    executors share, newest rows first as an API gives them, one file a page; and
    ``cutoff``, a time: rows before it are left out, and the first page without a
    row at or after it is the last that is asked for. Rows without a time stay. A
    web client would replace `_pages` and `read`.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _PagedReader(self.options["path"], self.options.get("cutoff", ""))


class _PagedReader(DataSourceStreamReader):
    def __init__(self, path: str, cutoff: str = "") -> None:
        self.path, self.cutoff = path, cutoff
        self.known = 0

    def _lines(self, page: int) -> Iterator[str]:
        """Rows of a page that the cutoff leaves."""
        with open(f"{self.path}/{page}.json", encoding="utf-8") as f:
            for line in map(str.strip, f):
                if line and (not self.cutoff or str(json.loads(line).get("time") or self.cutoff) >= self.cutoff):
                    yield line

    def _pages(self) -> int:
        """Pages up to the first that is missing or wholly before the cutoff; pages once seen aren't asked for again."""
        while os.path.exists(f"{self.path}/{self.known}.json") and (not self.cutoff or next(self._lines(self.known), None) is not None):
            self.known += 1
        return self.known

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"page": self._pages()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(p) for p in range(start["page"], end["page"])]

    def read(self, partition: InputPartition):  # noqa: ANN201
        for line in self._lines(partition.value):
            yield partition.value, line
