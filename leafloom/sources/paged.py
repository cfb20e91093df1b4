"""A data source for services that give rows in pages of JSON.

``spark.read.format("paged_json").schema(...).option("url", "https://host/rows?page={page}&size={size}")``
reads pages 1, 2, ... of ``size`` rows, one partition each, up to ``most`` rows in all. The
number of rows is asked of the first page (``total_key``) when the read is planned; every page
is fetched where its partition runs, so a lost executor's pages are fetched again. A failing
page is tried again with growing pauses until ``deadline`` seconds have gone.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SIZE, MOST = 500, 10_000


def fetched(url: str, deadline: float, pause: float = 3.0, longest: float = 30.0) -> dict:
    end = time.monotonic() + deadline
    while True:
        try:
            with urllib.request.urlopen(url, timeout=30) as answer:
                return json.load(answer)
        except OSError:
            if time.monotonic() + pause > end:
                raise
            time.sleep(pause)
            pause = min(longest, pause * 2)


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, self.options)


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.fields, self.options = schema.fieldNames(), dict(options)
        self.size, self.most = int(options.get("size", SIZE)), int(options.get("most", MOST))

    def _page(self, n: int) -> dict:
        url = self.options["url"].replace("{page}", str(n)).replace("{size}", str(self.size))
        return fetched(url, float(self.options.get("deadline", 0)))

    def partitions(self) -> list[InputPartition]:
        total = min(self.most, int(self._page(1).get(self.options.get("total_key", "total"), 0)))
        return [InputPartition(n) for n in range(1, max(1, -(-total // self.size)) + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        left = self.most - (partition.value - 1) * self.size
        for row in self._page(partition.value).get(self.options.get("rows_key", "rows"), [])[: max(0, left)]:
            yield tuple(row.get(f) for f in self.fields)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
