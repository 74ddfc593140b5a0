"""Places where models and services plug in: batches in, rows out, failures as nulls."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Embedder(Protocol):
    """Vectors of sequences; made once in each task by the factory it comes from."""

    def __call__(self, seqs: list[str]) -> list[list[float] | None]: ...


class Scorer(Protocol):
    """One number for each pair of texts, null if there is none."""

    def __call__(self, a: list[str], b: list[str]) -> list[float | None]: ...


class Searcher(Protocol):
    """Ids of one page of a search."""

    def __call__(self, term: str, offset: int, limit: int) -> list[str]: ...


def embedded(rows: DataFrame, key: str, seq: str, factory, batch: int = 50, least: int = 50, most: int = 1000) -> DataFrame:
    """key, embedding of sequences of at least `least` letters, read as far as `most`; a batch that fails gives nulls."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for f in frames:
            out: list = []
            for at in range(0, len(f), batch):
                part = f["s"].iloc[at : at + batch].tolist()
                try:
                    out += model(part)
                except Exception:
                    out += [None] * len(part)
            yield pd.DataFrame({key: f[key], "embedding": out})

    kept = rows.where(F.length(seq) >= least).select(F.col(key).cast("long"), F.left(F.col(seq), F.lit(most)).alias("s"))
    return kept.mapInPandas(run, f"{key} long, embedding array<double>")


class PagedSearch(DataSource):
    """Ids of a paged search as rows (id, offset), one task per page; options term, total, page. Register a subclass with its searcher."""

    searcher: Searcher

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return "id string, offset long"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return PagedReader(type(self).searcher, o["term"], int(o["total"]), int(o.get("page", 100)))


class Page(InputPartition):
    def __init__(self, offset: int, limit: int):
        self.offset, self.limit = offset, limit


class PagedReader(DataSourceReader):
    def __init__(self, searcher: Searcher, term: str, total: int, page: int):
        self.searcher, self.term, self.total, self.page = searcher, term, total, page

    def partitions(self) -> list[InputPartition]:
        return [Page(at, min(self.page, self.total - at)) for at in range(0, self.total, self.page)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            found = self.searcher(self.term, partition.offset, partition.limit)
        except Exception:  # a page that cannot be had is empty
            found = []
        for i, x in enumerate(found):
            yield x, partition.offset + i
