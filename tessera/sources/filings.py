"""Filings as a Spark data source: one partition a company and year, retries, and a row for each failure.

    spark.dataSource.register(filing_source(MyFetcher))
    spark.read.format("filings").option("tickers", "AAPL,MSFT").option("years", "2023,2024").load()

A fetcher is an object with fetch(ticker, year) that gives a dictionary of the filing's fields, or None if there is no such filing; it is made once a
task, on the executor. What it raises is tried again with growing pauses and at last becomes a row with the reason in `error`
and nothing else but the company and year asked for, so one filing that cannot be had ends no job. As a stream the source hands out the
same companies and years in their order, some at a time, each once; a restarted stream goes on where its checkpoint is.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import DateType, IntegerType, StringType, StructType

#: The fields of a filing; what a fetcher gives beyond them is left out.
FIELDS = (
    ("ticker", StringType()), ("fiscal_year", IntegerType()), ("company_name", StringType()), ("cik", StringType()), ("filing_date", DateType()), ("accession_no", StringType()), ("sic_code", StringType()),
    ("raw_html_url", StringType()), ("html", StringType()), ("error", StringType()),
)

#: Folders over which written filings are dealt by the crc32 of `{ticker}_{year}`.
FOLDERS = 64


class Fetcher(Protocol):
    def fetch(self, ticker: str, year: int) -> dict | None: ...


@dataclass
class Asked(InputPartition):
    """A company and the year asked for; the row keeps them even if the filing is of another year."""

    ticker: str
    year: int


def _asked(options: dict) -> list[Asked]:
    """In the order of the options; companies without white space and in capitals, each pair once."""
    tickers = [t.strip().upper() for t in options.get("tickers", "").split(",") if t.strip()]
    years = [int(y) for y in options.get("years", "").split(",") if y.strip()]
    if not tickers or not years:
        raise ValueError("the source needs the options tickers and years")
    return [Asked(t, y) for t in dict.fromkeys(tickers) for y in dict.fromkeys(years)]


def _fetched(make: Callable[[], Fetcher], partition: Asked, attempts: int, pause: float) -> Iterator[tuple]:
    own: dict = {}
    error = None
    for k in range(max(1, attempts)):
        try:
            found = make().fetch(partition.ticker, partition.year)
            own, error = found or {}, None if found else "no such filing"
            day = own.get("filing_date")
            own = own | {"filing_date": date.fromisoformat(day[:10]) if isinstance(day, str) else day}
            break
        except ImportError:
            raise
        except Exception as e:
            own, error = {}, f"{type(e).__name__}: {e}"
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
    told = own | {"ticker": partition.ticker, "fiscal_year": partition.year, "error": error}
    yield tuple(told.get(name) for name, _ in FIELDS)


def filing_source(make: Callable[[], Fetcher], name: str = "filings") -> type[DataSource]:
    """A data source by that name over the fetcher that make gives. Options: tickers, years, attempts, pause (seconds), per_batch (of a
    stream)."""

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.asked, self.attempts, self.pause = _asked(options), int(options.get("attempts", 3)), float(options.get("pause", 1))

        def partitions(self) -> list[Asked]:
            return self.asked

        def read(self, partition: Asked) -> Iterator[tuple]:
            return _fetched(make, partition, self.attempts, self.pause)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, options: dict):
            self.asked, self.attempts, self.pause = _asked(options), int(options.get("attempts", 3)), float(options.get("pause", 1))
            self.per_batch, self.at = int(options.get("per_batch", 100)), 0

        def initialOffset(self) -> dict:
            return {"next": 0}

        def latestOffset(self) -> dict:
            self.at = min(len(self.asked), self.at + self.per_batch)
            return {"next": self.at}

        def partitions(self, start: dict, end: dict) -> list[Asked]:
            self.at = max(self.at, end["next"])
            return self.asked[start["next"] : end["next"]]

        def read(self, partition: Asked) -> Iterator[tuple]:
            return _fetched(make, partition, self.attempts, self.pause)

        def commit(self, end: dict) -> None:
            """Nothing is kept for what is done."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            out = StructType()
            for field, kind in FIELDS:
                out = out.add(field, kind)
            return out

        def reader(self, schema: StructType) -> Reader:
            return Reader(self.options)

        def streamReader(self, schema: StructType) -> StreamReader:
            return StreamReader(self.options)

    return Source


class FolderFetcher:
    """Filings from JSON lines in folders `of={number}`, as tables.write_filings leaves them, or in a folder `of={ticker}_{year}` each, in any
    store that Arrow reads; the year's last filing."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.store, self.path = fs.FileSystem.from_uri(folder)

    def _rows(self, of: str | int) -> Iterator[dict]:
        import json

        from pyarrow import fs

        for f in self.store.get_file_info(fs.FileSelector(f"{self.path}/of={of}", allow_not_found=True)):
            if f.base_name.endswith(".json"):
                with self.store.open_input_stream(f.path) as stream:
                    yield from (json.loads(line) for line in stream.read().split(b"\n") if line.strip())

    def fetch(self, ticker: str, year: int) -> dict | None:
        key = f"{ticker}_{year}"
        rows = [r for r in self._rows(zlib.crc32(key.encode()) % FOLDERS) if (r.get("ticker"), str(r.get("fiscal_year"))) == (ticker, str(year))]
        rows += self._rows(key)
        return max(rows, key=lambda r: (r.get("filing_date") or "", r.get("accession_no") or "")) if rows else None
