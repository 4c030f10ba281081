"""Filings as a data source: partitions, retries, failures as rows, streams."""

import os
from datetime import date

import pytest

from tessera.plans import registry
from tessera.sources import tables
from tessera.sources.filings import FOLDERS, FolderFetcher, filing_source


class Flaky:
    """Fails for one company, fails at first for another, knows nothing of a third."""

    def __init__(self, folder):
        self.folder = folder

    def fetch(self, ticker, year):
        if ticker == "DOWN":
            raise RuntimeError("no answer")
        if ticker == "NONE":
            return None
        seen = f"{self.folder}/{ticker}-{year}"
        if ticker == "SLOW" and not os.path.exists(seen):
            open(seen, "w").close()
            raise TimeoutError("try again")
        return {"ticker": "other", "fiscal_year": 1999, "company_name": f"{ticker} Inc", "filing_date": "2024-11-01T00:00:00", "unknown": 1}


def test_one_partition_a_company_and_year(spark, tmp_path):
    folder = str(tmp_path)
    spark.dataSource.register(filing_source(lambda: Flaky(folder)))
    df = spark.read.format("filings").option("tickers", " aapl,SLOW,DOWN,NONE,AAPL ").option("years", "2023, 2024").option("pause", "0").load()
    assert df.rdd.getNumPartitions() == 8
    got = {(r.ticker, r.fiscal_year): (r.company_name, r.filing_date, r.error) for r in df.collect()}
    assert len(got) == 8 and got["AAPL", 2023] == ("AAPL Inc", date(2024, 11, 1), None) and got["SLOW", 2024][2] is None
    assert got["DOWN", 2023] == (None, None, "RuntimeError: no answer") and got["NONE", 2024][2] == "no such filing"
    once = spark.read.format("filings").option("tickers", "LATE,DOWN").option("years", "2023").option("attempts", "1").load()
    assert sorted((r.ticker, r.error is None) for r in once.collect()) == [("DOWN", False), ("LATE", True)]
    with pytest.raises(Exception, match="tickers and years"):
        spark.read.format("filings").option("tickers", "A").load().collect()


def test_from_a_folder_of_filings(spark, tmp_path):
    rows = [("AAPL", 2023, "2023-11-01", "1"), ("AAPL", 2023, "2023-12-01", "2"), ("MSFT", 2024, "2024-07-30", "3")]
    tables.write_filings(spark.createDataFrame(rows, "ticker string, fiscal_year int, filing_date string, accession_no string"), f"{tmp_path}/f")
    at = f"file://{tmp_path}/f"
    spark.dataSource.register(filing_source(lambda: FolderFetcher(at), "folder"))
    df = spark.read.format("folder").option("tickers", "AAPL,MSFT").option("years", "2023,2024").load()
    assert sorted((r.ticker, r.fiscal_year, r.accession_no, r.error) for r in df.collect()) == [("AAPL", 2023, "2", None), ("AAPL", 2024, None, "no such filing"), ("MSFT", 2023, None, "no such filing"), ("MSFT", 2024, "3", None)]


def test_written_filings_grow_in_files_not_in_number(spark, tmp_path):
    """a folder and file a company and year took seconds for each, and of several filings in one file all but the first were lost."""
    rows = [(f"T{k % 300}", 2023, f"Co\u2028{k}", f"2024-01-{1 + k // 300:02}", str(k)) for k in range(900)]
    tables.write_filings(spark.createDataFrame(rows, "ticker string, fiscal_year int, company_name string, filing_date string, accession_no string").repartition(4), f"{tmp_path}/f")
    assert sum(x.endswith(".json") for _, _, names in os.walk(f"{tmp_path}/f") for x in names) <= FOLDERS
    own = FolderFetcher(f"file://{tmp_path}/f")
    assert [(r["company_name"], r["accession_no"]) for r in (own.fetch(f"T{k}", 2023) for k in (0, 7, 299))] == [(f"Co\u2028{k}", str(k)) for k in (600, 607, 899)]
    assert own.fetch("T7", 2024) is None and own.fetch("T300", 2023) is None
    back = tables.read_filings(spark, f"{tmp_path}/f/*", lines=True)
    assert sorted((r.ticker, r.fiscal_year, r.company_name, str(r.filing_date), r.accession_no) for r in back.collect()) == sorted(rows)
    assert tables.broken_filings(spark, f"{tmp_path}/f/*", lines=True).count() == 0


def test_several_filings_of_a_company_and_year(spark, tmp_path):
    spark.createDataFrame([(k, "Supplier", 3) for k in range(5)], "s_suppkey long, s_name string, s_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    assert sorted(r.cik for r in registry.QUERIES["filings_json"](spark, str(tmp_path)).collect()) == [f"{k:010}" for k in range(5)]


def test_from_a_folder_a_company_and_year(spark, tmp_path):
    (tmp_path / "of=AAPL_2023").mkdir()
    (tmp_path / "of=AAPL_2023" / "a.json").write_text('{"accession_no": "1"}\n')
    assert FolderFetcher(f"file://{tmp_path}").fetch("AAPL", 2023) == {"accession_no": "1"}


def test_as_a_stream_each_once_and_on_from_the_checkpoint(spark, tmp_path):
    folder = str(tmp_path)
    spark.dataSource.register(filing_source(lambda: Flaky(folder), "stream_of_filings"))
    out, checkpoint = f"{tmp_path}/out", f"{tmp_path}/checkpoint"

    def run(years):
        df = spark.readStream.format("stream_of_filings").option("tickers", "A,DOWN,C").option("years", years).option("per_batch", "2").option("pause", "0").load()
        query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()
        return sorted((r.ticker, r.fiscal_year, r.error is None) for r in spark.read.parquet(out).collect())

    assert run("2023") == [("A", 2023, True), ("C", 2023, True), ("DOWN", 2023, False)]
    assert run("2023") == [("A", 2023, True), ("C", 2023, True), ("DOWN", 2023, False)]
