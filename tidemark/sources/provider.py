"""Bars from a provider as a table: spark.read.format("provider_bars"), a partition a symbol, with filters taken to the provider.

A provider lists its symbols and downloads the bars of one between two dates. The folder provider reads landed files; others are named by
`module:Class` in the option `provider` and get the options.
"""

from __future__ import annotations

import csv
import datetime
import importlib
import io
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "symbol string, Date date, Open double, High double, Low double, Close double, Volume double"
Bar = tuple[datetime.date, float | None, float | None, float | None, float | None, float | None]


class Provider:
    """What a source of bars has to give."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def symbols(self) -> list[str]:
        raise NotImplementedError

    def download(self, symbol: str, start: datetime.date, end: datetime.date) -> Iterable[Bar]:
        """Bars from start to end, both included."""
        raise NotImplementedError


class FolderProvider(Provider):
    """Files `<symbol>.csv` (Date,Open,High,Low,Close,Volume with ISO dates) in a folder that executors can open, by its URI (option path)."""

    def _folder(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.options["path"])

    def symbols(self) -> list[str]:
        from pyarrow.fs import FileSelector

        fs, root = self._folder()
        return sorted(f.base_name[:-4] for f in fs.get_file_info(FileSelector(root)) if f.base_name.endswith(".csv"))

    def download(self, symbol: str, start: datetime.date, end: datetime.date) -> Iterator[Bar]:
        fs, root = self._folder()

        def value(text: str | None) -> float | None:
            try:
                return float(text) if text else None
            except ValueError:
                return None

        with fs.open_input_stream(f"{root}/{symbol}.csv") as raw:
            for row in csv.DictReader(io.TextIOWrapper(raw, encoding="utf-8-sig")):
                try:
                    day = datetime.date.fromisoformat((row.get("Date") or "").strip()[:10])
                except ValueError:
                    continue
                if start <= day <= end:
                    yield (day, *(value(row.get(c)) for c in ("Open", "High", "Low", "Close", "Volume")))


class OfSymbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)
        self.symbol = symbol


class ProviderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        name = options.get("provider", "folder")
        if name == "folder":
            self.provider: Provider = FolderProvider(options)
        else:
            module, kind = name.split(":")
            self.provider = getattr(importlib.import_module(module), kind)(options)
        self.only: set[str] | None = set(options["symbols"].split(",")) if options.get("symbols") else None
        self.start = datetime.date.fromisoformat(options.get("start", "0001-01-01"))
        self.end = datetime.date.fromisoformat(options.get("end", "9999-12-31"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        day = datetime.timedelta(days=1)
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("symbol",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = asked if self.only is None else self.only & asked
            elif column == ("Date",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.start = max(self.start, f.value + day if isinstance(f, GreaterThan) else f.value)
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    self.end = min(self.end, f.value - day if isinstance(f, LessThan) else f.value)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [OfSymbol(s) for s in self.provider.symbols() if self.only is None or s in self.only]

    def read(self, partition: OfSymbol) -> Iterator[tuple]:
        if self.start <= self.end:
            for bar in self.provider.download(partition.symbol, self.start, self.end):
                yield (partition.symbol, *bar)


class ProviderBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "provider_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ProviderReader:
        return ProviderReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters taken to the provider."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderBars)
