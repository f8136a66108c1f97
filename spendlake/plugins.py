"""Extension points: connectors as data sources, exporters and detectors as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition,
    LessThan, LessThanOrEqual, WriterCommitMessage,
)

from spendlake import schema


# ── Connectors ────────────────────────────────────────────────────────────

class Connector:
    """A source of billing rows. ``fetch`` yields Arrow batches of one slice: [start, end) and one account.

    The object is sent to the executors, so it may hold settings but no open connection.
    """

    def slices(self, start: date, end: date, accounts: list[str]) -> list[tuple[date, date, str | None]]:
        """One slice per account and month; override for sources that split differently."""
        out, first = [], start
        while first < end:
            last = min((first.replace(day=1) + timedelta(days=32)).replace(day=1), end)
            out += [(first, last, a) for a in (accounts or [None])]
            first = last
        return out

    #: The date column by which slices are cut: filters on it narrow the range that is fetched. None: no such column.
    day_column: str | None = None

    def fetch(self, start: date, end: date, account: str | None) -> Iterator:
        raise NotImplementedError

    def available(self) -> date:
        """The day up to which (exclusive) the source is complete. A stream reads up to it and goes on from there."""
        raise NotImplementedError

    def committed(self, end: date) -> None:
        """Told once all before ``end`` has been written by a stream; may come again after a restart."""


@dataclass
class Slice(InputPartition):
    start: date
    end: date
    account: str | None


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector, start: date, end: date, accounts: list[str]) -> None:
        self.connector, self.start, self.end, self.accounts = connector, start, end, accounts

    def pushFilters(self, filters: list) -> Iterator:
        """Narrow the range by filters on the day; Spark tests all of them again on the rows."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == (self.connector.day_column,) and isinstance(value, date):
                if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                    self.start = max(self.start, value)
                if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                    self.end = min(self.end, value + timedelta(days=1))
            yield f

    def partitions(self) -> list[Slice]:
        return [Slice(*s) for s in self.connector.slices(self.start, self.end, self.accounts)]

    def read(self, partition: Slice) -> Iterator:
        yield from self.connector.fetch(partition.start, partition.end, partition.account)


class _StreamReader(DataSourceStreamReader):
    """The offset is the first day that has not been read. Slices between two offsets are read as tasks, again and alike after a failure."""

    def __init__(self, connector: Connector, start: date, end: date | None, accounts: list[str]) -> None:
        self.connector, self.start, self.end, self.accounts = connector, start, end, accounts

    def initialOffset(self) -> dict:
        return {"next": self.start.isoformat()}

    def latestOffset(self) -> dict:
        upto = self.connector.available()
        return {"next": max(self.start, upto if self.end is None else min(upto, self.end)).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        first, last = (date.fromisoformat(o["next"]) for o in (start, end))
        return [Slice(*s) for s in self.connector.slices(first, last, self.accounts)]

    def read(self, partition: Slice) -> Iterator:
        yield from self.connector.fetch(partition.start, partition.end, partition.account)

    def commit(self, end: dict) -> None:
        self.connector.committed(date.fromisoformat(end["next"]))


def connector_source(name: str, make: Callable[[dict], Connector], layout: str) -> type[DataSource]:
    """A data source class for a connector, to be read whole or as a stream; slices are read as separate tasks.

    Options: ``start`` and ``end`` (ISO dates, end exclusive; a stream goes on
    without an end), ``accounts`` (comma separated), and whatever ``make`` reads.
    """

    class ConnectorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return layout

        def reader(self, schema) -> DataSourceReader:  # noqa: F811
            accounts = [a for a in self.options.get("accounts", "").split(",") if a]
            return _Reader(make(dict(self.options)), date.fromisoformat(self.options["start"]),
                           date.fromisoformat(self.options["end"]), accounts)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: F811
            accounts = [a for a in self.options.get("accounts", "").split(",") if a]
            end = self.options.get("end")
            return _StreamReader(make(dict(self.options)), date.fromisoformat(self.options["start"]),
                                 date.fromisoformat(end) if end else None, accounts)

    return ConnectorSource


# ── Exporters ─────────────────────────────────────────────────────────────

Exporter = Callable[[DataFrame, str], None]
_EXPORTERS: dict[str, Exporter] = {}


def exporter(name: str) -> Callable[[Exporter], Exporter]:
    """Register an exporter ``(rows, path)`` under a name. It writes with Spark, so every task writes its own share."""

    def add(fn: Exporter) -> Exporter:
        if name in _EXPORTERS:
            raise ValueError(f"exporter {name!r} exists")
        _EXPORTERS[name] = fn
        return fn

    return add


@exporter("focus_jsonl")
def _json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def run_exporter(rows: DataFrame, name: str, path: str) -> dict:
    """Export below ``path``: ``data``, and ``manifest`` once all of it is written.

    The records are counted while they are written. Without a manifest the data of a failed export is not to be read.
    """
    seen = Observation()
    _EXPORTERS[name](rows.observe(seen, F.count(F.lit(1)).alias("n")), f"{path}/data")
    manifest = {"status": "success", "exporter": name, "records_exported": seen.get["n"], "destination": f"{path}/data"}
    spark = rows.sparkSession
    row = spark.createDataFrame([tuple(manifest.values())], "status string, exporter string, records_exported long, destination string")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


class Encoder:
    """How rows become the bytes of an exported file. The object is sent to the executors."""

    suffix = ".bin"

    def encode(self, batch) -> bytes:
        """The bytes of one Arrow batch, to be appended to those before."""
        raise NotImplementedError


class JsonLines(Encoder):
    suffix = ".jsonl"

    def encode(self, batch) -> bytes:
        import json

        return "".join(json.dumps(row, default=str) + "\n" for row in batch.to_pylist()).encode()


@dataclass
class Written(WriterCommitMessage):
    file: str
    records: int
    size: int


def _store(path: str):
    """The file system of a path and the path in it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


class _FileWriter(DataSourceArrowWriter):
    """Tasks write a file each below a folder of this export; the manifest that names them is written last, so a reader sees all of an
    export or nothing. Files of tasks that failed or ran twice are in no manifest."""

    def __init__(self, path: str, encoder: Encoder) -> None:
        import uuid

        self.path, self.encoder, self.run = path, encoder, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        import uuid

        store, root = _store(self.path)
        folder = f"{root}/{self.run}"
        store.create_dir(folder, recursive=True)
        name = f"{self.run}/part-{uuid.uuid4().hex}{self.encoder.suffix}"
        records = size = 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                data = self.encoder.encode(batch)
                out.write(data)
                records, size = records + batch.num_rows, size + len(data)
        return Written(name, records, size)

    def commit(self, messages: list) -> None:
        import json

        store, root = _store(self.path)
        files = [{"file": m.file, "records": m.records, "bytes": m.size} for m in messages if m is not None]
        manifest = {"status": "success", "run": self.run, "files": files,
                    "records": sum(f["records"] for f in files), "bytes": sum(f["bytes"] for f in files)}
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/manifest.json.{self.run}") as out:
            out.write(json.dumps(manifest).encode())
        store.move(f"{root}/manifest.json.{self.run}", f"{root}/manifest.json")

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.run}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.run}")


def export_files(rows: DataFrame, path: str, encoder: Encoder) -> dict:
    """Export ``rows`` with one file per task below ``path``, and return the manifest. An earlier export stays what readers see until
    this one is complete; one that fails removes its files."""
    import json

    class FileExport(DataSource):
        @classmethod
        def name(cls) -> str:
            return "file_export"

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return _FileWriter(path, encoder)

    _travels(type(encoder).__module__)
    register_sources(rows.sparkSession, FileExport)
    rows.write.format("file_export").mode("append").save()
    store, root = _store(path)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def exported_files(path: str) -> list[str]:
    """The files of the last complete export below ``path``; none if there is none."""
    import json

    from pyarrow import fs

    store, root = _store(path)
    if store.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
        return []
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return [f"{path}/{x['file']}" for x in json.loads(f.read())["files"]]


# ── Detectors ─────────────────────────────────────────────────────────────

Detector = Callable[[DataFrame, date, int], DataFrame]
_DETECTORS: dict[str, Detector] = {}


def detector(name: str) -> Callable[[Detector], Detector]:
    """Register a detector ``(billing, as_of, days) -> insights`` under a name."""

    def add(fn: Detector) -> Detector:
        if name in _DETECTORS:
            raise ValueError(f"detector {name!r} exists")
        _DETECTORS[name] = fn
        return fn

    return add


def detectors() -> dict[str, Detector]:
    return dict(_DETECTORS)


def check_insights(df: DataFrame, name: str) -> DataFrame:
    """Reject a plug-in whose columns do not fit the insight layout; fill what it leaves out."""
    known = {f.name: f.dataType for f in schema.INSIGHT_SCHEMA.fields}
    extra = set(df.columns) - set(known)
    missing = {"provider", "title"} - set(df.columns)
    if extra or missing:
        raise ValueError(f"detector {name!r}: unknown columns {sorted(extra)}, missing columns {sorted(missing)}")
    return schema.conform_insights(df)


def run_detectors(b: DataFrame, as_of: date, days: int = 30, names: list[str] | None = None) -> DataFrame:
    """The insights of the named detectors (all by default) as one table."""
    chosen = names or sorted(_DETECTORS)
    parts = [check_insights(_DETECTORS[n](b, as_of, days), n) for n in chosen]
    if not parts:
        raise ValueError("no detector registered")
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both


def _travels(*modules: str) -> None:
    """Send the code of these modules along with objects that need it."""
    import sys

    from pyspark import cloudpickle

    for module in {*modules, __name__}:
        cloudpickle.register_pickle_by_value(sys.modules[module])


def register_sources(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Register source classes; their code travels with them, so executors need not have it installed."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in sources:
        _travels(source.__module__)
        spark.dataSource.register(source)
