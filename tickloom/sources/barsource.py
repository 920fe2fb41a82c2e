"""Binary bar files as a Spark data source: ``spark.read.format("barfiles")``, ``readStream`` and ``write``.

Files are cut into ranges of whole records and small files are put together, so
partitions are of about one size whatever the files are.  A daily file that no
other one shares its ticker with, and that is no larger than a partition, is read
whole by one task, which keeps the last record of each day itself; only bars of
other files have to meet by ticker and time.  A stream takes the
records that files have gained since the last batch.  Files are reached through
pyarrow, which knows local, HDFS, S3 and GCS addresses; for other stores
``barfiles.read_bar_files`` reads whole files through Spark.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from tickloom.sources.barfiles import RECORD, SCHEMA, bars_of_records

#: Bytes of a partition, and records that a task holds at once.
SPLIT_BYTES, RECORDS_AT_ONCE = 64 << 20, 65_536
WRITTEN = "asset_class string, ticker string, ts timestamp, open double, high double, low double, close double, volume double, open_int double"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path.rstrip("/")) if path.startswith("/") else fs.FileSystem.from_uri(path.rstrip("/"))


@dataclass
class Ranges(InputPartition):
    """Pieces of files as (path, first record, records)."""

    pieces: list[tuple[str, int, int]]


def sizes(path: str, suffix: str) -> dict[str, int]:
    """Whole records of each file under ``path``."""
    files, root = store(path)
    found = files.get_file_info(fs.FileSelector(root, recursive=True))
    return {f.path: f.size // RECORD.itemsize for f in found if f.type == fs.FileType.File and f.path.endswith(f".{suffix}")}


def dealt(ranges: list[tuple[str, int, int]], split_bytes: int) -> list[Ranges]:
    """Ranges of records in partitions of at most ``split_bytes``, large ones cut and small ones together."""
    most, out, room = max(1, split_bytes // RECORD.itemsize), [], 0
    for path, first, n in ranges:
        while n:
            if not room:
                out.append(Ranges([]))
                room = most
            take = min(n, room)
            out[-1].pieces.append((path, first, take))
            first, n, room = first + take, n - take, room - take
    return out


def alone(found: dict[str, int], most: int) -> list[tuple[str, int]]:
    """Files (path, records) of at most ``most`` records whose ticker and asset class no other one can have.

    Tickers are upper-cased and trimmed later, not by Python, so names that are
    not plain ASCII are left out.
    """
    owner = {p: (p.split("/")[-2], p.rsplit("/", 1)[-1].rsplit(".", 1)[0].strip().upper()) for p in found}
    held = Counter(owner.values())
    return [(p, n) for p, n in found.items() if n <= most and p.rsplit("/", 1)[-1].isascii() and held[owner[p]] == 1]


def dealt_whole(files: list[tuple[str, int]], split_bytes: int) -> list[Ranges]:
    """Whole files in partitions of about ``split_bytes``."""
    most, out, room = max(1, split_bytes // RECORD.itemsize), [], 0
    for path, n in files:
        if room <= 0:
            out.append(Ranges([]))
            room = most
        out[-1].pieces.append((path, 0, n))
        room -= n
    return out


def split_for(total: int, split_bytes: int, tasks: int) -> int:
    """Bytes of a partition: ``split_bytes``, or as many more, up to ``SPLIT_BYTES``, as leave ``tasks`` partitions; a task costs more than small pieces do."""
    return max(split_bytes, min(SPLIT_BYTES, -(-total // tasks))) if tasks else split_bytes


def records(path: str, partition: Ranges) -> Iterator[pa.RecordBatch]:
    files, _ = store(path)
    for name, first, n in partition.pieces:
        with files.open_input_file(name) as f:
            for at in range(first, first + n, RECORDS_AT_ONCE):
                count = min(RECORDS_AT_ONCE, first + n - at)
                rows = np.frombuffer(f.read_at(count * RECORD.itemsize, at * RECORD.itemsize), RECORD)
                columns = [pa.array([name] * count, pa.string()), pa.array(np.arange(at, at + count)), *(pa.array(rows[c].astype(np.int32 if c in "dt" else np.float64)) for c in RECORD.names)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "record", *RECORD.names])


def last_of_days(path: str, partition: Ranges) -> Iterator[pa.RecordBatch]:
    """Of each whole file and day the last record, many files in a batch; ``path`` is cut to the file and the folder above it."""
    files, _ = store(path)
    names, parts, held = [], [], 0

    def batch() -> pa.RecordBatch:
        rows = np.concatenate([r for r, _ in parts])
        of = pa.array(names).take(pa.array(np.repeat(np.arange(len(parts)), [len(r) for r, _ in parts])))
        return pa.RecordBatch.from_arrays([of, pa.array(np.concatenate([at for _, at in parts])), *(pa.array(rows[c].astype(np.int32 if c in "dt" else np.float64)) for c in RECORD.names)], ["path", "record", *RECORD.names])

    for name, _, n in partition.pieces:
        with files.open_input_file(name) as f:
            rows = np.frombuffer(f.read_at(n * RECORD.itemsize, 0), RECORD)
        if len(rows) > 1 and not (rows["d"][1:] > rows["d"][:-1]).all():
            at = np.sort(len(rows) - 1 - np.unique(rows["d"][::-1], return_index=True)[1])
            rows = rows[at]
        else:
            at = np.arange(len(rows))
        names.append("/".join(name.split("/")[-2:]))
        parts.append((rows, at))
        held += len(rows)
        if held >= RECORDS_AT_ONCE:
            yield batch()
            names, parts, held = [], [], 0
    if held:
        yield batch()


class BarReader(DataSourceReader):
    """With the option ``files`` as "alone" the last records of the days of each file that is alone, as "shared" all records of the other files."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.split, self.tasks = options["path"], options.get("suffix", "dat"), int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("tasks", 0))
        self.files = options.get("files", "all")

    def partitions(self) -> list[Ranges]:
        found = dict(sorted(sizes(self.path, self.suffix).items()))
        split = split_for(sum(found.values()) * RECORD.itemsize, self.split, self.tasks)
        if self.files != "all":
            single = alone(found, max(1, split // RECORD.itemsize))
            if self.files == "alone":
                return dealt_whole(single, split) or [Ranges([])]
            apart = {p for p, _ in single}
            found = {p: n for p, n in found.items() if p not in apart}
        return dealt([(p, 0, n) for p, n in found.items()], split) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from (last_of_days if self.files == "alone" else records)(self.path, partition)


class BarStreamReader(DataSourceStreamReader):
    """Offsets are the records of each file; a file is a ticker, so their number is that of the tickers."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.split = options["path"], options.get("suffix", "dat"), int(options.get("splitbytes", SPLIT_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes(self.path, self.suffix)

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        return dealt([(p, start.get(p, 0), n - start.get(p, 0)) for p, n in sorted(end.items()) if n > start.get(p, 0)], self.split)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        yield from records(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class BarWriter(DataSourceArrowWriter):
    """Rows sorted by (asset_class, ticker, ts), no ticker in two tasks: a file for each, put in place when all are written."""

    def __init__(self, options: dict):
        self.path, self.suffix, self.staged = options["path"], options.get("suffix", "dat"), f"_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = store(self.path)
        written, open_file, at, made = [], None, None, set()
        staged = f"{root}/{self.staged}/{uuid.uuid4().hex}"  # of this attempt: a repeated task shares no file with the first
        try:
            for batch in iterator:
                kinds, tickers, out = *(batch.column(c).dictionary_encode() for c in ("asset_class", "ticker")), self.coded(batch)
                codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False) for c in (kinds, tickers)]
                begins = np.flatnonzero(np.r_[len(out) > 0, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])])
                for first, end in zip(begins.tolist(), [*begins[1:].tolist(), len(out)]):
                    kind, ticker = kinds[first].as_py(), tickers[first].as_py()
                    if kind is None or ticker is None:
                        continue
                    if at != (kind, ticker):
                        if open_file:
                            open_file.close()
                        at, name = (kind, ticker), f"{kind}/{ticker}.{self.suffix}"
                        if kind not in made:
                            files.create_dir(f"{staged}/{kind}", recursive=True)
                            made.add(kind)
                        open_file = files.open_output_stream(f"{staged}/{name}")
                        written.append(f"{staged}/{name}")
                    open_file.write(out[first:end].tobytes())
        finally:
            if open_file:
                open_file.close()
        return Written(written)

    @staticmethod
    def coded(batch: pa.RecordBatch) -> np.ndarray:
        """The rows of a batch as records; rows without a time have day 0, which is no date."""
        out, ts = np.zeros(batch.num_rows, RECORD), batch.column("ts")
        ts = (pc.local_timestamp(ts) if ts.type.tz else ts).cast(pa.timestamp("us")).to_numpy(zero_copy_only=False)
        day, month = ts.astype("datetime64[D]"), ts.astype("datetime64[M]")
        months, seconds = month.astype(np.int64) + 1970 * 12, (ts - day).astype("timedelta64[s]").astype(np.int64)
        known = ~np.isnat(ts)
        out["d"] = np.where(known, months // 12 * 10000 + (months % 12 + 1) * 100 + (day - month.astype("datetime64[D]")).astype(np.int64) + 1, 0)
        out["t"] = np.where(known, seconds // 3600 * 10000 + seconds // 60 % 60 * 100 + seconds % 60, 0)
        for c in RECORD.names[2:]:
            out[c] = batch.column(c).to_numpy(zero_copy_only=False)
        return out

    def commit(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        written = [f for m in messages if m for f in m.files]
        for kind in {name.split("/")[-2] for name in written}:
            files.create_dir(f"{root}/{kind}", recursive=True)
        for name in written:
            kind, file = name.split("/")[-2:]
            files.move(name, f"{root}/{kind}/{file}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = store(self.path)
        if files.get_file_info(f"{root}/{self.staged}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.staged}")


class BarFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "barfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BarReader:
        return BarReader(dict(self.options))

    def streamReader(self, schema) -> BarStreamReader:
        return BarStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> BarWriter:
        return BarWriter(dict(self.options))


def read_bars(spark: SparkSession, path: str, since: str | None = None, suffix: str = "dat", intraday: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """As ``barfiles.read_bar_files``, from record ranges in the place of whole files."""
    spark.dataSource.register(BarFiles)
    def rows(files: str) -> DataFrame:
        return spark.read.format("barfiles").option("suffix", suffix).option("splitbytes", split_bytes).option("tasks", 4 * spark.sparkContext.defaultParallelism).option("files", files).load(path)

    if intraday:
        return bars_of_records(rows("all"), since, suffix, intraday)
    single = bars_of_records(rows("alone"), since, suffix, intraday, last=False).drop("record")
    return single.unionByName(bars_of_records(rows("shared"), since, suffix, intraday))


def bar_stream(spark: SparkSession, path: str, suffix: str = "dat", intraday: bool = False) -> DataFrame:
    """A stream of the bars that files under ``path`` gain; of a ticker and time, the last record of a batch is for the sink to choose (``record``)."""
    spark.dataSource.register(BarFiles)
    rows = spark.readStream.format("barfiles").option("suffix", suffix).load(path)
    return bars_of_records(rows, None, suffix, intraday, last=False)


def write_bars(bars: DataFrame, path: str, asset_class: str = "stock", suffix: str = "dat") -> None:
    """Bars (ticker, ts, OHLCV, ``open_int`` and ``asset_class`` if there) as a file for each ticker; a file that is there is replaced."""
    bars.sparkSession.dataSource.register(BarFiles)
    extra = {"asset_class": F.lit(asset_class), "open_int": F.lit(0.0)}
    full = bars.withColumns({n: c for n, c in extra.items() if n not in bars.columns})
    columns = [F.col(n).cast(t).alias(n) for n, t in (c.split() for c in WRITTEN.split(", "))]
    keys = ["asset_class", "ticker"]
    full.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "ts").write.format("barfiles").mode("append").option("suffix", suffix).save(path)
