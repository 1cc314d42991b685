"""WFDB records as a Python data source: format wfdb, a .hea header and a .dat file of interleaved 16-bit samples.

    spark.dataSource.register(WfdbSource)
    spark.read.format("wfdb").load("/data/FL010")

A file is read in ranges of samples, one task each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SIGNAL = re.compile(r"^(\S+)\s+(\d+)\S*\s+([-+\d.eE]+)(?:\((-?\d+)\))?(?:/(\S+))?(.*)$")


@dataclass
class Signal:
    file: str
    gain: float
    baseline: int
    unit: str
    name: str


@dataclass
class Header:
    record: str
    frequency: float
    samples: int
    signals: list[Signal]


def parse_header(text: str) -> Header:
    """Record line: name, signals, frequency, samples. Signal lines: file, format, gain(baseline)/unit, resolution, zero, first value, checksum, block, name."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    record = lines[0].split()
    signals = []
    for line in lines[1 : 1 + int(record[1])]:
        m = SIGNAL.match(line)
        if not m or m[2] != "16":
            raise ValueError(f"16-bit signals only: {line}")
        rest = m[6].split(None, 5)
        gain = float(m[3]) or 200.0
        zero = int(rest[1]) if len(rest) > 1 else 0
        signals.append(Signal(m[1], gain, int(m[4]) if m[4] is not None else zero, m[5] or "mV", rest[5].strip() if len(rest) > 5 else ""))
    if len({s.file for s in signals}) != 1:
        raise ValueError("all signals in one file are needed")
    return Header(record[0], float(record[2].split("/")[0]) if len(record) > 2 else 250.0, int(record[3]) if len(record) > 3 else 0, signals)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class WfdbSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wfdb"

    def schema(self) -> str:
        return "series_id string, t bigint, dim int, value double"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return WfdbReader(self.options["path"], int(self.options.get("samplesPerTask", 1_000_000)))


class WfdbReader(DataSourceReader):
    def __init__(self, path: str, per_task: int) -> None:
        self.path, self.per_task = path.removesuffix(".hea"), per_task
        store, at = _open(self.path + ".hea")
        with store.open_input_stream(at) as f:
            self.header = parse_header(f.read().decode("latin-1"))

    def _data(self) -> str:
        return self.path.rsplit("/", 1)[0] + "/" + self.header.signals[0].file if "/" in self.path else self.header.signals[0].file

    def partitions(self) -> list[InputPartition]:
        n = self.header.samples
        if not n:
            store, at = _open(self._data())
            n = store.get_file_info(at).size // (2 * len(self.header.signals))
        return [InputPartition((k, min(n, k + self.per_task))) for k in range(0, n, self.per_task)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        first, last = partition.value
        width = len(self.header.signals)
        store, at = _open(self._data())
        gain, baseline = (np.array([getattr(s, k) for s in self.header.signals], float) for k in ("gain", "baseline"))
        with store.open_input_file(at) as f:
            f.seek(first * width * 2)
            for k in range(first, last, 50_000):
                n = min(50_000, last - k)
                raw = np.frombuffer(f.read(n * width * 2), "<i2").reshape(-1, width)
                value = (raw - baseline) / gain
                value[raw == -32768] = np.nan  # the format's mark of a missing sample
                m = len(raw)
                yield pa.RecordBatch.from_pydict({
                    "series_id": [self.header.record] * (m * width), "t": np.repeat(np.arange(k, k + m), width),
                    "dim": np.tile(np.arange(width, dtype=np.int32), m), "value": value.ravel(),
                })
