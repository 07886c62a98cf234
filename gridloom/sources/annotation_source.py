"""Annotation files of many stimuli as a Spark data source: a partition a file, channels of every kind, corrupt files as rows.

``spark.dataSource.register(AnnotationSource)``, then ``spark.read.format("annotations").load(folder)``. A filter on path
is pushed down, so a decoder reads only the channels asked for. Options: ``suffix`` (.json), and ``decoder``, a name
``module:function`` of what turns an open file into rows; the JSON profile's is built in, HDF5's needs h5py.
"""

from __future__ import annotations

import importlib
import io
import json
import tempfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "stim_id string, path string, dtype string, applicable boolean, bin int, num double, vec array<double>, code int, label string, onsets array<double>, file string, problem string"
ROW = pa.schema([
    ("stim_id", pa.string()), ("path", pa.string()), ("dtype", pa.string()), ("applicable", pa.bool_()), ("bin", pa.int32()), ("num", pa.float64()), ("vec", pa.list_(pa.float64())),
    ("code", pa.int32()), ("label", pa.string()), ("onsets", pa.list_(pa.float64())), ("file", pa.string()), ("problem", pa.string()),
])
TOGETHER = 256  # channels whose rows a task holds before it writes them
Channel = tuple[str, str, str, bool, list, list | None]  # stim_id, path, dtype, applicable, values by bin, onsets
Decoder = Callable[[BinaryIO, Callable[[str], bool]], Iterator[Channel]]


def json_profile(f: BinaryIO, wanted: Callable[[str], bool]) -> Iterator[Channel]:
    """Profiles {stimulus: {id}, features: {class: {subclass: {leaf: {dtype, applicable, value, onsets}}}}}, one object a line or one in the file."""
    lines = io.TextIOWrapper(f, encoding="utf-8", newline="\n")
    if not (first := next((line for line in lines if line.strip()), "")):
        return
    try:
        profile = json.loads(first)
    except json.JSONDecodeError:  # an object of several lines
        yield from _channels(json.loads(first + lines.read()), wanted)
        return
    yield from _channels(profile, wanted)
    for line in lines:
        if line.strip():
            yield from _channels(json.loads(line), wanted)


def _channels(profile: dict, wanted: Callable[[str], bool]) -> Iterator[Channel]:
    for a, subclasses in profile["features"].items():
        for b, leaves in subclasses.items():
            for leaf, held in leaves.items():
                if wanted(path := f"{a}/{b}/{leaf}"):
                    yield str(profile["stimulus"]["id"]), path, held.get("dtype", "scalar"), bool(held.get("applicable", True)), held.get("value") or [], held.get("onsets")


def hdf5(f: BinaryIO, wanted: Callable[[str], bool]) -> Iterator[Channel]:
    """Datasets under ``features`` with their attributes dtype and applicable, onsets in ``<path>__onsets``; a whole column at a time."""
    import h5py

    with h5py.File(f, "r") as file:
        stim, found = str(file.attrs.get("stimulus_id", "")), []
        file["features"].visititems(lambda name, item: found.append(name) if isinstance(item, h5py.Dataset) and not name.endswith("__onsets") and wanted(name) else None)
        for name in found:
            item = file["features"][name]
            text = lambda v: v.decode() if isinstance(v, bytes) else v
            onsets = file["features"][f"{name}__onsets"][()].tolist() if f"{name}__onsets" in file["features"] else None
            yield stim, name, text(item.attrs.get("dtype", "scalar")), bool(item.attrs.get("applicable", True)), [text(v) for v in item[()].tolist()], onsets


def _rows(channel: Channel, file: str) -> pa.RecordBatch:
    stim, path, dtype, applicable, values, onsets = channel
    n = len(values)
    held: dict[str, list] = {"num": [None] * n, "vec": [None] * n, "code": [None] * n, "label": [None] * n}
    if applicable:
        if dtype == "vector":
            held["vec"] = [None if v is None else [None if x is None or x != x else float(x) for x in v] for v in values]
        elif dtype == "label":
            held["label"] = [None if v is None else str(v) for v in values]
        elif dtype == "categorical":
            held["code"] = [None if v is None or v < 0 else int(v) for v in values]
        else:
            held["num"] = [None if v is None or v != v or (dtype == "bool" and v == -1) else float(v) for v in values]
    columns = {"stim_id": [stim] * n, "path": [path] * n, "dtype": [dtype] * n, "applicable": [applicable] * n, "bin": list(range(n)), **held, "onsets": [onsets] * n, "file": [file] * n, "problem": [None] * n}
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in ROW], schema=ROW)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class FilePart(InputPartition):
    def __init__(self, file: str) -> None:
        super().__init__(file)
        self.file = file


class AnnotationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.suffix, self.decoder = options["path"], options.get("suffix", ".json"), options.get("decoder", f"{__name__}:json_profile")
        self.exact: list[str] | None = None
        self.prefixes: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take what is asked of path; the rest stays with Spark."""
        for f in filters:
            names = [f.value] if isinstance(f, EqualTo) and f.attribute == ("path",) else list(f.value) if isinstance(f, In) and f.attribute == ("path",) else None
            if names is not None:
                self.exact = names if self.exact is None else [n for n in self.exact if n in names]
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f

    def wanted(self, path: str) -> bool:
        return (self.exact is None or path in self.exact) and all(path.startswith(p) for p in self.prefixes)

    def partitions(self) -> list[FilePart]:
        from pyarrow import fs

        store, name = _store(self.folder)
        found = [store.get_file_info(name)]
        found = store.get_file_info(fs.FileSelector(name, recursive=True)) if found[0].type == fs.FileType.Directory else found
        scheme = self.folder.split("://")[0] + "://" if "://" in self.folder else ""
        return [FilePart(scheme + i.path) for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and i.path.endswith(self.suffix)]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        """The channels of one file; one that cannot be read is a row that says why, and nothing else of it.

        Rows go to a temporary file of the task as they are made, and from there to Spark once the whole file has been read.
        """
        module, function = self.decoder.split(":")
        decode: Decoder = getattr(importlib.import_module(module), function)
        try:
            store, name = _store(part.file)
            with tempfile.TemporaryFile() as spool:
                with store.open_input_file(name) as f, pa.ipc.new_stream(spool, ROW) as out:
                    held: list[pa.RecordBatch] = []
                    for channel in decode(f, self.wanted):
                        held.append(_rows(channel, part.file))
                        if len(held) >= TOGETHER:
                            out.write_table(pa.Table.from_batches(held, ROW).combine_chunks())
                            held = []
                    out.write_table(pa.Table.from_batches(held, ROW).combine_chunks())
                spool.seek(0)
                read = pa.ipc.open_stream(spool)
                yield from (b for b in read if b.num_rows)
        except (OSError, ValueError, KeyError, TypeError, AttributeError) as problem:
            none = {c: [None] for c in ROW.names} | {"file": [part.file], "problem": [f"{type(problem).__name__}: {problem}"[:200]]}
            yield pa.RecordBatch.from_arrays([pa.array(none[f.name], f.type) for f in ROW], schema=ROW)


class AnnotationSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> AnnotationReader:
        return AnnotationReader(dict(self.options))


def read_files(spark, folder: str, **options: str) -> DataFrame:
    """All channels of the annotation files of a folder, with the rows of what could not be read."""
    spark.dataSource.register(AnnotationSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("annotations").options(**options).load(folder)


def corrupt_files(rows: DataFrame) -> DataFrame:
    """(file, problem) of those that could not be read."""
    return rows.where("problem is not null").select("file", "problem")
