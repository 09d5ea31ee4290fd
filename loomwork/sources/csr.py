"""A data source for matrices kept as a folder of arrays: compressed rows (indptr, indices, data) or one dense array.

``meta.json`` states encoding and shape. Tasks read blocks of rows: each maps the arrays, takes the one stretch that spans its
rows and picks them out of it, so a selection costs what it spans and never the whole matrix.

    spark.dataSource.register(CsrSource)
    spark.read.format("rows_of_arrays").option("path", folder).option("rows", "rows.npy").load()
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "cell bigint, feature bigint, value double"


def write_csr(folder: str, indptr: np.ndarray, indices: np.ndarray, data: np.ndarray, n_features: int) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, x in (("indptr", indptr), ("indices", indices), ("data", data)):
        np.save(os.path.join(folder, f"{name}.npy"), np.asarray(x))
    with open(os.path.join(folder, "meta.json"), "w") as f:
        json.dump({"encoding": "csr_matrix", "shape": [len(indptr) - 1, int(n_features)]}, f)


def write_dense(folder: str, x: np.ndarray) -> None:
    os.makedirs(folder, exist_ok=True)
    np.save(os.path.join(folder, "dense.npy"), x)
    with open(os.path.join(folder, "meta.json"), "w") as f:
        json.dump({"encoding": "array", "shape": list(x.shape)}, f)


class Rows(InputPartition):
    def __init__(self, rows: np.ndarray):
        self.rows = rows


class CsrReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        with open(os.path.join(self.folder, "meta.json")) as f:
            meta = json.load(f)
        self.encoding, (self.n, self.p) = meta["encoding"], meta["shape"]
        if self.encoding not in ("csr_matrix", "array"):
            raise ValueError(f"matrices are read as csr_matrix or array, not {self.encoding!r}")
        self.block = int(options.get("rowblock", 2048))
        if self.block < 1:
            raise ValueError("rowBlock must be above 0")
        rows = options.get("rows")
        self.rows = np.arange(self.n) if rows is None else np.load(os.path.join(self.folder, rows))
        if self.rows.dtype == bool:
            if len(self.rows) != self.n:
                raise ValueError(f"a mask of rows needs {self.n} booleans, not {len(self.rows)}")
            self.rows = np.flatnonzero(self.rows)

    def partitions(self) -> list[Rows]:
        return [Rows(self.rows[k : k + self.block]) for k in range(0, len(self.rows), self.block)] or [Rows(self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        rows = np.asarray(partition.rows, np.int64)
        if not len(rows):
            return
        lo, hi = int(rows.min()), int(rows.max()) + 1
        load = lambda name: np.load(os.path.join(self.folder, f"{name}.npy"), mmap_mode="r")
        if self.encoding == "array":
            part = np.asarray(load("dense")[lo:hi])[rows - lo]
            at, feature = np.nonzero(part)
            cell, value = rows[at], part[at, feature]
        else:
            off = np.asarray(load("indptr")[lo : hi + 1]).astype(np.int64)
            indices, data = (np.asarray(load(name)[off[0] : off[-1]]) for name in ("indices", "data"))
            size = np.diff(off)[rows - lo]
            begin = off[rows - lo] - off[0]
            at = np.arange(size.sum()) + np.repeat(begin - np.r_[0, np.cumsum(size)[:-1]], size)
            cell, feature, value = np.repeat(rows, size), indices[at], data[at]
            keep = value != 0
            cell, feature, value = cell[keep], feature[keep], value[keep]
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(feature.astype(np.int64)), pa.array(value.astype(np.float64))], ["cell", "feature", "value"])


class CsrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rows_of_arrays"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options)
