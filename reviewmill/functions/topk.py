"""Task-side search for the nearest vectors of one batch, partition or block.

These functions run in the Python workers. The module is pickled by value (see
``operators.neighbours``), so workers need no copy of this package.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa

QUERY_CHUNK = 64
BASE_SLICE = 4096
MEASURED_PAIRS = 16_384
COLUMNS = ["_query", "_rank", "_dist", "_key"]


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Valid flags and the valid vectors as a double matrix; only finite vectors are valid."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    valid = np.asarray(vectors.is_valid())
    present = vectors.drop_null()
    rows = len(present)
    flat = present.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    dim = len(present[0]) if rows else 0
    if flat.size != rows * dim:
        raise ValueError("vectors differ in length")
    matrix = flat.reshape(rows, dim)
    finite = np.isfinite(matrix).all(axis=1)
    if not finite.all():
        valid = valid.copy()
        valid[np.flatnonzero(valid)[~finite]] = False
        matrix = matrix[finite]
    return valid, matrix


def _squares(matrix: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", matrix, matrix)


class Search:
    """Running ``k`` nearest (distance, key) pairs of some queries, fed batch by batch.

    A matrix product rules out the rows that cannot be among the nearest; the few left are
    measured exactly. Distance is infinite where the query or the row has no finite vector.
    """

    def __init__(self, names: list, vectors: pa.Array, k: int):
        self.names, self.k = names, k
        valid, matrix = _matrix(vectors)
        self.positions, self.matrix = np.flatnonzero(valid), matrix
        self.without = np.flatnonzero(~valid)
        self.best: list[list] = [[] for _ in names]
        self.last = np.full(len(self.best), np.inf)  # square of the k-th distance so far

    def _keep(self, query: int, pairs: list) -> None:
        best = self.best[query] = heapq.nsmallest(self.k, self.best[query] + pairs)
        if len(best) >= self.k:
            self.last[query] = best[-1][0] ** 2

    def _limits(self, queries: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Squares no candidate can exceed: of the k-th pair so far, or of this batch."""
        limits = self.last[queries]
        unset = np.isinf(limits)
        if squares.shape[1] > self.k and unset.any():
            limits[unset] = np.partition(squares[unset], self.k - 1, axis=1)[:, self.k - 1]
        return limits

    def add(self, keys: pa.Array, vectors: pa.Array) -> None:
        valid, rows = _matrix(vectors)
        present, missing = np.flatnonzero(valid), np.flatnonzero(~valid)
        row_squares = _squares(rows)
        largest = float(row_squares.max()) if len(rows) else 0.0
        if len(rows) and len(self.matrix) and rows.shape[1] != self.matrix.shape[1]:
            raise ValueError("vectors differ in length")
        for start in range(0, len(self.positions) if len(rows) else 0, QUERY_CHUNK):
            chunk = self.matrix[start : start + QUERY_CHUNK]
            queries = self.positions[start : start + QUERY_CHUNK]
            lengths = _squares(chunk)
            squares = chunk @ rows.T  # a query has a row of its own, so it is read in one piece
            squares *= -2.0
            squares += row_squares[None, :]
            squares += lengths[:, None]
            limits = self._limits(queries, squares) + 1e-9 * (1.0 + largest + lengths)
            asked, near = np.nonzero(squares <= limits[:, None])
            if not len(near):
                continue
            parts = [slice(i, i + MEASURED_PAIRS) for i in range(0, len(near), MEASURED_PAIRS)]
            exact = np.concatenate([np.sqrt(_squares(rows[near[part]] - chunk[asked[part]])) for part in parts])
            names = keys.take(pa.array(present[near]))
            cuts = np.searchsorted(asked, np.arange(len(chunk) + 1)).tolist()
            for query, first, end in zip(queries.tolist(), cuts, cuts[1:]):
                if first < end:
                    self._keep(query, list(zip(exact[first:end].tolist(), names.slice(first, end - first).to_pylist())))
        self._add_unmeasured(keys, missing)

    def _add_unmeasured(self, keys: pa.Array, missing: np.ndarray) -> None:
        """Rows without a vector fill up what is left of ``k``; lowest keys first."""
        open_queries = self.positions[np.isinf(self.last[self.positions])].tolist() if len(missing) else []
        if open_queries:
            lowest = heapq.nsmallest(self.k, keys.take(pa.array(missing)).to_pylist())
            for query in open_queries:
                self._keep(query, [(math.inf, key) for key in lowest])
        if len(self.without):
            lowest = heapq.nsmallest(self.k, keys.to_pylist())
            for query in self.without:
                self._keep(int(query), [(math.inf, key) for key in lowest])

    def pairs(self) -> list[tuple]:
        """(query, rank, distance or None, key) of every pair found."""
        return [
            (name, rank, None if math.isinf(dist) else dist, key)
            for name, rows in zip(self.names, self.best)
            for rank, (dist, key) in enumerate(rows, 1)
        ]


def _batch(pairs: list[tuple], name_type: pa.DataType, key_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*pairs)) if pairs else [(), (), (), ()]
    types = (name_type, pa.int32(), pa.float64(), key_type)
    arrays = [pa.array(values, type=t) for values, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, COLUMNS)


def scan_base(queries: pa.Table, k: int):
    """Task function: nearest base rows of each held query within one partition."""
    names, name_type = queries.column(0).to_pylist(), queries.schema.field(0).type
    vectors = queries.column(1).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key_type = Search(names, vectors, k), None
        for batch in batches:
            key_type = batch.schema.field(0).type
            search.add(batch.column(0), batch.column(1))
        if key_type is not None:
            yield _batch(search.pairs(), name_type, key_type)

    return run


REQUEST_COLUMNS = ["_request", "_k", "_query", "_dist", "_key"]


def scan_requests(shared, key_type: pa.DataType):
    """Task function: nearest rows of every query of the requests that a row is listed for.

    ``shared`` is a broadcast dictionary: request number to ``k``, names and vectors of its queries. Rows
    come as key, vector and list of request numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches: dict[int, Search] = {}
        for batch in batches:
            keys, vectors, lists = batch.columns
            sizes = np.diff(lists.offsets.to_numpy())
            numbers = lists.flatten().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            order = np.argsort(numbers, kind="stable")
            cuts = np.flatnonzero(np.diff(numbers[order], prepend=-1))
            for part in np.split(order, cuts[1:]) if len(order) else []:
                number = int(numbers[part[0]])
                if number not in searches:
                    k, names, asked = shared.value[number]
                    searches[number] = Search(names, pa.array(asked, pa.list_(pa.float64())), k)
                chosen = pa.array(rows[part])
                searches[number].add(keys.take(chosen), vectors.take(chosen))
        found = [
            (number, search.k, name, dist, key)
            for number, search in searches.items()
            for name, _, dist, key in search.pairs()
        ]
        types = (pa.int32(), pa.int32(), pa.string(), pa.float64(), key_type)
        columns = list(zip(*found)) if found else [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], REQUEST_COLUMNS)

    return run


def scan_queries(base: pa.Table, k: int):
    """Task function: nearest rows of a held base for each query of one partition."""
    keys, vectors = base.column(0).combine_chunks(), base.column(1).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            search = Search(batch.column(0).to_pylist(), batch.column(1), k)
            search.add(keys, vectors)
            yield _batch(search.pairs(), batch.schema.field(0).type, keys.type)

    return run


def scan_blocks(k: int):
    """Group function: nearest base rows of one query block within one base block.

    The base is measured in slices: a query's limit is found in the first one, and matrices stay small.
    """

    def run(queries: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        vector = pa.list_(pa.float64())
        search = Search(queries["_query"].tolist(), pa.array(queries["_vector"], type=vector), k)
        keys = pa.array(base["_key"])
        for start in range(0, len(base), BASE_SLICE):
            rows = base["_vector"].iloc[start : start + BASE_SLICE]
            search.add(keys.slice(start, BASE_SLICE), pa.array(rows, type=vector))
        return pd.DataFrame(search.pairs(), columns=COLUMNS)

    return run


def _bucket_ids(cells: np.ndarray) -> np.ndarray:
    """One number for a cell of a table; ``cells`` is (row, table, projection), whole numbers."""
    ids = np.broadcast_to(np.arange(cells.shape[1], dtype=np.uint64), cells.shape[:2]).copy()
    for j in range(cells.shape[2]):
        ids = (ids ^ (ids >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, j].astype(np.int64).view(np.uint64)
    return ids.view(np.int64)


def _places(vectors: pa.Array, planes: np.ndarray, length: float) -> tuple[np.ndarray, np.ndarray]:
    """Valid flags, and projections of the valid vectors in units of a bucket: (row, table, projection)."""
    valid, matrix = _matrix(vectors)
    if len(matrix) and matrix.shape[1] != planes.shape[2]:
        raise ValueError("vectors differ in length")
    return valid, np.einsum("rd,twd->rtw", matrix, planes) / length


def spread_of(planes: np.ndarray):
    """Task function: number, sum and sum of squares of all projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(3)
        for batch in batches:
            _, places = _places(batch.column(0), planes, 1.0)
            sums += (places.size, places.sum(), (places * places).sum())
        yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in sums], ["n", "sum", "squares"])

    return run


def hash_rows(planes: np.ndarray, length: float):
    """Task function: name, vector and the bucket of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, places = _places(batch.column(1), planes, length)
            ids = _bucket_ids(np.floor(places))
            rows = batch.filter(pa.array(valid))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * ids.shape[1], pa.int32()), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), lists], ["_name", "_vector", "_buckets"])

    return run


def probe_rows(planes: np.ndarray, length: float):
    """Task function: name, vector, and the buckets next to it in every table with their margins.

    A neighbouring bucket lies beyond one bound or two; its margin is the distance to them, in buckets.
    """
    width = planes.shape[1]
    single = [{j: step} for j in range(width) for step in (-1, 1)]
    double = [{**a, **b} for i, a in enumerate(single) for b in single[i + 1 :] if a.keys() != b.keys()]
    moves = [{}, *single, *double]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, places = _places(batch.column(1), planes, length)
            cells = np.floor(places)
            low, ids, margins = places - cells, [], []
            for move in moves:
                moved, margin = cells.copy(), np.zeros(cells.shape[:2])
                for j, step in move.items():
                    moved[:, :, j] += step
                    margin += np.square(low[:, :, j] if step < 0 else 1 - low[:, :, j])
                ids.append(_bucket_ids(moved))
                margins.append(np.sqrt(margin))
            ids, margins = np.concatenate(ids, axis=1), np.concatenate(margins, axis=1)
            rows = batch.filter(pa.array(valid))
            cuts = pa.array(np.arange(len(ids) + 1) * ids.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(values.ravel())) for values in (ids, margins)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *lists], ["_name", "_vector", "_buckets", "_margins"])

    return run
