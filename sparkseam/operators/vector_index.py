"""An exact vector index: cells around pivots, kept as a partitioned table, and bounds that let a query skip cells.

Pivots are centres of a spherical k-means over a bounded sample. Every vector, at length one, lies in the cell of the
pivot with the largest dot product, and a cell knows the least and largest dot product of its members with its pivot.
For a query q and a member v of a cell with pivot c:

* angles: angle(q, v) >= |angle(q, c) - angle(v, c)|;
* ball:   q.v <= q.c + |v - c|, and |v - c|^2 = 1 + |c|^2 - 2 v.c.

The smaller of both is the cell's bound, so a cell whose bound is below a query's k-th best score so far can't hold one
of its k best, and isn't read. Results are those of a scan of all vectors, whatever the pivots.

Stored are `pivots`, `cells` (one row for each segment and cell: rows, least, largest dot product), `vectors` (written by
cell, so that a query's cells are the folders it reads) and `gone` (ids that were removed, with the segment from which
they are). add() appends a segment; an id added again replaces the old row, as the latest segment of an id counts.
Pivots and the summed cells are bounded (MOST_CELLS), and alone of all tables are read by the driver.

Null ids and null vectors aren't stored. A zero vector has the score 0 to all. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.operators.search import QUERY_BLOCK, ranked
from sparkseam.session import exists, materialise, published, remove

#: Cells at most, vectors that pivots are fitted on, rounds of the fit, vectors scored at once.
MOST_CELLS, SAMPLE, ROUNDS, BLOCK = 1024, 8192, 6, 4096
#: Scores are rounded to so many digits; bounds get this much on top for rounding.
DIGITS, SLACK = 6, 1e-6


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; zero rows stay zero."""
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-10)


def centres(sample: np.ndarray, cells: int) -> np.ndarray:
    """Means of the groups of a spherical k-means over unit rows; first centres by farthest points, so the fit is the same each time."""
    at, near = [0], sample @ sample[0]
    while len(at) < min(cells, len(sample)):
        at.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[at[-1]])
    out = sample[at]
    for _ in range(ROUNDS):
        own = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(out))[:, None]
        out = np.where(n > 0, sums / np.maximum(n, 1), out)
    return out


def bounds(queries: np.ndarray, pivots: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """The highest dot product of each unit query with any member of each cell."""
    length = np.maximum(np.linalg.norm(pivots, axis=1), 1e-10)
    dots = queries @ pivots.T
    angle = np.arccos(np.clip(dots / length, -1, 1))
    near, far = np.arccos(np.clip(largest / length, -1, 1)), np.arccos(np.clip(least / length, -1, 1))
    apart = np.maximum(0, np.maximum(angle - far, near - angle))
    ball = dots + np.sqrt(np.maximum(0, 1 + length**2 - 2 * least))
    return np.minimum(np.cos(np.minimum(apart, np.pi)), ball) + SLACK


def packed(ids: np.ndarray, *numbers: np.ndarray) -> list[bytes]:
    return [ids.astype(np.int64).tobytes(), *(np.ascontiguousarray(n, dtype=np.float64).tobytes() for n in numbers)]


class VectorIndex:
    """vectors: id_col (a whole number) and an array column, in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.folder, self.id_col, self.vector_col = spark, folder.rstrip("/"), id_col, vector_col

    # ---- building

    def _usable(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.col(self.id_col).isNotNull() & F.col(self.vector_col).isNotNull())

    def build(self, vectors: DataFrame, cells: int | None = None) -> None:
        """Fits pivots (about the square root of the rows, MOST_CELLS at most, unless given) and stores all vectors as segment 0."""
        self.clear()
        rows = self._usable(vectors)
        n = rows.count()
        sample = rows.orderBy(F.xxhash64(self.id_col), self.id_col).limit(SAMPLE).select(self.vector_col).collect()
        wanted = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        fitted = centres(units(np.array([r[0] for r in sample], dtype=np.float64)), wanted) if sample else np.zeros((0, 0))
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(fitted)], "cell int, centre array<double>").coalesce(1).write.mode(
            "overwrite").parquet(f"{self.folder}/pivots")
        if n:
            self._write(rows, fitted, 0)

    def add(self, vectors: DataFrame) -> None:
        """Stores rows under the pivots of build(); rows of an id that is there already give way."""
        pivots = self._pivots()
        if not len(pivots):
            return self.build(vectors)
        self._write(self._usable(vectors), pivots, self.segments())

    def remove(self, ids: DataFrame) -> None:
        rows = ids.select(F.col(self.id_col).cast("long").alias(self.id_col)).distinct()
        segment = self.segments()
        rows.write.mode("overwrite").parquet(f"{self.folder}/gone/segment={segment}")
        self._cells([], segment)

    def clear(self) -> None:
        remove(self.spark, self.folder)

    def _write(self, rows: DataFrame, pivots: np.ndarray, segment: int) -> None:
        others = [c for c in rows.columns if c not in (self.id_col, self.vector_col, "cell", "segment")]

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    unit = units(np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                    dots = unit @ pivots.T
                    own = dots.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.int32()), pa.array(dots[np.arange(len(own)), own])],
                        names=[*part.schema.names, "cell", "dot"])

        chosen = rows.select(F.col(self.id_col).cast("long").alias(self.id_col), F.col(self.vector_col).cast("array<double>").alias(self.vector_col), *others)
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema)
        path = f"{self.folder}/vectors/segment={segment}"
        remove(self.spark, f"{self.folder}/gone/segment={segment}")  # of a removal that broke off
        # a large cell is dealt over many tasks, as the ids' hash takes part
        cells = max(1, len(pivots))
        dealt = chosen.mapInArrow(place, f"{kind}, cell int, dot double").repartition("cell", F.pmod(F.xxhash64(self.id_col), F.lit(max(1, 64 // cells))))
        dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
        stats = self.spark.read.parquet(path).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("dot").alias("least"), F.max("dot").alias("largest"))
        self._cells([(r["cell"], r["n"], r["least"], r["largest"]) for r in stats.collect()], segment)

    def _cells(self, rows: list[tuple], segment: int) -> None:
        """The last step of a change: vectors of a segment that isn't named here count for nothing."""
        self.spark.createDataFrame(rows, "cell int, n long, least double, largest double").coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/cells/segment={segment}")

    # ---- reading

    def segments(self) -> int:
        return published(self.spark, f"{self.folder}/cells")

    def _stats(self) -> DataFrame | None:
        path = f"{self.folder}/cells"
        return self.spark.read.schema("cell int, n long, least double, largest double, segment int").parquet(path) if self.segments() else None

    def _pivots(self) -> np.ndarray:
        path = f"{self.folder}/pivots"
        rows = sorted(self.spark.read.parquet(path).collect()) if exists(self.spark, path) else []
        return np.array([r["centre"] for r in rows], dtype=np.float64)

    def cells(self) -> tuple[np.ndarray, ...]:
        """Numbers, pivots, rows, least and largest dot product of the cells that hold vectors."""
        stats, pivots = self._stats(), self._pivots()
        rows = [] if stats is None else stats.groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"),
            F.max("largest").alias("largest")).orderBy("cell").collect()
        number = np.array([r["cell"] for r in rows], dtype=np.int64)
        return number, pivots[number] if len(number) else pivots, *(np.array([r[c] for r in rows], dtype=np.float64) for c in ("n", "least", "largest"))

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """The rows that count, of all or some cells."""
        rows = self.spark.read.parquet(f"{self.folder}/vectors").filter(F.col("segment") < self.segments())
        if cells is not None:
            rows = rows.filter(F.col("cell").isin([int(c) for c in cells]))
        if self.segments() > 1:
            every = self.spark.read.parquet(f"{self.folder}/vectors").filter(F.col("segment") < self.segments())
            last = every.groupBy(self.id_col).agg(F.max("segment").alias("segment"))
            rows = rows.join(last, [self.id_col, "segment"], "left_semi")
            if exists(self.spark, f"{self.folder}/gone"):
                gone = self.spark.read.parquet(f"{self.folder}/gone").filter(F.col("segment") < self.segments())
                gone = gone.groupBy(F.col(self.id_col).alias("_gone")).agg(F.max("segment").alias("since"))
                rows = rows.join(gone, (F.col(self.id_col) == F.col("_gone")) & (F.col("segment") < F.col("since")), "left_anti")
        return rows

    # ---- one query

    def reached(self, query: list[float], k: int, where: dict | None = None) -> list[int]:
        """The cells that one query must read for its exact k best: read in the order of their bounds, twice as many rows each time, until the
        k-th best score is above all other bounds."""
        number, pivots, n, least, largest = self.cells()
        if not len(number):
            return []
        bound = bounds(units(np.array([query], dtype=np.float64)), pivots, least, largest)[0]
        order = np.argsort(-bound, kind="stable")
        rows, bound, number = np.cumsum(n[order]), bound[order], number[order]
        best: list[float] = []
        done, goal = 0, 2 * k
        while done < len(number) and not (len(best) == k and best[-1] > bound[done]):
            upto = min(len(number), max(done + 1, int(np.searchsorted(rows, goal)) + 1))
            if len(best) == k:  # no cell below the k-th score is read
                upto = min(upto, max(done + 1, int((bound >= best[-1]).sum())))
            found = self._scored(number[done:upto].tolist(), query, where).orderBy(F.desc("score")).limit(k).select("score").collect()
            best = sorted(best + [r[0] for r in found], reverse=True)[:k]
            done, goal = upto, 2 * max(goal, rows[upto - 1])
        return number[:done].tolist()

    def _scored(self, cells: list[int], query: list[float], where: dict | None) -> DataFrame:
        from sparkseam.operators.search import cosine, equal_to

        q = F.array(*[F.lit(float(x)) for x in query])
        return equal_to(self.vectors(cells), where or {}).withColumn("score", F.round(cosine(F.col(self.vector_col), q), DIGITS))

    def topk(self, query: list[float], k: int, where: dict | None = None) -> DataFrame:
        """The k best rows by cosine with score and rank, as search.vector_topk over all vectors."""
        return ranked(self._scored(self.reached(query, k, where), query, where), "score", k, self.id_col)

    # ---- many queries

    def batch_topk(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id_col, score, rank: the exact k best for every query.

        First each query meets the cells with the highest bounds that hold k rows between them; its k-th score there rules
        out other cells, and it meets those that are left. Queries travel as blocks for each cell and meet blocks of the
        cell's vectors, so neither a large cell nor a cell that many queries want is one task's work.
        """
        number, pivots, n, least, largest = self.cells()
        empty = self.spark.createDataFrame([], f"query_id long, `{self.id_col}` long, score double, rank int")
        if not len(number):
            return empty
        asked = self._usable(queries).select(F.col(self.id_col).cast("long").alias("query_id"), F.col(self.vector_col).cast("array<double>").alias("vector"))
        asked = materialise(asked.withColumn("bar", F.lit(None).cast("double")), "asked")
        if self.segments() > 1:  # rows that give way may stand in any cell, so cells' counts are no promise
            live = dict(self.vectors().groupBy("cell").count().collect())
            n = np.array([live.get(int(c), 0) for c in number], dtype=np.float64)

        def wanted(first: bool):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, QUERY_BLOCK):
                        part = batch.slice(at, QUERY_BLOCK)
                        unit = units(np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                        bound = bounds(unit, pivots, least, largest)
                        order = np.argsort(-bound, axis=1, kind="stable")
                        held = np.cumsum(n[order], axis=1)
                        home = np.zeros(bound.shape, bool)
                        np.put_along_axis(home, order, held - n[order] < k, axis=1)
                        bar = part.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                        take = home if first else ~home & (np.isnan(bar)[:, None] | (bound >= bar[:, None]))
                        q, c = np.nonzero(take)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(q)), part.column(1).take(pa.array(q)), pa.array(number[c].astype(np.int32))],
                            names=["query_id", "vector", "cell"])
            return run

        near = materialise(self._meet(asked.mapInArrow(wanted(True), "query_id long, vector array<double>, cell int"), k), "near")
        bars = self._best(near, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        left = asked.drop("bar").join(bars, "query_id", "left").select("query_id", "vector", "bar")
        far = self._meet(left.mapInArrow(wanted(False), "query_id long, vector array<double>, cell int"), k)
        return self._best(near.unionByName(far), k)

    def _best(self, pairs: DataFrame, k: int) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), self.id_col)
        return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def _meet(self, wanted: DataFrame, k: int) -> DataFrame:
        """query_id, id_col, score: for each block of queries and each block of vectors of a cell the k best of each query."""
        asked = wanted.repartition("cell", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions("cell").mapInArrow(
            blocks(QUERY_BLOCK), "cell int, ids binary, unit binary").withColumnsRenamed({"ids": "q_ids", "unit": "q_unit"})
        held = self.vectors().select(self.id_col, self.vector_col, "cell").sortWithinPartitions("cell").mapInArrow(blocks(BLOCK),
            "cell int, ids binary, unit binary")
        id_col = self.id_col

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for v, vu, q, qu in zip(*(batch.column(i) for i in range(4)), strict=True):
                    own, ids = np.frombuffer(v.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), np.int64)
                    rows, matrix = np.frombuffer(vu.as_buffer()).reshape(len(own), -1), np.frombuffer(qu.as_buffer()).reshape(len(ids), -1)
                    scores = np.round(matrix @ rows.T, DIGITS)
                    best = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(own[best].ravel()),
                        pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query_id", id_col, "score"])

        pairs = held.join(asked, "cell").select("ids", "unit", "q_ids", "q_unit")
        return pairs.mapInArrow(score, f"query_id long, `{id_col}` long, score double")


def blocks(size: int):
    """Rows (id, vector, cell) sorted by cell into rows (cell, ids, unit vectors) of at most `size` vectors of one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(2).to_numpy(zero_copy_only=False)
            turns = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)] if len(cell) else [0]
            for a, b in zip(turns, turns[1:], strict=False):
                for at in range(a, b, size):
                    part = batch.slice(at, min(size, b - at))
                    unit = units(np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64))
                    ids, matrix = packed(part.column(0).to_numpy(), unit)
                    yield pa.RecordBatch.from_arrays([part.column(2).slice(0, 1), pa.array([ids], pa.binary()), pa.array([matrix], pa.binary())],
                        names=["cell", "ids", "unit"])

    return run
