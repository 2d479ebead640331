r"""Periodic run detection over the words of a text.

A run is a stretch of words with smallest period q (words q apart are equal), at least max(LEAST, TIMES * q) words long,
that no neighbouring word extends with the same period. Words that stand q apart and are equal form a stretch of at
least s(q) = max(LEAST, TIMES * q) - q places, so one of every s(q) places lies in it: the places 0, s(q), 2 s(q), ... of
each period q form a harmonic grid with about n ln(n) / 3 points for n words.

All texts of a batch lie in one flat array of word numbers. For all (period, grid point) pairs at once, in blocks of
BLOCK, pairs with different words are dropped, and a binary search over prefix hashes (polynomial, modulo a prime) finds
the longest common extension of the pair in both directions. A hash may call different words equal, never equal ones
different, so no run is missed: every extension found is at least the true one. Runs are then deduplicated by place
(the smallest period stays) and compared word by word; should a hash have lied, the text's runs are found again by
comparing all words at every period.

The work of a text stays in one task, which holds one slice of texts (`batches.parts`) and one block of pairs; nothing
is shuffled, so hot groups and lost executors need no care.

Defined results: a null, empty or blank text has no words and no runs; its figures are null and its hashes those of the
empty string. Very long texts are read whole. Ties between runs for the greatest length / period: smallest start, then
smallest period. Repeated rows give equal rows, a null id stays null, an empty table gives an empty result. Only the
named columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.llm.batches import parts
from sparkseam.session import read_table

#: A run has at least LEAST words and TIMES times its period.
LEAST, TIMES = 6, 4
#: (period, grid point) pairs worked on at once.
BLOCK = 400_000
# Prefix hashes: a prime below 2^31 and a base.
PRIME, BASE = np.uint64(2_147_483_647), np.uint64(1_103_515_245)

Words = list[bytes]


def spacing(period: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Places in a row that must agree with those a period later."""
    return np.maximum(least, times * period) - period


def numbered(texts: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers in one array, and where each text begins and the last ends."""
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for words in texts for w in words), np.int64, sum(map(len, texts)))
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in texts], dtype=np.int64)])


class Prefixes:
    """Prefix hashes of an array; same(i, j, n): are the n numbers from i on those from j on (i <= j)?"""

    def __init__(self, flat: np.ndarray):
        self.power = np.ones(len(flat) + 1, np.uint64)
        done, step = 1, BASE
        while done < len(self.power):  # twice as many powers each time
            more = self.power[: len(self.power) - done][:done] * step % PRIME
            self.power[done : done + len(more)] = more
            done, step = 2 * done, step * step % PRIME
        terms = (flat.astype(np.uint64) + np.uint64(1)) % PRIME * self.power[:-1] % PRIME
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms) % PRIME])

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        a = (self.sums[i + n] + PRIME - self.sums[i]) % PRIME * self.power[j - i] % PRIME
        return a == (self.sums[j + n] + PRIME - self.sums[j]) % PRIME

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far the numbers from i and j on (back: those before them) agree, at most `most`; never too little."""
        low, high = np.zeros_like(most), most.copy()
        while (open_ := low < high).any():
            mid = (low + high + 1) // 2
            equal = self.same(i - mid, j - mid, mid) if back else self.same(i, j, mid)
            low, high = np.where(open_ & equal, mid, low), np.where(open_ & ~equal, mid - 1, high)
        return low


def grid(starts: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (text, period, place, words before it in its text, words from it on), a place for each grid point."""
    sizes = np.diff(starts)
    longest = np.where(sizes >= least, sizes // times, 0)
    at, texts = 0, len(sizes)
    while at < texts:
        # texts whose periods together stay in a block; a longer one has its periods cut
        upto = max(at + 1, int(np.searchsorted(np.cumsum(longest[at:]), BLOCK, "right")) + at)
        text = np.repeat(np.arange(at, upto), longest[at:upto])
        first = np.cumsum(longest[at:upto]) - longest[at:upto]
        period = np.arange(len(text)) - np.repeat(first, longest[at:upto]) + 1
        gap = spacing(period, least, times)
        points = -(-(sizes[text] - period) // gap)
        ends = np.cumsum(points)
        cut = 0
        while cut < len(text):
            last = max(cut + 1, int(np.searchsorted(ends, (ends[cut - 1] if cut else 0) + BLOCK, "right")))
            n = points[cut:last]
            inside = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(gap[cut:last], n)
            of, p = np.repeat(text[cut:last], n), np.repeat(period[cut:last], n)
            yield of, p, starts[of] + inside, inside, sizes[of] - inside
            cut = last
        at = upto


def slow_runs(flat: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of one text's runs, by comparing all words at every period."""
    out: dict[tuple[int, int], int] = {}
    for p in range(1, len(flat) // times + 1):
        equal = np.concatenate([[False], flat[:-p] == flat[p:], [False]])
        turn = np.flatnonzero(equal[1:] != equal[:-1])
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True):
            if b - a + p >= max(least, times * p):
                out.setdefault((a, b - a + p), p)
    return sorted((a, n, p) for (a, n), p in out.items())


def single(rows: np.ndarray) -> np.ndarray:
    """Of the rows (text, start, length, period) of one place the one with the smallest period."""
    rows = rows[np.lexsort(rows.T[::-1])]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    return rows[new]


def runs_of(texts: list[Words], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """For each text its runs as (start, length, period) by start, then period."""
    flat, starts = numbered(texts)
    found = [[] for _ in texts]
    if not len(flat):
        return found
    hashes, pieces = Prefixes(flat), []
    for text, period, place, before, after in grid(starts, least, times):
        hit = flat[place] == flat[place + period]
        text, period, place, before, after = (x[hit] for x in (text, period, place, before, after))
        right = hashes.extension(place, place + period, after - period, False)
        left = hashes.extension(place, place + period, before, True)
        long = left + right >= spacing(period, least, times)
        pieces.append(single(np.stack([text, before - left, left + right + period, period], axis=1)[long]))
    again = set()
    for text, start, length, period in single(np.concatenate(pieces)).tolist() if pieces else []:
        run = flat[starts[text] + start : starts[text] + start + length]
        if not np.array_equal(run[:-period], run[period:]):
            again.add(text)
        found[text].append((start, length, period))
    for text in again:  # a hash lied
        found[text] = slow_runs(flat[starts[text] : starts[text + 1]], least, times)
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    turn = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        turn[start + period] += 1
        turn[start + length] -= 1
    return np.cumsum(turn)[:n] == 0


def best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period."""
    top = None
    for run in runs:  # by start, then period
        if top is None or run[1] * top[2] > top[1] * run[2]:
            top = run
    return top


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: Callable[[object, Words], Words] | None = None, least: int = LEAST,
    times: int = TIMES) -> DataFrame:
    """id_col, n_words, runs (array of start, length, period by start, then period), best (one of them, or null), collapsed (the kept words joined by
    a space). edit(id, words) may change a text's words before."""
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def row(words: Words, runs: list[tuple[int, int, int]]) -> tuple:
        stay = kept(len(words), runs)
        rest = words if stay.all() else [w for w, s in zip(words, stay.tolist(), strict=True) if s]
        return len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], best(runs), b" ".join(rest).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            # bytes are split at the blanks of ASCII alone
            texts = [(t or "").encode().split() for t in batch.column(1).to_pylist()]
            if edit:
                texts = [edit(i, w) for i, w in zip(batch.column(0).to_pylist(), texts, strict=True)]
            rows = [row(w, r) for w, r in zip(texts, runs_of(texts, least, times), strict=True)]
            n, runs, top, rest = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            top = [t and dict(zip(("start", "length", "period"), t, strict=True)) for t in top]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(runs, pa.list_(run_type)), pa.array(top, run_type),
                pa.array(rest, pa.string())], names=[id_col, "n_words", "runs", "best", "collapsed"])

    one = "struct<start: bigint, length: bigint, period: bigint>"
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<{one}>, best {one}, collapsed string")


def periodic_tail(doc_id: object, words: Words) -> Words:
    """The contract's edit: in every tenth document, by crc32 of its id, the words from a place on repeat with a period."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(read_table(spark, sf_dir, "documents"), edit=periodic_tail)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = F.col("best")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"),
        top["period"].alias("period"), F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
