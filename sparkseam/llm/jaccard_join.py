"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the hashes of its distinct five-word shingles. Two sets of sizes a <= b link when
9 * |intersection| >= 4 * (a + b) (similarity of 0.8), so their symmetric difference is at most H(a + b) =
(a + b) - 2 * ceil(4 (a + b) / 9) elements.

Sizes fall into bands. For the band of the larger set, all shingles are dealt by hash into m segments; a set takes part
in its own band and, as the smaller partner, in the next one where that holds sizes up to 1.25 times its own. Two
indexes are costed for every band and the cheaper one is taken:

* exact segments: a set emits the hashes of its H + 1 cheapest segments. A segment's cost is the sampled frequency of
  its rarest shingle (empty segments cost most), ties by number, so it follows from the content alone. Of the segments
  that two linked sets have in common, the cheapest has at most H others before it in either set: both emit it.
* one-deletion neighbourhoods (small sets): m = H // 2 + 1 segments; one of them differs by one element at most. A set
  emits every segment's hash and the hashes without each one of its elements.

Frequencies come from a bounded sample (about SAMPLE_DOCS documents, SAMPLE_SHINGLES counts) and steer cost only: any
values give the same links.

Sets with equal elements are one node from the start, so exact copies cost nothing. Each map task groups its own
signatures and sends one row for each, so no group at a reducer exceeds the number of map flushes, whatever the number
of copies. A group yields pairs with its smallest node (a star); verified stars merge into components, and only groups
whose members are in different components get further rounds: other star centres first, then pairs across components
that sizes and odd bits allow. A group of more than BLOCK members is dealt in blocks, each pair of blocks a key of its
own, so no task holds a large group. No link between different sets can be lost: every pair of a group is either verified or inside one
component. Pairs are verified on the whole sets.

Defined results: null, empty and wordless texts have no shingles and link with nothing; fewer than five words make one
shingle of the whole sequence. Repeated rows are copies. Null ids are allowed. Ids may be of any type that orders; ids
other than whole numbers are represented by 64-bit hashes inside. Of rows that repeat an id each is judged by its own
text. There are no ties to settle: links are exact and the smallest id names a component. Very long texts are read whole;
one text's set must fit a task. An empty table gives an empty result. Only the id and the text are read, so other
columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkseam.llm.batches import give_back
from sparkseam.llm.shard_table import free_name
from sparkseam.session import materialise

SHINGLE = 5
#: Documents sampled for frequent shingles (one is frequent in FREQUENT of them), ids that are broadcast at most.
SAMPLE_DOCS, FREQUENT, BROADCAST_IDS, SAMPLE_SHINGLES = 16_384, 3, 1_000_000, 1_000_000
#: Members of a signature that are compared in one task.
BLOCK = 512
EMPTY = 2**40
#: Links united in one task (16 bytes each).
SMALL_LINKS = 200_000
BAND, FLUSH_ROWS, CHUNK_BYTES, STAR_ROUNDS, STAR_SIZE, ODD_BITS = 1.6, 500_000, 600_000, 1, 8, 1024
U = np.uint64
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = U(0x9E3779B97F4A7C15)
_POS = _RNG.integers(1, 2**63, SHINGLE + 1, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class Powers:
    """Powers of the base and of its inverse, grown as texts need them."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = U(pow(int(_BASE), -1, 2**64))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b))]) for b in (_BASE, inverse))
        return self.up, self.down


_POWERS = Powers()


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of texts (UTF-8 bytes data, text i at offsets[i]:offsets[i + 1]), sorted within each text, and their number for each text."""
    n = len(offsets) - 1
    offsets = offsets - offsets[0]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    space = _SPACE[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True  # a text begins here
    before = np.append(True, space[:-1]) | first[:-1]
    after = np.append(space[1:], True) | first[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    up, down = _POWERS.get(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.append(U(0), np.cumsum(_BYTE[data] * up[: len(data)]))
        word = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        at = np.searchsorted(starts, offsets)  # words of text i are at[i]:at[i + 1]
        count = np.diff(at)
        shingle = np.zeros(len(word), np.uint64)
        if len(word) >= SHINGLE:
            shingle[: len(word) - SHINGLE + 1] = sum(word[k : len(word) - SHINGLE + 1 + k] * _POS[k] for k in range(SHINGLE))
        for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
            own = word[at[i] : at[i + 1]]
            shingle[at[i]] = (own * _POS[: len(own)]).sum() + _POS[SHINGLE] * U(len(own))
        shingle = mix(shingle, 1)
    sets = [np.unique(shingle[a : a + max(c - SHINGLE + 1, 1)]) if c else shingle[:0] for a, c in zip(at[:-1].tolist(), count.tolist(), strict=True)]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.array([len(s) for s in sets], np.int64)


def chunks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sets, sizes) of about CHUNK_BYTES of text each."""
    col = batch.column(column).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if len(col) and col.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        yield row, end, *shingle_sets(data[offsets[row] : offsets[end]], offsets[row : end + 1])
        row = end


def node_ids(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each set, the same for equal sets only; 0 for empty ones."""
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1][full]
        with np.errstate(over="ignore"):
            out[full] = mix(np.add.reduceat(mix(sets, 2), starts) + mix(np.bitwise_xor.reduceat(mix(sets, 3), starts), 4) + sizes[full].astype(np.uint64))
    return np.where(full & (out == 0), U(1), out)


# ---- the index


def most_apart(total: np.ndarray) -> np.ndarray:
    """The largest symmetric difference of two linked sets with at most this many elements together."""
    total = np.asarray(total, np.int64)
    return np.max([np.maximum(0, (t := np.maximum(total - k, 0)) - 2 * ((4 * t + 8) // 9)) for k in range(9)], axis=0)


@dataclass(frozen=True)
class Band:
    """Sizes lo to hi - 1 of the larger set; segments; whether sets emit one-deletion neighbourhoods."""

    lo: int
    hi: int
    segments: int
    delete: bool


def allocate(lo: int, hi: int) -> Band:
    """The cheaper index of a band: rows for a mean set plus 50 for every expected chance match, where three of ten shingles are widely shared."""
    far, n = int(most_apart(2 * (hi - 1))), (lo + hi) / 2
    exact, half = -(-(far + 1) * 6 // 5), far // 2 + 1
    cost = {False: (far + 1) * (1 + 50 * 0.3 ** (n / exact)), True: (half + n) * (1 + 50 * 0.3 ** max(0.0, n / half - 1))}
    delete = cost[True] < cost[False]
    return Band(lo, hi, half if delete else exact, delete)


def bands(largest: int) -> list[Band]:
    """Bands for sizes from 4 (smaller sets link with equal sets only) up to 1.25 times the largest."""
    out, lo = [], 4
    while lo <= largest * 5 // 4 + 1:
        hi = max(lo + 1, int(lo * BAND))
        out.append(allocate(lo, hi))
        lo = hi
    return out


def signatures(sets: np.ndarray, sizes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) for all sets."""
    plan = bands(int(sizes.max(initial=0)))
    if not plan:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    edges = np.array([b.lo for b in plan])
    seen = np.zeros(len(sets), dtype=np.int64)
    known, counts = frequent
    if len(known):
        bloom = np.zeros(2**20, dtype=bool)
        bloom[known >> U(44)] = True
        maybe = np.flatnonzero(bloom[sets >> U(44)])
        at = np.minimum(np.searchsorted(known, sets[maybe]), len(known) - 1)
        seen[maybe] = np.where(known[at] == sets[maybe], counts[at], 0)
    own = np.searchsorted(edges, sizes, side="right") - 1
    upper = np.searchsorted(edges, sizes * 5 // 4, side="right") - 1
    starts = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for band, rows in ((b, np.flatnonzero((own == b) if second == 0 else (upper == b) & (own < b) & (sizes >= 4))) for b in range(len(plan))
        for second in (0, 1)):
        if not len(rows):
            continue
        spec = plan[band]
        m = spec.segments
        pick = np.zeros(len(sizes), dtype=bool)
        pick[rows] = True
        inside = np.flatnonzero(pick[owner])
        place = np.zeros(len(sizes), np.int64)
        place[rows] = np.arange(len(rows))
        u = sets[inside]
        cell = place[owner[inside]] * m + ((mix(u, 5 + band) >> U(11)) % U(m)).astype(np.int64)
        value = mix(u, 1000)
        content = np.zeros(len(rows) * m, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(content, cell, value)
            name = mix(np.arange(m, dtype=np.uint64) + U(band * 2**32), 1001)
            if spec.delete:
                keys.append(mix(content + np.tile(name, len(rows)), 1002))
                owners.append(np.repeat(rows, m))
                keys.append(mix(content[cell] - value + name[cell % m], 1002))
                owners.append(owner[inside])
                continue
            # cost of a segment: how often the sample saw its rarest shingle; empty ones come last
            price = np.where(np.bincount(cell, seen[inside] == 0, minlength=len(content)) > 0, 0, EMPTY)
            dear = np.flatnonzero(price[cell] == EMPTY)
            np.minimum.at(price, cell[dear], seen[inside][dear])
            far = most_apart(sizes[rows] + np.minimum(sizes[rows] * 5 // 4, spec.hi - 1))
            order = np.argsort(price.reshape(len(rows), m) * m + np.arange(m), axis=1)
            chosen = np.zeros((len(rows), m), dtype=bool)
            np.put_along_axis(chosen, order, np.arange(m) <= far[:, None], axis=1)
            take = chosen.ravel()
            keys.append(mix(content + np.tile(name, len(rows)), 1002)[take])
            owners.append(np.repeat(rows, m)[take])
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


PAIR, MEMBER, DOC, SIGNATURE = 1, 2, 3, 0
ROW = "key long, kind byte, a long, b long, n long"


def _rows(kind: int, key: np.ndarray, a, b: np.ndarray, n: np.ndarray | None = None) -> pa.RecordBatch:
    size = len(key)
    a = a if isinstance(a, pa.Array) else pa.array(a.view(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(np.full(size, kind, np.int8)), a, pa.array(b.view(np.int64)),
            pa.array(n if n is not None else np.zeros(size, np.int64))],
        names=["key", "kind", "a", "b", "n"],
    )


def grouped(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[pa.RecordBatch]]:
    """Signatures once each with their smallest node, and the pairs and members of those that several nodes share."""
    if not len(sig):
        return sig, node, []
    by = np.lexsort((node, sig))
    sig, node = sig[by], node[by]
    fresh = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))
    sig, node = sig[fresh], node[fresh]
    head = np.append(True, sig[1:] != sig[:-1])
    starts = np.flatnonzero(head)
    counts = np.diff(np.append(starts, len(sig)))
    hub = np.repeat(node[starts], counts)
    pairs = np.unique(np.stack([hub[~head], node[~head]]), axis=1) if not head.all() else np.zeros((2, 0), np.uint64)
    many = np.repeat(counts, counts) >= 2
    out = []
    if pairs.shape[1]:
        out.append(_rows(PAIR, mix(pairs[0] ^ mix(pairs[1], 7), 8), pairs[0], pairs[1]))
    if many.any():
        out.append(_rows(MEMBER, mix(sig[many] ^ mix(node[many], 9), 10), sig[many], node[many]))
    return sig[starts], node[starts], out


def index_rows(docs: DataFrame, id_col: str, text_col: str, frequent) -> DataFrame:
    """Rows of the four kinds, from one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, met = 0, set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sig, node, more = grouped(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                yield from more
                for at in range(0, len(sig), 200_000):
                    yield _rows(SIGNATURE, sig[at : at + 200_000], node[at : at + 200_000], np.zeros(len(sig[at : at + 200_000]), np.uint64))

        for batch in batches:
            for row, end, sets, sizes in chunks(batch, 1):
                nodes = node_ids(sets, sizes)
                yield _rows(DOC, mix(nodes ^ mix(np.arange(row, end, dtype=np.uint64), 11), 12), batch.column(0).slice(row,
                    end - row).cast(pa.int64()), nodes, sizes)
                # equal sets of a flush have equal signatures: one of them is enough
                new = np.zeros(len(sizes), dtype=bool)
                for i, x in enumerate(nodes.tolist()):
                    if x and x not in met:
                        met.add(x)
                        new[i] = True
                sets = sets[np.repeat(new, sizes)]
                sig, of = signatures(sets, sizes[new], known)
                held.append((sig, nodes[new][of]))
                size += len(sig)
                if size >= FLUSH_ROWS:
                    yield from flush()
                    held, size, met = [], 0, set()
        yield from flush()
        give_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ROW)


def candidates(rows: DataFrame) -> DataFrame:
    """Signatures of all map tasks meet; what several nodes share becomes pairs and members, other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, node = [], []
        for batch in batches:
            kind = batch.column(1).to_numpy()
            own = kind == SIGNATURE
            sig.append(batch.column(0).to_numpy()[own].view(np.uint64))
            node.append(batch.filter(pa.array(own)).column(2).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            if not own.all():
                yield batch.filter(pa.array(~own))
        if sig and sum(map(len, sig)):
            yield from grouped(np.concatenate(sig), np.concatenate(node))[2]
        del sig, node
        give_back()

    return rows.repartition("key").mapInArrow(run, ROW)


def frequent_shingles(docs: DataFrame, text_col: str, sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles in FREQUENT or more of about `sample` documents, and in how many."""
    share = min(1.0, sample / max(1, docs.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, _ in chunks(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(sets.view(np.int64))], names=["s"])

    # chosen by row, not by id: null or repeated ids are sampled like others
    some = docs.select(text_col).sample(share, 20).mapInArrow(run, "s long")
    found = some.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "s").limit(SAMPLE_SHINGLES).collect()
    known, counts = np.array([r[0] for r in found], dtype=np.int64).view(np.uint64), np.array([r[1] for r in found], dtype=np.int64)
    by = np.argsort(known)
    return known[by], counts[by]


# ---- verification and components


def whole_sets(docs: DataFrame, id_col: str, text_col: str, reps: DataFrame) -> DataFrame:
    """node, n, odd, shingles (sorted, eight bytes each). reps: _rep (an id), node.

    odd: for each of ODD_BITS hash buckets whether the set has an odd number of shingles there. Two sets differ in at
    least as many elements as their odd bits differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, sizes in chunks(batch, 0):
                nodes, ends = node_ids(sets, sizes), np.cumsum(sizes)
                bucket = (mix(sets, 13) % U(ODD_BITS)).astype(np.int64) + np.repeat(np.arange(len(sizes)) * ODD_BITS, sizes)
                odd = np.packbits(np.bincount(bucket, minlength=len(sizes) * ODD_BITS) & 1).view(np.int64).reshape(len(sizes), -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(list(odd), pa.list_(pa.int64())),
                        pa.array([sets[e - s : e].tobytes() for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())],
                    names=["node", "n", "odd", "shingles"],
                )
        give_back()

    n = reps.count()
    reps = reps.select("_rep", F.col("node").alias("_node"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    got = texts.join(F.broadcast(reps) if n <= BROADCAST_IDS else reps, texts["_id"].eqNullSafe(reps["_rep"])).select("_text").mapInArrow(run,
        "node long, n long, odd array<long>, shingles binary")
    # repeated ids may bring other texts along
    return got.dropDuplicates(["node"])


def may_link() -> Column:
    """Whether sizes (_pn, _qn) and odd bits (_podd, _qodd) allow a link."""
    both = F.col("_pn") + F.col("_qn")
    apart = F.aggregate(F.zip_with("_podd", "_qodd", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    return (5 * F.least("_pn", "_qn") >= 4 * F.greatest("_pn", "_qn")) & (apart <= both - 2 * F.ceil(4 * both / 9))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 5 * min(len(p), len(q)) < 4 * max(len(p), len(q)):
                    continue
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                keep[i] = 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        give_back()

    slim = sets.select("node", "n", "odd")
    pairs = pairs.join(slim.withColumnsRenamed({"node": "b", "n": "_qn", "odd": "_qodd"}), "b").join(slim.withColumnsRenamed({"node": "a", "n": "_pn",
        "odd": "_podd"}), "a").filter(may_link()).select("a", "b")
    pairs = materialise(pairs, "likely")
    # only sets of likely pairs are moved
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    own = sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "node", "left_semi")
    x, y = own.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), own.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


def across(members: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """_p, _q: the pairs of different components that share a signature and may link by sizes and odd bits.

    A group of `many` members is dealt by hash into many / block blocks; a member is sent once for each block it meets,
    on the left with its own block first, on the right with it second, so each pair meets under one key.
    """
    rows = members.select("sig", "many", "node", "comp").join(sets.select("node", "n", "odd"), "node")
    blocks = F.ceil(F.col("many") / block).cast("int")
    own, other = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    kept = lambda side: [F.col(c).alias(f"_{side}{c}") for c in ("node", "comp", "n", "odd")]
    x = rows.select("sig", *kept("p"), own.alias("_i"), other.alias("_j"))
    y = rows.select(F.col("sig").alias("_sig"), *kept("q"), other.alias("_k"), own.alias("_l"))
    fits = (F.col("_pnode") < F.col("_qnode")) & (F.col("_pcomp") != F.col("_qcomp")) & may_link()
    met = (F.col("sig") == F.col("_sig")) & (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l"))
    return x.join(y, met & fits).select(F.col("_pnode").alias("_p"), F.col("_qnode").alias("_q"))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by smallest node over one task's links."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "comp"])


def components(links: DataFrame, small: int = SMALL_LINKS) -> DataFrame:
    """node, comp (the smallest node it reaches).

    Up to `small` links are united in one task of that bounded size; beyond it, alternating large and small stars run on
    all executors, and only minima are aggregated.
    """
    links = materialise(links.select("a", "b"), "united")
    if links.count() <= small:
        return materialise(links.coalesce(1).mapInArrow(united, "node long, comp long"), "comp")
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    edges, before = materialise(both, "edges"), None
    while True:
        # large star: the larger neighbours of a node go to its smallest neighbour
        low = edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edges.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, go to the smallest of them
        large = materialise(large, "large")  # here a > b
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "m").filter("x <> m").select(F.col("x").alias("a"),
            F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        small = materialise(small, "small")  # a > b
        state = small.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            return small.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = state
        edges = small.select("a", "b").unionByName(small.select(F.col("b").alias("a"), F.col("a").alias("b")))


def few(rows: DataFrame) -> DataFrame:
    """A written table of one or two numbers a row, broadcast up to BROADCAST_IDS rows: what it meets then stays where it is, hot keys too."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def merged(comp: DataFrame, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """comp with the components joined that a linking pair connects."""
    side = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}"))
    split = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    found = materialise(verify(split, sets), "found")
    if found.isEmpty():
        return comp
    # components so far are links to their smallest node, so earlier links needn't be walked again
    return components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(found))


WHOLE = ("tinyint", "smallint", "int", "bigint")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id, _node, _comp (null without shingles) of every row.

    _node stands for a set, _comp for a component: with repeated ids two components may have the same smallest id.
    """
    if docs.schema[id_col].dataType.simpleString() not in WHOLE:
        return _linked_by_hash(docs, id_col, text_col)
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, text_col))
    rows = materialise(candidates(index_rows(docs, id_col, text_col, frequent)), "index")
    of_doc = rows.filter(F.col("kind") == DOC).select(F.col("a").alias("_id"), F.col("b").alias("node"), "n")
    pairs = rows.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    members = rows.filter(F.col("kind") == MEMBER).select(F.col("a").alias("sig"), F.col("b").alias("node")).distinct()
    nodes = of_doc.filter("n > 0").groupBy("node").agg(F.min("_id").alias("_rep"))
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialise(whole_sets(docs, id_col, text_col, materialise(nodes.join(wanted, "node"), "wanted")), "sets")
    # a pair for each node first; of the others only those that aren't in one component by then
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    comp = components(verify(first, sets))
    comp = merged(comp, pairs, sets)
    # groups of two are settled by their only pair
    large = materialise(members.groupBy("sig").agg(F.count(F.lit(1)).alias("many")).filter("many > 2"), "large")
    members = materialise(members.join(few(large), "sig"), "members")
    for turn in range(STAR_ROUNDS + 1):
        named = members.join(comp, "node", "left").select("sig", "many", "node", F.coalesce("comp", "node").alias("comp"))
        open_ = materialise(named.groupBy("sig").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo <> _hi").select("sig"), f"sig{turn}")
        named = materialise(named.join(few(open_), "sig"), f"open{turn}")
        if named.isEmpty():
            break
        if turn < STAR_ROUNDS:
            # salted stars: in every group each node meets a few others by chance, so a group of near copies soon is one component
            salted = named.withColumn("_s", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("many") / STAR_SIZE)))
            hubs = salted.groupBy("sig", "_s").agg(F.min(F.struct(F.xxhash64("node", "sig", F.lit(turn)).alias("h"), F.col("node").alias("_p"),
                F.col("comp").alias("_own"))).alias("_hub"))
            more = salted.join(hubs, ["sig", "_s"]).filter(F.col("comp") != F.col("_hub._own")).select(F.col("_hub._p").alias("_p"), F.col("node").alias("_q"))
        else:
            more = across(named, sets)
        more = more.select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b")).distinct()
        comp = merged(comp, materialise(more, f"pairs{turn}"), sets)
    names = nodes.join(comp, "node", "left").select("node", "_rep", F.coalesce("comp", "node").alias("comp"))
    least = names.groupBy("comp").agg(F.min("_rep").alias("component_id"))
    names = names.join(least, "comp").select("node", "component_id", "comp")
    # a row without shingles is a component of its own; its node is none
    out = of_doc.select("_id", F.when(F.col("n") > 0, F.col("node")).alias("node"), "n").join(names, "node", "left")
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(
        F.col("_id")).alias("component_id"), F.col("node").alias("_node"), F.col("comp").alias("_comp"))


def _linked_by_hash(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """linked() for ids of any type: rows are linked under hashes of the ids, and the smallest id is found afterwards."""
    rows = docs.select(F.col(id_col).alias("_name"), F.xxhash64(F.col(id_col).cast("string")).alias("_hash"), F.col(text_col).alias("_text"))
    names = rows.select("_name", "_hash").distinct()
    out = linked(rows, "_hash", "_text").join(names, "_hash")
    least = out.filter("_comp is not null").groupBy("_comp").agg(F.min("_name").alias("_least"))
    out = out.join(least, "_comp", "left")
    return out.select(F.col("_name").alias(id_col), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("_name")).alias(
        "component_id"), "_node", "_comp")


def with_nodes(docs: DataFrame, text_col: str, node: str) -> DataFrame:
    """docs with a column `node`, the number of each row's set (null without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for row, end, sets, sizes in chunks(batch, at):
                nodes = node_ids(sets, sizes)
                yield batch.slice(row, end - row).append_column(node, pa.array(nodes.view(np.int64), mask=nodes == 0))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(node, LongType())]))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when each component keeps one document: its smallest id's (a null id comes last).

    Rows without shingles link with nothing and all stay. Of rows that repeat an id, those whose text is in another
    component's set go by their text; of rows that repeat an id and a set the one with the smallest text (and then the
    smallest other columns) stays.
    """
    rows = materialise(linked(docs, id_col, text_col).select(F.col(id_col).alias("_id"), "_node", "_comp"), "linked")
    first = rows.filter("_comp is not null").groupBy("_comp").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"),
        F.col("_node").alias("node"))).alias("_f"))
    first = first.select(F.col("_f")["id"].alias("_stay"), F.col("_f")["node"].alias("_stay_node"))
    stay = materialise(first.unionByName(rows.filter("_comp is null").select(F.col("_id").alias("_stay"), F.col("_node").alias("_stay_node"))), "stay")
    repeated = materialise(rows.groupBy("_id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(F.col("_id").alias("_again")), "repeated")
    own = few(stay)
    same = docs[id_col].eqNullSafe(stay["_stay"])
    if repeated.isEmpty():
        return docs.join(own, same, "left_semi")
    again = few(repeated)
    single = docs.join(again, docs[id_col].eqNullSafe(repeated["_again"]), "left_anti").join(own, same, "left_semi")
    node = free_name("_node", docs.columns)
    more = with_nodes(docs.join(again, docs[id_col].eqNullSafe(repeated["_again"]), "left_semi"), text_col, node)
    more = more.join(own, more[id_col].eqNullSafe(stay["_stay"]) & more[node].eqNullSafe(stay["_stay_node"]), "left_semi")
    rest = [c for c in docs.columns if c != text_col]
    set_of, key, kept = F.col(node), free_name("_key", [node]), free_name("_best", [node])
    best = more.filter(set_of.isNotNull()).groupBy(F.col(id_col).alias(key), node).agg(F.min(F.struct(text_col, *rest)).alias(kept))
    return single.unionByName(best.select(*[F.col(kept)[c].alias(c) for c in docs.columns])).unionByName(more.filter(set_of.isNull()).select(*docs.columns))



def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) as g from d where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * k >= 80 * (a.n + b.n - k)),
e as (select x, y from l union select y, x from l),
r(id, reach) as (select doc_id, doc_id from d union select id, y from r join e on x = reach)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from d left join n using (doc_id) join (select id, min(reach) as component_id from r group by id) m on m.id = d.doc_id
"""
