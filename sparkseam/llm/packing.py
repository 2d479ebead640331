"""Packing by lexical retrieval over a sharded BM25 inverted index.

All documents are tokenised once; the same pass gives each a content key and adds up document frequencies of all token
ids (as many numbers as the vocabulary has entries, whatever the corpus). Documents are then dealt by ranges of
(content key, row number), so that alike documents lie side by side, a hot key is cut like any other range, and every
range has about equally many rows. A range is read in order and cut into shards of about SHARD_TOKENS tokens; each is an
inverted index (token ids with BM25 weights from the corpus-wide statistics) of bounded size.

Within a shard documents are laid end to end in windows of `window` tokens, in chains of about CHAIN_WINDOWS windows side
by side: a window opens with the rest of the document that the last one cut, or else with the next unused document of
its chain's part of the shard. In each step all distinct token ids of every open window's first document query the
index, and the unused neighbours fill the windows, best first, the last one cut at the window's end; a document that
several windows want goes to the highest score. What remains at a chain's end is cut into powers of two, so no sequence
has padding.

The content key is (nearest of CLUSTERS centres, heaviest token id). Centres are fitted by spherical k-means on hashed
tf-idf vectors of a sample of about SAMPLE_DOCS documents; they choose the neighbourhood, and
every document is indexed whatever its key. A seed meets its own shard only: the work grows in proportion to the corpus. What
share of the corpus-wide best neighbours that reaches isn't measured.

Defined results: null counts as empty; every document ends with the separator id, so an empty one has one token.
Repeated rows are packed each. Ties in score go to the next place after the window's first document, in the shard's
order and round it. A very long document is a shard of its own with what came before it, and cut across windows. An
empty table gives an empty result. Only the named columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.llm.batches import give_back, small_batches
from sparkseam.session import materialise

WINDOW, SHARD_TOKENS, CHAIN_WINDOWS = 1024, 2_000_000, 32
#: Shards in a range, documents the centres are fitted on, centres, dimensions of the hashed vectors.
RANGE_SHARDS, SAMPLE_DOCS, CLUSTERS, DIMENSIONS = 2, 4096, 64, 256
#: Scores count in steps of 1 / UNIT, so that the order of additions doesn't tell equal ones apart.
UNIT = 2**20
#: Token ids in at least this share of a shard's documents are scored by a product of matrices.
DENSE = 1 / 12
K1, B = 1.2, 0.75
SPECIAL = "<|endoftext|>"
# Fixed value: the published splitting pattern of this byte-level vocabulary.
# It is written with possessive repeats, which match the same and spare the backtracking.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The same without looking ahead, which a finite automaton matches several times as fast. It splits alike unless spaces are three in a row or two at a text's end.
PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_SPACES = re.compile(r"\s\s(?:\s|\Z)")


def _bytes_of_marks() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Token ids of texts. The same vocabulary runs in the faster of two public libraries; special strings in a text go to the other."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        vocab = known["model"]["vocab"]
        marks = _bytes_of_marks()
        ranks = {bytes(marks[c] for c in w): i for w, i in vocab.items() if w != SPECIAL}
        self.size = max([*vocab.values(), *(x["id"] for x in known["added_tokens"])]) + 1
        self.dtype = "<u2" if self.size <= 2**16 else "<u4"
        # its search for special strings stops at each character if there are none, so it has one that no text it gets holds
        self.fast, self.careful = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=ranks, special_tokens={SPECIAL: self.size}) for p in (PLAIN, PATTERN))

    @cached_property
    def full(self):
        """Loaded by the first text that needs it, as it takes a worker some tens of MB."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        own = self.careful if _SPACES.search(text) else self.fast
        return own.encode_to_numpy(text, disallowed_special=()).astype(self.dtype)


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def distinct(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct token ids of each document after each other, how often each occurs, and how many each document has."""
    sizes = np.array([len(x) for x in docs], dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(docs), np.int64)
    all_ = np.concatenate([np.sort(x, kind="stable") for x in docs])
    first = np.append(True, all_[1:] != all_[:-1])
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    at = np.flatnonzero(first)
    owner = np.searchsorted(np.cumsum(sizes), at, side="right")
    return all_[at].astype(np.int64), np.diff(np.append(at, len(all_))), np.bincount(owner, minlength=len(docs))


def weights(terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, df: np.ndarray, n: int, mean: float) -> np.ndarray:
    """BM25 weights of token ids that occur tf times in documents of these sizes."""
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    return idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes / mean))


class Content:
    """What gives a document its content key: statistics and centres of the sample."""

    def __init__(self, df: np.ndarray, n: int, mean: float, centres: np.ndarray):
        rng = np.random.default_rng(5)
        self.df, self.n, self.mean, self.centres = df, n, mean, centres
        self.cell, self.sign = rng.integers(0, DIMENSIONS, len(df)), np.where(rng.random(len(df)) < 0.5, -1.0, 1.0)

    def vectors(self, terms: np.ndarray, tf: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed tf-idf vectors of length one (a row for each document) and the weights. Arguments as from distinct()."""
        w = weights(terms, tf, np.repeat(sizes, counts), self.df, self.n, self.mean)
        cell = np.repeat(np.arange(len(counts)) * DIMENSIONS, counts) + self.cell[terms]
        v = np.bincount(cell, w * self.sign[terms], minlength=len(counts) * DIMENSIONS).reshape(len(counts), DIMENSIONS)
        return v / (np.sqrt((v * v).sum(1, keepdims=True)) + 1e-9), w

    def keys(self, terms: np.ndarray, tf: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre and the heaviest token id (the smallest of equals) of each document."""
        v, w = self.vectors(terms, tf, counts, sizes)
        heavy, full = np.zeros(len(counts), np.int64), counts > 0
        if full.any():
            most = np.maximum.reduceat(w, (np.cumsum(counts) - counts)[full])
            owner = np.repeat(np.arange(len(counts)), counts)
            at = np.flatnonzero(w == np.repeat(most, counts[full]))[::-1]
            heavy[owner[at]] = terms[at]
        return (v @ self.centres.T).argmax(1) if len(self.centres) else np.zeros(len(counts), np.int64), heavy

    def fit(self, vectors: np.ndarray) -> Content:
        """Spherical k-means. vectors: one row for each document of the sample."""
        if len(vectors):
            rng = np.random.default_rng(6)
            centres = vectors[rng.choice(len(vectors), min(CLUSTERS, len(vectors)), replace=False)]
            for _ in range(8):
                near = (vectors @ centres.T).argmax(1)
                sums = np.stack([vectors[near == k].sum(0) if (near == k).any() else centres[k] for k in range(len(centres))])
                centres = sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)
            self.centres = centres
        return self


KEYED = "_ids binary, _key long, _term long, _stat boolean"


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str, separator: int, content: Content | None = None) -> DataFrame:
    """_id, _ids (token ids and the separator, two bytes each for vocabularies of up to 65,536), content key and heaviest token id of every row.

    Rows with _stat: for each task and token id (_key) the number of its documents with it (_term); id `size` stands for
    documents, size + 1 for tokens with the separators.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, content = tokens(path), shared.value
        tail = np.array([separator], dtype=own.dtype).tobytes()
        df, names = np.zeros(own.size + 2, dtype=np.int64), ["_id", "_ids", "_key", "_term", "_stat"]
        null = None
        for batch in batches:
            null = null if null is not None else batch.column(0).type
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [own.ids(t or "") for t in part.column(1).to_pylist()]
                sizes, (terms, tf, counts) = np.array([len(x) for x in ids]), distinct(ids)
                df[:-2] += np.bincount(terms, minlength=own.size)
                df[-2:] += len(ids), sizes.sum() + len(ids)
                keys, heavy = content.keys(terms, tf, counts, sizes) if content else (np.zeros(len(ids), np.int64),) * 2
                raw = pa.array([x.tobytes() + tail for x in ids], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), raw, pa.array(keys), pa.array(heavy), pa.array(np.zeros(len(ids), bool))], names=names)
        give_back()
        at = np.flatnonzero(df)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), null), pa.nulls(len(at), pa.binary()), pa.array(at), pa.array(df[at]),
                pa.array(np.ones(len(at), bool))], names=names)

    return docs.select(F.col(id_col).alias("_id"), F.col(text_col)).mapInArrow(run, f"_id {kind}, {KEYED}")


def statistics(rows: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of each token id, number of documents, number of tokens with the separators."""
    df = np.zeros(size + 2, dtype=np.int64)
    for token, n in rows.filter("_stat").groupBy("_key").agg(F.sum("_term")).collect():  # size + 2 rows at most
        df[token] = n
    return df[:-2], int(df[-2]), int(df[-1])


def fit_content(docs: DataFrame, path: str, id_col: str, text_col: str, separator: int, sample: int = SAMPLE_DOCS) -> Content:
    """Centres of a sample of about `sample` documents; the driver gets their vectors, DIMENSIONS numbers each."""
    some = docs.select(id_col, text_col).sample(min(1.0, sample / max(1, docs.count())), 20)
    own = tokens(path)
    rows = materialise(tokenise(some, path, id_col, text_col, separator), "sample")
    df, n, total = statistics(rows, own.size)
    content = Content(df, n, max(1.0, total / max(1, n)), np.zeros((0, DIMENSIONS)))
    dtype = own.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(raw.as_buffer(), dtype=dtype)[:-1] for raw in batch.column(0)]
            v, _ = content.vectors(*distinct(ids), np.array([len(x) for x in ids]))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in v.astype("<f4")], pa.binary())], names=["v"])

    found = sorted(r[0] for r in rows.filter("not _stat").select("_ids").mapInArrow(run, "v binary").collect())
    return content.fit(np.array([np.frombuffer(v, dtype="<f4") for v in found], dtype=float).reshape(-1, DIMENSIONS))


class Index:
    """BM25 postings of one shard. Frequent token ids are rows of a matrix over the documents still unused, the others have postings."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n: int, mean: float):
        self.terms, tf, counts = distinct(docs)
        self.n, self.ends = len(docs), np.cumsum(counts)
        owners = np.repeat(np.arange(self.n), counts)
        w = weights(self.terms, tf, np.repeat(np.array([len(x) for x in docs], np.int64), counts), df, n, mean)
        size = int(self.terms.max(initial=0)) + 1
        here = np.bincount(self.terms, minlength=size)
        # frequent ids by a product of matrices, the others by their postings
        self.row = np.full(size, -1)
        frequent = np.flatnonzero(here >= max(1.0, self.n * DENSE))
        self.row[frequent] = np.arange(len(frequent))
        often = self.row[self.terms] >= 0
        self.dense = np.zeros((len(frequent), self.n))
        self.dense[self.row[self.terms[often]], owners[often]] = w[often]
        self.columns = np.arange(self.n)
        terms, owners, w = self.terms[~often], owners[~often], w[~often]
        by = np.argsort(terms, kind="stable")
        self.owners, self.weights = owners[by], w[by]
        self.counts = np.bincount(terms, minlength=size)
        self.starts = np.cumsum(self.counts) - self.counts

    def query(self, i: int) -> np.ndarray:
        """All distinct token ids of document i."""
        return self.terms[self.ends[i - 1] if i else 0 : self.ends[i]]

    def shrink(self, alive: np.ndarray) -> None:
        """Columns of used documents leave the matrix once they are a fourth of it."""
        keep = alive[self.columns]
        if keep.sum() <= 0.75 * len(keep):
            self.columns, self.dense = self.columns[keep], np.ascontiguousarray(self.dense[:, keep])

    def search(self, queries: list[np.ndarray]) -> np.ndarray:
        """Scores of every column's document for each query (a row)."""
        q, t = np.repeat(np.arange(len(queries)), [len(x) for x in queries]), np.concatenate(queries)
        often = self.row[t] >= 0
        asked = np.zeros((len(queries), len(self.dense)))
        asked[q[often], self.row[t[often]]] = 1
        q, t = q[~often], t[~often]
        m = self.counts[t]
        where = np.repeat(self.starts[t] - np.cumsum(m) + m, m) + np.arange(m.sum())
        rare = np.bincount(np.repeat(q, m) * self.n + self.owners[where], self.weights[where], minlength=len(queries) * self.n).reshape(len(queries), self.n)
        return np.rint((rare[:, self.columns] + asked @ self.dense) * UNIT) / UNIT

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document for all token ids of document i."""
        out = np.full(self.n, -np.inf)
        out[self.columns] = self.search([self.query(i)])[0]
        return out


class Chains:
    """Windows of several chains side by side: which documents are used, and what each chain's open window still needs."""

    def __init__(self, sizes: np.ndarray, bounds: np.ndarray, window: int):
        """sizes: tokens of each document; chain c opens windows with documents bounds[c] to bounds[c + 1]."""
        n = len(bounds) - 1
        self.sizes, self.window, self.used, self.left = sizes, window, np.zeros(len(sizes), dtype=bool), len(sizes)
        self.fresh, self.stop = list(map(int, bounds[:-1])), list(map(int, bounds[1:]))
        self.first, self.room, self.seq = [-1] * n, [window] * n, [0] * n
        self.active, self.out = list(range(n)), []

    def lay(self, c: int, doc: int) -> None:
        start, size = 0, int(self.sizes[doc])
        self.used[doc] = True
        self.left -= 1
        while start < size:
            take = min(self.room[c], size - start)
            self.out.append((doc, start, take, c, self.seq[c], self.window - self.room[c]))
            start += take
            self.room[c] -= take
            if not self.room[c]:
                self.seq[c], self.room[c], self.first[c] = self.seq[c] + 1, self.window, doc if start < size else -1

    def waiting(self) -> list[int]:
        """Chains whose window needs neighbours, after windows without a first document got their chain's next unused one."""
        for c in self.active:
            while self.first[c] < 0:
                while self.fresh[c] < self.stop[c] and self.used[self.fresh[c]]:
                    self.fresh[c] += 1
                if self.fresh[c] == self.stop[c]:
                    break
                self.first[c] = self.fresh[c]
                self.lay(c, self.fresh[c])
        self.active = [c for c in self.active if self.first[c] >= 0]
        return self.active if self.left else []

    def take(self, offers) -> None:
        """offers: (chain, document), best first. A used document or one for a window that is full is passed over."""
        seqs = {c: self.seq[c] for c in self.active}
        for c, doc in offers:
            if seqs[c] == self.seq[c] and not self.used[doc]:
                self.lay(c, doc)

    def pieces(self) -> list[tuple[int, int, int, int, int, int]]:
        """(document, start, length, chain, sequence, offset); a chain's unfilled last window becomes sequences of powers of two."""
        out, last = [], {}
        for p in self.out:
            if p[4] == self.seq[p[3]]:
                last.setdefault(p[3], []).append(p)
            else:
                out.append(p)
        for c, own in last.items():
            seq, offset, total = self.seq[c], 0, sum(p[2] for p in own)
            bits = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
            left = bits.pop(0)
            for d, s, m, *_ in own:
                while m:
                    take = min(m, left)
                    out.append((d, s, take, c, seq, offset))
                    s, m, left, offset = s + take, m - take, left - take, offset + take
                    if not left and bits:
                        left, seq, offset = bits.pop(0), seq + 1, 0
        return out


def layout(sizes: list[int], neighbours, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece of one chain. neighbours(i): scores."""
    chains = Chains(np.asarray(sizes), np.array([0, len(sizes)]), window)
    while chains.waiting():
        chains.take((0, j) for j in np.argsort(-neighbours(chains.first[0]), kind="stable").tolist())
    return [(d, s, m, q, o) for d, s, m, _, q, o in chains.pieces()]


def offers(index: Index, chains: Chains, asked: list[int], factor: dict[int, int]) -> list[tuple[int, int]]:
    """(chain, unused document), best first: for each chain the best ones until their sizes reach `factor` times its room."""
    index.shrink(~chains.used)
    free = ~chains.used[index.columns]
    n, out = index.n, []
    for at in range(0, len(asked), 32):
        part = asked[at : at + 32]
        scores = index.search([index.query(chains.first[c]) for c in part])[:, free]
        docs = index.columns[free]
        for c, own in zip(part, scores, strict=True):
            need, k = chains.room[c] * factor.get(c, 2), 16
            while True:
                # the k best and all that are equal to the last of them, so that ties are settled by place alone
                top = np.flatnonzero(own >= np.partition(own, len(own) - k)[len(own) - k]) if k < len(own) else np.arange(len(own))
                turn = (docs[top] - chains.first[c] - 1) % n
                by = np.lexsort((turn, -own[top]))
                top = top[by]
                before = np.cumsum(chains.sizes[docs[top]]) - chains.sizes[docs[top]]
                if k >= len(own) or before[-1] + chains.sizes[docs[top[-1]]] >= need:
                    break
                k *= 4
            cut = before < need
            out += zip((-own[top[cut]]).tolist(), turn[by][cut].tolist(), [c] * int(cut.sum()), docs[top[cut]].tolist(), strict=True)
    return [(c, d) for _, _, c, d in sorted(out)]


def fill(ids: list[np.ndarray], df: np.ndarray, n: int, mean: float, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, chain, sequence, offset) of every piece of a shard. ids: with the separators."""
    index = Index([x[:-1] for x in ids], df, n, mean)
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    step = CHAIN_WINDOWS * window
    chains = Chains(sizes, np.searchsorted(begins, np.arange(-(-int(sizes.sum()) // step) + 1) * step), window)
    factor: dict[int, int] = {}
    while waiting := chains.waiting():
        had = {c: (chains.seq[c], chains.room[c]) for c in waiting}
        chains.take(offers(index, chains, waiting, factor))
        # a window that got nothing, as others took all it was offered, asks for more
        factor = {c: factor.get(c, 2) * 4 for c in waiting if had[c] == (chains.seq[c], chains.room[c])}
    return chains.pieces()


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", separator: int = 0, window: int = WINDOW,
    shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    small_batches(docs.sparkSession)
    own = tokens(path)
    dtype, kind = own.dtype, docs.schema[id_col].dataType.simpleString()
    rows = materialise(tokenise(docs, path, id_col, text_col, separator, fit_content(docs, path, id_col, text_col, separator)), "tokens")
    df, n, total = statistics(rows, own.size)
    mean = max(1.0, total / max(1, n))
    # one copy of the statistics for each executor: as many numbers as the vocabulary has
    shared = docs.sparkSession.sparkContext.broadcast(df)

    def laid(ids: list[np.ndarray], base: int) -> tuple[list[tuple], int]:
        """Pieces of a shard with sequence numbers from base on, and the next number."""
        number: dict[tuple[int, int], int] = {}
        out = [(d, s, m, number.setdefault((c, q), base + len(number)), o) for d, s, m, c, q, o in fill(ids, shared.value, n, mean, window)]
        return out, base + len(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base = [], TaskContext.get().partitionId() << 40
        ids, size = [], 0

        def shard() -> pa.RecordBatch:
            nonlocal base, names, ids, size
            pieces, base = laid(ids, base)
            d, s, m, q, o = zip(*pieces, strict=True)
            out = pa.RecordBatch.from_arrays([
                pa.concat_arrays(names).take(pa.array(d, pa.int64())), pa.array(s, pa.int64()), pa.array(m, pa.int64()),
                pa.array([zlib.crc32(ids[i][a : a + k].astype("<u4")) for i, a, k in zip(d, s, m, strict=True)], pa.int64()),
                pa.array([len(ids[i]) for i in d], pa.int64()), pa.array(q, pa.int64()), pa.array(o, pa.int64()),
            ], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            names, ids, size = [], [], 0
            return out

        for batch in batches:
            first = 0
            for i, raw in enumerate(batch.column(1)):
                ids.append(np.frombuffer(raw.as_buffer(), dtype=dtype))
                size += len(ids[-1])
                if size >= shard_tokens:
                    names.append(batch.column(0).slice(first, i + 1 - first))
                    first = i + 1
                    yield shard()
            if first < batch.num_rows:
                names.append(batch.column(0).slice(first))
        if ids:
            yield shard()
        give_back()

    # the row number parts equal keys and repeated rows; the table is written, so it numbers alike when a task is run again
    ranges = max(1, -(-total // (RANGE_SHARDS * shard_tokens)))
    dealt = rows.filter("not _stat").select("_id", "_ids", "_key", "_term", F.monotonically_increasing_id().alias("_row"))
    dealt = dealt.repartitionByRange(ranges, "_key", "_term", "_row").sortWithinPartitions("_key", "_term", "_row")
    return dealt.select("_id", "_ids").mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id "
        f"long, offset long")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
