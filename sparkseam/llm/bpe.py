"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes "words": no piece holds the space mark anywhere but at its start, nor a newline, so merges never cross
those places and equal words have equal ids. The distinct words of an Arrow batch that the worker hasn't met lie in
one flat numpy symbol array. A round takes the best pair of each word (segmented minimum of pair ranks), merges its
leftmost occurrences at once, and compacts the array; finished words leave it. Where a merged piece takes part in a
better-ranked pair, only the leftmost occurrence merges in that round, as the library would.

Runs of space marks: the model ranks all runs equally and last, so they are cut greedily from the left into the
longest run pieces once every other merge is done. Characters without a piece fall back to their bytes.

Defined results: null counts as empty; an empty text has no ids and decodes to the empty string. A literal U+2581 is a
space mark, as in the library. Repeated rows give repeated results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
#: Words kept by a worker between batches; the table is emptied when a batch would pass this.
CACHE_WORDS = 500_000
NONE = np.iinfo(np.int32).max
_PIECES = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Encoder:
    """Encodes and decodes with one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)]
        self.n, self.text = n, pieces
        self.ids = {p: i for i, (p, ok) in enumerate(zip(pieces, plain, strict=True)) if ok}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.runs = sorted((len(p) for p in self.ids if p.strip(MARK) == ""), reverse=True)
        keys, merged = [], []
        for p, i in self.ids.items():
            if p.strip(MARK):
                for k in range(1, len(p)):
                    a, b = self.ids.get(p[:k]), self.ids.get(p[k:])
                    if a is not None and b is not None:
                        keys.append(a * n + b)
                        merged.append(i)
        scores = np.array([model.get_score(i) for i in range(n)])
        order = np.empty(n, dtype=np.int64)
        order[np.argsort(-scores, kind="stable")] = np.arange(n)
        at = np.argsort(keys)
        self.keys, self.merged = np.array(keys, dtype=np.int64)[at], np.array(merged, dtype=np.int64)[at]
        self.rank = order[self.merged].astype(np.int32)
        self.order = order
        # pieces that take part in a pair ranked before themselves: their occurrences merge one at a time
        risky = np.zeros(n, dtype=bool)
        for side in (self.keys // n, self.keys % n):
            risky[side[self.rank < order[side]]] = True
        self.risky = risky
        self.decimal = [str(i) for i in range(n)]
        self.said = [p.replace(MARK, " ") for p in pieces]
        self.single = {c: i for c, i in self.ids.items() if len(c) == 1}
        self.cache: dict[str, tuple[str, int, str]] = {"": ("", 0, "")}

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; unknown characters as -1 - code point. words are not empty."""
        chars = "".join(words)
        points = np.frombuffer(chars.encode("utf-32-le"), dtype=np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        symbol = np.array([self.single.get(chr(c), -1 - int(c)) for c in kinds], dtype=np.int64)[inverse]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, into = np.full(len(symbol), NONE, dtype=np.int32), np.zeros(len(symbol), dtype=np.int32)

        def look(at: np.ndarray) -> None:
            """Rank and merged piece of the pairs that start at these places."""
            a, b = symbol[at], symbol[at + 1]
            near = (word[at] == word[at + 1]) & (a >= 0) & (b >= 0)
            key = np.where(near, a * self.n + b, -1)
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            rank[at], into[at] = np.where(hit, self.rank[found], NONE), self.merged[found]

        look(np.arange(len(symbol) - 1))
        while len(symbol):
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            spread = np.repeat(best, np.diff(np.append(starts, len(word))))
            live = spread < NONE
            if not live.all():
                done.append((word[~live], symbol[~live]))
                symbol, word, rank, into, spread = symbol[live], word[live], rank[live], into[live], spread[live]
                if not len(symbol):
                    break
            # of overlapping occurrences every other one, from the left
            where = np.flatnonzero(rank == spread)
            first = np.append(True, where[1:] != where[:-1] + 1)
            head = np.maximum.accumulate(np.where(first, where, 0))
            new = into[where]
            lead = np.append(True, word[where[1:]] != word[where[:-1]])
            keep = ((where - head) % 2 == 0) & (~self.risky[new] | lead)
            where, new = where[keep], new[keep]
            symbol[where] = new
            left = np.ones(len(symbol), dtype=bool)
            left[where + 1] = False
            symbol, word, rank, into = symbol[left], word[left], rank[left], into[left]
            where -= np.arange(len(where))
            rank[where] = NONE
            where = np.concatenate([where, where - 1])
            look(where[(where >= 0) & (where < len(symbol) - 1)])
        words_of = np.concatenate([d[0] for d in done]) if done else np.zeros(0, dtype=np.int64)
        ids_of = np.concatenate([d[1] for d in done]) if done else np.zeros(0, dtype=np.int64)
        by = np.argsort(words_of, kind="stable")
        ids = ids_of[by].tolist()
        ends = np.cumsum(np.bincount(words_of, minlength=len(words))).tolist()
        return [ids[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def finish(self, word: str, ids: list[int]) -> list[int]:
        """Space runs cut, unknown characters as bytes."""
        mark = self.single.get(MARK)
        k = 0
        while k < len(ids) and ids[k] == mark:
            k += 1
        out: list[int] = []
        left = k
        while left:
            size = next((r for r in self.runs if r <= left), 1)
            out.append(self.ids[MARK * size])
            left -= size
        for i in ids[k:]:
            out.extend((i,) if i >= 0 else (self.byte[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")))
        return out

    def pieces_text(self, ids: list[int]) -> str:
        """What ids say, the first space mark included; bytes that aren't UTF-8 become U+FFFD each."""
        out, raw = [], bytearray()

        def flush() -> None:
            while raw:
                for size in range(1, min(4, len(raw)) + 1):
                    try:
                        out.append(bytes(raw[:size]).decode("utf-8"))
                    except UnicodeDecodeError:
                        continue
                    del raw[:size]
                    break
                else:
                    out.append("�")
                    del raw[:1]

        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
            else:
                flush()
                out.append(self.text[i].replace(MARK, " "))
        flush()
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space that encoding puts first."""
        text = self.pieces_text(ids)
        return text[1:] if text.startswith(" ") else text

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, " ")
        cut = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in text) if "\0" in text else "\0"
        if text[0] == " " or "  " in text:
            return _PIECES.findall(MARK + text.replace(" ", MARK))
        return [w for w in (MARK + text.replace(" ", cut + MARK).replace("\n", f"{cut}\n{cut}")).split(cut) if w]

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            mark = self.single.get(MARK)
            for w, ids in zip(part, self.merge(part), strict=True):
                if ids[0] == mark or min(ids) < 0:
                    ids = self.finish(w, ids)
                    said = self.pieces_text(ids)
                else:
                    said = "".join([self.said[i] for i in ids])
                self.cache[w] = (",".join([self.decimal[i] for i in ids]), len(ids), said)

    def encode(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text its ids joined by commas, their number, and its decoded text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": ("", 0, "")}
        parts = [self.words(t) for t in texts]
        self.learn(set().union(*parts))
        out, get = [], self.cache.__getitem__
        for p in parts:
            found = list(map(get, p))
            said = "".join([f[2] for f in found])
            out.append((",".join([f[0] for f in found]), sum([f[1] for f in found]), said[1:] if said.startswith(" ") else said))
        return out


_LOADED: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and model."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = enc.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows],
                        pa.string()), pa.array([hashlib.sha256(r[2].encode("utf-8", "surrogatepass")).hexdigest() for r in rows], pa.string())],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids (array<int>) and decoded of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = enc.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([[int(x) for x in r[0].split(",")] if r[0] else [] for r in rows],
                    pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())], names=[id_col, "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
