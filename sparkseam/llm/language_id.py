"""Language identification by interpolated Kneser-Ney character language models.

A text is read as its words (runs of letters, lower case), each with a mark before and after it; one model for each
language gives every letter and the end mark a probability from up to ORDER - 1 symbols before it, within the word.
Orders are interpolated down to a uniform distribution over all languages' letters:

    p_k(c | h) = max(n_k(h c) - D_k, 0) / n_k(h) + D_k t_k(h) / n_k(h) * p_(k-1)(c | h without its first symbol)

n_k counts occurrences at the highest order and behind the start mark, and elsewhere the distinct symbols that stand
before (continuations); t_k(h) is the number of different symbols after h; D_k = n1 / (n1 + 2 n2) by order and language.
The language with the lowest cross-entropy per symbol is chosen. Models are sorted arrays of 64-bit hashes with the two
terms beside them, looked up by binary search for all symbols of a batch's new words at once; a worker remembers what
words cost.

Training takes texts with a language from at most ROWS documents (crc32(id as text) mod 5 other than 0, equally many for
each of the MOST_LANGS most frequent languages, smallest hashes of the id, equal texts once), read whole and counted on
the executors. The GRAMS // languages most frequent grams of each language make its model, so the model is bounded
whatever the corpus: at most ORDER * GRAMS entries of twelve bytes. One fifth of the sample (by hash of the text) isn't
counted but calibrates:

* rejection: a text is accepted if its cross-entropy lies no further above its language's mean than the texts of the
  language do, (x - mean) / sqrt(a + b / symbols) at most the 1 - REJECT quantile, a and b fitted to the squares;
* score: a logistic function of log(1 + margin), the margin in nats over the whole text to the second best language.

Defined results: null texts and texts without a letter are `und` with score 0, not accepted. `identify` gives rejected
texts `und` too if asked to. Ties go to the language that sorts first. With one language the uniform distribution is
the second best. Without any language in training all texts are `und`. Repeated rows get equal results; a null id counts
as the empty string for held_out and isn't trained on. Very long texts are read whole. An empty table gives an empty
result. Only the named columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.llm.batches import parts
from sparkseam.session import materialise, read_table

#: Symbols of a gram; training documents; languages; grams of all models at the highest order.
ORDER, ROWS, MOST_LANGS, GRAMS = 5, 6000, 256, 1_000_000
#: Share of a language's own texts that calibration rejects.
REJECT = 0.002
#: Words whose cost a worker remembers, the longest of them, and symbols looked up at once.
MEMO, LONGEST, BLOCK = 100_000, 40, 200_000
#: Languages that are looked up together.
TOGETHER = 8
UNKNOWN = "und"

_START, _END = "\x02", "\x03"
_LETTERS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> Counter:
    """The words of a text with their counts."""
    found = Counter(_LETTERS.findall((text or "").lower()))
    for w in [w for w in found if not w.isalpha() and not any(map(str.isalpha, w))]:  # numerals that are no digits
        del found[w]
    return found


def grams(word: str, order: int = ORDER) -> list[str]:
    """One gram for each symbol of a word and its end: the symbol and up to order - 1 before it."""
    marked = f"{_START}{word}{_END}"
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def codes(strings: list[str]) -> np.ndarray:
    """The strings' code points, spread over 64 bits, in one array."""
    x = (np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)) * _P
    return (x ^ (x >> np.uint64(29))) * _P


def hashes(strings: list[str]) -> np.ndarray:
    """Polynomial hashes of strings of one length."""
    if not strings or not strings[0]:
        return np.zeros(len(strings), np.uint64)
    out = np.zeros(len(strings), np.uint64)
    for column in codes(strings).reshape(len(strings), -1).T:
        out = out * _P + column
    return out


@dataclass
class Table:
    """Sorted hashes with a number each."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(numbers: dict[str, float]) -> Table:
        keys = hashes(list(numbers))
        order = np.argsort(keys)
        return Table(keys[order], np.fromiter(numbers.values(), np.float32, len(numbers))[order])

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], missing)


@dataclass
class Joined:
    """Tables of some languages under one sorted array of hashes: a row of numbers for each, the last row for hashes that aren't there."""

    keys: np.ndarray
    rows: np.ndarray

    @staticmethod
    def of(tables: list[Table], missing: float) -> Joined:
        keys = np.unique(np.concatenate([t.keys for t in tables]))
        rows = np.full((len(keys) + 1, len(tables)), missing, np.float32)
        for lang, t in enumerate(tables):
            rows[np.searchsorted(keys, t.keys), lang] = t.values
        return Joined(keys, rows)

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return self.rows[np.zeros(len(keys), np.int64)]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.rows[np.where(self.keys[at] == keys, at, len(self.keys))]


def discount(counts: list[float]) -> float:
    n1, n2 = sum(n == 1 for n in counts), sum(n == 2 for n in counts)
    return min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5


def kneser_ney(counts: dict[str, int], order: int = ORDER) -> list[tuple[Table, Table]]:
    """For each order from 1 on the discounted terms by gram and the weights of the next lower order by context."""
    level = {g: n for g, n in counts.items() if len(g) == order}
    out = []
    for k in range(order, 0, -1):
        cut = discount(list(level.values()))
        total, types = Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            types[g[:-1]] += 1
        out.append((Table.of({g: (n - cut) / total[g[:-1]] for g, n in level.items()}), Table.of({h: cut * types[h] / total[h] for h in total})))
        lower: dict[str, int] = Counter(g[1:] for g in level)
        lower.update({g: n for g, n in counts.items() if len(g) == k - 1})  # behind the start mark nothing varies
        level = lower
    return out[::-1]


@dataclass
class Model:
    """tables: by language, then order; letters: size of the uniform distribution; mean, spread (a, b) and limit: by language; offset, slope: of the score."""

    langs: list[str]
    tables: list[list[tuple[Table, Table]]]
    letters: int
    order: int = ORDER
    mean: list[float] = field(default_factory=list)
    spread: list[tuple[float, float]] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)
    offset: float = 0.0
    slope: float = 1.0

    def __post_init__(self):
        self.memo: dict[str, int] = {}
        self.known, self.used = np.empty((0, len(self.langs) + 1)), 0
        self.joined: list[tuple[int, list[tuple[Joined, Joined]]]] = []

    def __getstate__(self):
        """What a worker makes for itself doesn't travel."""
        return self.__dict__ | {"memo": {}, "known": np.empty((0, len(self.langs) + 1)), "used": 0, "joined": []}

    def _joined(self) -> list[tuple[int, list[tuple[Joined, Joined]]]]:
        """Number of the first language, and for each order the terms and weights, of each TOGETHER languages."""
        if not self.joined:
            for at in range(0, len(self.langs), TOGETHER):
                own = self.tables[at : at + TOGETHER]
                self.joined.append((at, [(Joined.of([t[k][0] for t in own], 0.0), Joined.of([t[k][1] for t in own], 1.0)) for k in range(self.order)]))
        return self.joined

    def cost(self, new: list[str]) -> np.ndarray:
        """Nats of each word in each language."""
        marked = [f"{_START}{w}{_END}" for w in new]
        sizes = np.array([len(m) for m in marked])
        ends = np.cumsum(sizes)
        code, place = codes(marked), np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        # grams[k]: hashes of the k symbols that end at each place
        grams = [np.zeros(len(code), np.uint64)]
        for k in range(1, self.order + 1):
            before = np.concatenate([np.zeros(1, np.uint64), grams[-1][:-1]])  # of the k - 1 symbols before
            grams.append(np.where(place >= k - 1, before * _P + code, np.uint64(0)))
        out = np.empty((len(new), len(self.langs)))
        for first, tables in self._joined():
            p = np.full((len(code), tables[0][0].rows.shape[1]), 1.0 / self.letters)
            for k, (terms, rest) in enumerate(tables, 1):
                at = np.flatnonzero(place >= max(1, k - 1))
                p[at] = terms.get(grams[k][at]) + rest.get(grams[k - 1][at - 1] if k > 1 else np.zeros(len(at), np.uint64)) * p[at]
            p[place == 0] = 1.0
            out[:, first : first + p.shape[1]] = -np.add.reduceat(np.log(p), ends - sizes, axis=0)
        return out

    def costs(self, texts: list[Counter]) -> tuple[np.ndarray, np.ndarray]:
        """Nats of each text in each language, and its symbols. memo: word -> its row of known, nats by language and symbols."""
        distinct = {w for t in texts for w in t}
        if self.used > MEMO:
            self.memo, self.used, self.known = {}, 0, np.empty((0, len(self.langs) + 1))
        memo, new, size = self.memo, [], 0
        todo = [w for w in distinct if w not in memo]
        if self.used + len(todo) > len(self.known):
            self.known = np.concatenate([self.known[: self.used], np.empty((max(len(todo), self.used), len(self.langs) + 1))])
        for n, w in enumerate(todo, 1):
            new.append(w)
            size += len(w) + 2
            if size >= BLOCK or n == len(todo):
                rows = slice(self.used, self.used + len(new))
                self.known[rows, :-1], self.known[rows, -1] = self.cost(new), [len(x) + 1 for x in new]
                memo.update(zip(new, range(rows.start, rows.stop), strict=True))
                self.used, new, size = rows.stop, [], 0
        total = np.zeros((len(texts), len(self.langs) + 1))
        for i, t in enumerate(texts):
            n, at = np.fromiter(t.values(), float, len(t)), np.fromiter(map(memo.__getitem__, t), np.int64, len(t))
            for k in range(0, len(at), MEMO):  # a part of a very long text at once
                total[i] += n[k : k + MEMO] @ self.known[at[k : k + MEMO]]
        out, symbols = total[:, :-1].copy(), total[:, -1].copy()
        for w in [w for w in distinct if len(w) > LONGEST]:
            del memo[w]
        return out, symbols

    def judge(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the best language (-1: none), its nats per symbol, margin in nats to the second best, symbols."""
        cost, symbols = self.costs([words(t) for t in texts])
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), symbols
        best = cost.argmin(axis=1)
        each = np.arange(len(texts))
        first = cost[each, best]
        cost[each, best] = np.inf
        second = cost.min(axis=1) if len(self.langs) > 1 else symbols * np.log(self.letters)
        return np.where(symbols > 0, best, -1), first / np.maximum(symbols, 1), np.maximum(second - first, 0), symbols

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.offset + self.slope * np.log1p(margin), -30, 30)))

    def excess(self, lang: int, x: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        a, b = self.spread[lang]
        return (x - self.mean[lang]) / np.sqrt(a + b / np.maximum(symbols, 1))

    def calibrate(self, truth: np.ndarray, best: np.ndarray, x: np.ndarray, margin: np.ndarray, symbols: np.ndarray) -> None:
        """From rows of known language (its number): mean, spread and limit of each language, offset and slope of the score."""
        self.mean, self.spread, self.limit = [], [], []
        for lang in range(len(self.langs)):
            own = (truth == lang) & (best == lang)
            self.mean.append(float(x[own].mean()) if own.any() else 0.0)
            square, part = (x[own] - self.mean[-1]) ** 2, 1 / np.maximum(symbols[own], 1)
            a = b = 1.0
            if own.sum() > 2:
                design = np.stack([np.ones(own.sum()), part], axis=1)
                a, b = np.maximum(np.linalg.lstsq(design, square, rcond=None)[0], 1e-6)
            self.spread.append((float(a), float(b)))
            self.limit.append(float(np.quantile(self.excess(lang, x[own], symbols[own]), 1 - REJECT)) if own.sum() > 2 else np.inf)
        y, design = (truth == best).astype(float), np.stack([np.ones(len(x)), np.log1p(margin)], axis=1)
        beta = np.array([0.0, 1.0])
        for _ in range(30):  # ridge towards the start
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            grad = design.T @ (p - y) + (beta - [0.0, 1.0])
            step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.eye(2), grad)
            beta -= np.clip(step, -1, 1)
        self.offset, self.slope = float(beta[0]), max(float(beta[1]), 0.05)


def fitted(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """A model without calibration from each language's counts of grams."""
    letters = {g[-1] for of in counts.values() for g in of}
    langs = sorted(counts)
    return Model(langs, [kneser_ney(counts[x], order) for x in langs], len(letters) + 1, order)


def held_out(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> tuple[DataFrame, list[str]]:
    """_lang, _text of at most `rows` documents, equally many for each language, and the languages."""
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    own = own.filter(~held_out("_id") & F.col("_id").isNotNull() & F.col("_text").isNotNull() & F.col("_lang").isNotNull() & (F.col("_lang") != UNKNOWN))
    langs = own.groupBy("_lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "_lang").limit(MOST_LANGS).collect()
    if not langs:
        return own.select("_lang", "_text").limit(0), []
    each = max(1, rows // len(langs))
    # about twice the wanted rows of a language pass by their hash, so that what is ranked is bounded
    share = F.create_map(*[F.lit(v) for r in langs for v in (r["_lang"], min(1.0, 2.0 * each / r["n"] + 20.0 / r["n"]))])
    order = F.xxhash64(F.col("_id").cast("string"))
    own = own.withColumn("_at", order).filter(F.pmod("_at", F.lit(1_000_000)) < 1_000_000 * share[F.col("_lang")])
    own = own.groupBy("_lang", "_text").agg(F.min("_at").alias("_at"))
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_at", F.xxhash64("_text")))
    return own.withColumn("_n", rank).filter(F.col("_n") <= each).select("_lang", "_text"), sorted(r["_lang"] for r in langs)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS, order: int = ORDER) -> Model:
    sample, langs = training_texts(docs, id_col, text_col, lang_col, rows)
    if not langs:
        return Model([], [], 1, order)
    sample = materialise(sample.withColumn("_checks", F.pmod(F.xxhash64("_text", F.lit(1)), F.lit(5)) == 0), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words(text))
            for lang, own in found.items():
                total: Counter = Counter()
                for w, n in own.items():
                    for g in grams(w, order):
                        total[g] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), pa.array(list(total), pa.string()),
                    pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = sample.filter(~F.col("_checks")).select("_lang", "_text").mapInArrow(count, "lang string, gram string, n long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    by_lang: dict[str, dict[str, int]] = {}
    for r in counts.withColumn("_n", rank).filter(F.col("_n") <= GRAMS // len(langs)).select("lang", "gram", "n").toLocalIterator():
        by_lang.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    model = fitted(by_lang, order)
    number = {x: i for i, x in enumerate(model.langs)}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            best, x, margin, symbols = model.judge(batch.column(1).to_pylist())
            truth = [number.get(y, -1) for y in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in (truth, best.astype(float), x, margin, symbols)],
                names=["truth", "best", "x", "margin", "symbols"])

    kind = "truth double, best double, x double, margin double, symbols double"
    got = sample.filter("_checks").select("_lang", "_text").mapInArrow(weigh, kind).collect()  # at most `rows` rows of numbers
    table = np.array(sorted(tuple(r) for r in got if r["truth"] >= 0 and r["best"] >= 0)).reshape(-1, 5)
    model.calibrate(*table.T)
    return model


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """id_col, lang_pred, score, accepted, nats (per symbol) of every row; with reject, texts that aren't accepted are `und`."""
    kind = docs.schema[id_col].dataType.simpleString()
    langs = np.array([*model.langs, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            best, x, margin, symbols = model.judge(batch.column(1).to_pylist())
            fits = np.zeros(len(best), bool)
            for lang in range(len(model.langs)):
                own = best == lang
                fits[own] = model.excess(lang, x[own], symbols[own]) <= model.limit[lang]
            name = langs[np.where(fits, best, -1) if reject else best]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name.tolist(), pa.string()), pa.array(np.where(best >= 0, model.score(margin), 0.0)),
                pa.array(fits), pa.array(x)], names=[id_col, "lang_pred", "score", "accepted", "nats"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean, nats double")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs, train(docs), reject=False)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "accepted", "nats")
