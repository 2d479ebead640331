"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses at punctuation and line ends, and a clause's words into letters of a small alphabet: I
(insult), T (threat verb), G (target), N (negation), R (reported speech), O (other). Sequential transducers rewrite
letters and add weights in the log semiring: `target` marks insults that follow a target closely, `threat` marks
targets that follow a threat verb, `negation` and `reported` discount what follows a negation or a verb of saying.
Composed, they are one table of (state, letter) -> (state, letter, weight). The score of a clause is its best matched
path: the lexical weight of the insult or threat times exp(arc weights). A text's evidence is the sum over clauses,
and two fitted numbers turn evidence into a probability.

Learned from labels: the insult lexicon with weights beside the fixed seed lexicon, and the two numbers. A learned entry
is a stem of STEM letters or more (or a whole shorter word) that stands in at least MIN_TEXTS different toxic training
texts and is RATIO times as frequent there as in the clean ones. The floor is a count, not a share of all toxic texts,
so the forms of a language with few toxic texts are learned as well, and stems catch inflected and compounded forms.
Entries are a letter tree, a transducer that reads a word's letters and writes I; the deepest entry on a word's way
gives its weight.

Training rows are those with crc32(id as text) mod 5 other than 0, at most TRAIN_ROWS of them (the smallest hashes of
the id), whatever the corpus size. They are counted on the executors: the driver gets entries above the floor and one
pair of numbers for each training row, no texts.

Defined results: null or empty texts have no evidence and get the score of evidence 0. Repeated rows get equal scores;
in training a repeated id counts once, with its smallest text, and equal texts with one label count once in the
lexicon. Of labels that repeat an id, each label counts. A null id counts as the empty string for held_out and is no
training row. Ties between words of a clause: the largest weight. Very long texts are read whole, in time linear in
their length. Without usable labels the seed lexicon and default numbers hold. An empty table gives an empty result.
Only the named columns are read, so other columns' names can't clash.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.llm.batches import parts
from sparkseam.session import materialise

#: Labelled rows the grammar is fitted on.
TRAIN_ROWS = 6000
#: Evidence above this counts as this.
MOST = 4.0
#: Shortest stem; different toxic training texts that hold a learned entry; how many times as frequent it is there.
#: Chosen on splits of the training rows alone.
STEM, MIN_TEXTS, RATIO = 5, 4, 20.0
#: A learned entry weighs (log ratio - LEAST) / SPREAD, from 0.1 to 1.5.
LEAST, SPREAD = 2.0, 4.0
# Fixed word lists of the grammar, four languages.
SEED_INSULTS = "idiot moron stupid loser scum trash clown pathetic worthless disgusting imbecile idioten dummkopf abschaum imbécile connard crétin idiota estúpido imbécil basura".split()
THREATS = "kill hurt destroy shoot stab strangle murder töten umbringen tuer frapper matar golpear".split()
TARGETS = "you your yours u he she they them him her this that these those du dich dir ihr euch sie tu toi vous te tú usted ustedes".split()
NEGATIONS = "not never isn't aren't don't doesn't nicht kein keine jamais nunca".split()
REPORTED = "said says say told tells wrote writes called calls claimed claims quoted quotes allegedly sagte sagt dit disait dijo dice".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.,;:!?\n]")
_WORD = re.compile(r"[^\W\d_]+")

Arcs = dict[tuple[int, str], tuple[int, str, float]]


@dataclass
class Transducer:
    """Sequential letter-to-letter transducer; state 0 starts a clause."""

    states: int
    arcs: Arcs

    def compose(self, after: Transducer, alphabet: str) -> Transducer:
        """after reads what self writes; weights add. alphabet: the letters that self may read."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            p, q = todo.pop()
            for x in alphabet:
                p2, y, w = self.arcs[p, x]
                q2, z, v = after.arcs[q, y]
                if (p2, q2) not in number:
                    number[p2, q2] = len(number)
                    todo.append((p2, q2))
                arcs[number[p, q], x] = (number[p2, q2], z, w + v)
        return Transducer(len(number), arcs)


def within(trigger: str, marks: dict[str, str], weight: float, reach: int, letters: str) -> Transducer:
    """Marks letters that follow trigger within reach letters (0: to the clause's end), adding weight to them."""
    n = max(reach, 1)
    arcs: Arcs = {}
    for state in range(n + 1):
        for x in letters:
            left = state if not reach else max(state - 1, 0)
            hit = state > 0 and x in marks
            arcs[state, x] = (n if x == trigger else left, marks[x] if hit else x, weight if hit else 0.0)
    return Transducer(n + 1, arcs)


#: Letters: J a targeted insult, X a threat to a target.
READ, ALL = "ITGNRO", "ITGNROJX"


def grammar() -> Transducer:
    target = within("G", {"I": "J"}, math.log(1.3), 5, ALL)
    threat = within("T", {"G": "X"}, 0.0, 3, ALL)
    negation = within("N", {"I": "I", "J": "J", "X": "X"}, math.log(0.4), 4, ALL)
    reported = within("R", {"I": "I", "J": "J", "X": "X"}, math.log(0.6), 0, ALL)
    return target.compose(threat, READ).compose(negation, READ).compose(reported, READ)


class Letters:
    """The lexicon as a tree of letters: entries are stems (they match every word that begins with them) or whole words."""

    def __init__(self, stems: dict[str, float], words: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.stem: list[float] = [0.0]
        self.words = words
        for entry, weight in stems.items():
            at = 0
            for c in entry:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.stem.append(0.0)
                at = self.next[at][c]
            self.stem[at] = weight

    def weight(self, word: str) -> float:
        """The weight of the whole word, else of the longest stem it begins with, else 0."""
        if word in self.words:
            return self.words[word]
        at, out = 0, 0.0
        for c in word:
            at = self.next[at].get(c, -1)
            if at < 0:
                break
            out = self.stem[at] or out
        return out


#: Words whose letter a worker remembers.
MEMO = 200_000


@dataclass
class Model:
    """insults: word -> weight; stems: beginning of words -> weight; offset and slope: evidence -> log odds."""

    insults: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    offset: float = -3.0
    slope: float = 8.0

    def __post_init__(self):
        self.fixed = {w: c for c, ws in (("R", REPORTED), ("N", NEGATIONS), ("G", TARGETS), ("T", THREATS)) for w in ws}
        self.letters = Letters(self.stems, {w: x for w, x in self.insults.items() if w not in self.fixed})
        self.machine = grammar()
        self.memo: dict[str, tuple[str, float]] = {}

    def read(self, word: str) -> tuple[str, float]:
        """The letter of a word and, for an insult, its weight."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            letter = self.fixed.get(word, "O")
            weight = self.letters.weight(word) if letter == "O" else 0.0
            got = self.memo[word] = ("I" if weight else letter, weight)
        return got

    def clauses(self, text: str) -> list[float]:
        """Scores of the matched clauses."""
        low = text.lower()
        if not any(self.read(w)[0] in "IT" for w in set(_WORD.findall(low))):
            return []
        out, state, best = [], 0, 0.0
        for word in [*_TOKEN.findall(low), "\n"]:
            if word in ".,;:!?\n":
                if best:
                    out.append(best)
                state, best = 0, 0.0
                continue
            word = word.replace("’", "'")
            if "'" in word and word not in self.fixed:
                word = word.split("'")[0]
            letter, lexical = self.read(word)
            state, mark, weight = self.machine.arcs[state, letter]
            if mark in "IJ":
                best = max(best, lexical * math.exp(weight))
            elif mark == "X":
                best = max(best, math.exp(weight))
        return out

    def evidence(self, text: str | None) -> float:
        return sum(self.clauses(text or ""))

    def score(self, text: str | None) -> float:
        return self.score_of(self.clauses(text or ""))

    def score_of(self, clauses: list[float]) -> float:
        z = self.offset + self.slope * min(sum(clauses), MOST)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def entries(text: str | None) -> set[str]:
    """What a text counts for: the stems of its words, and its shorter words whole."""
    return {w[:k] for w in set(_WORD.findall((text or "").lower())) for k in range(min(STEM, len(w)), len(w) + 1)}


def lexicon(counts: dict[str, tuple[int, int]], n: tuple[int, int]) -> Model:
    """counts: entry -> clean and toxic texts that hold it; n: clean and toxic texts."""
    insults, stems = dict.fromkeys(SEED_INSULTS, 1.0), {}
    known = {w for ws in (THREATS, TARGETS, NEGATIONS, REPORTED) for w in ws}
    for w, (clean, toxic) in sorted(counts.items()):  # a beginning comes before what it begins
        ratio = (toxic + 0.5) / (n[1] + 1) / ((clean + 0.5) / (n[0] + 1))
        if toxic < MIN_TEXTS or ratio < RATIO or w in known:
            continue
        weight = min(1.5, max(0.1, (math.log(ratio) - LEAST) / SPREAD))
        if len(w) < STEM:
            insults[w] = max(insults.get(w, 0.0), weight)
        elif all(stems.get(w[:k], 0.0) < weight for k in range(STEM, len(w))):
            stems[w] = weight
    for w in SEED_INSULTS:  # labels may contradict a seed word
        clean, toxic = counts.get(w, (0, 0))
        if clean >= 5 and toxic * (n[0] + 1) < 2 * clean * (n[1] + 1):
            insults.pop(w, None)
    return Model(insults, stems)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray) -> Model:
    """offset and slope by Newton steps of the ridge logistic regression of labels y on evidence x, towards the defaults."""
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    design = np.stack([np.ones(len(x)), np.minimum(x, MOST)], axis=1)
    beta = np.array([model.offset, model.slope])
    prior = beta.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * (beta - prior)
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2), grad)
        beta -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    model.offset, model.slope = float(beta[0]), float(beta[1])
    return model


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """A model of (text, label) rows."""
    counts, n = (Counter(), Counter()), Counter()
    for text, y in {(t or "", int(y)) for t, y in rows}:
        n[y] += 1
        counts[y].update(entries(text))
    model = lexicon({w: (counts[0][w], k) for w, k in counts[1].items()} | {w: (counts[0][w], counts[1][w]) for w in SEED_INSULTS}, (n[0], n[1]))
    return calibrate(model, np.array([model.evidence(t) for t, _ in rows]), np.array([int(y) for _, y in rows], dtype=float))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """_text, _y of the training rows: one row for each id and label."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isNotNull())
    known = known.filter(~held_out("_id")).select("_id", (F.col("_y") != 0).cast("int").alias("_y")).distinct()
    known = known.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)  # bounded by `rows`, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.join(F.broadcast(known), "_id").groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_text", "_y")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model:
    sample = materialise(training_rows(docs, labels, id_col, text_col, label_col, rows), "training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            found: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((w, y) for w in entries(text))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([y for _, y in found], pa.int32()),
                pa.array(list(found.values()), pa.int64())], names=["entry", "y", "n"])

    single = sample.dropDuplicates(["_text", "_y"])  # copies of a text count once in the lexicon
    total = {r["_y"]: r["n"] for r in single.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = (F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)) for y in (1, 0))
    counts = single.mapInArrow(count, "entry string, y int, n long").groupBy("entry").agg(clean.alias("clean"), toxic.alias("toxic"))
    counts = counts.filter((F.col("toxic") >= MIN_TEXTS) | F.col("entry").isin(SEED_INSULTS)).collect()
    model = lexicon({r["entry"]: (r["clean"], r["toxic"]) for r in counts}, (total.get(0, 0), total.get(1, 0)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array([model.evidence(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)],
                names=["x", "y"])

    pairs = sorted((r["x"], r["y"]) for r in sample.mapInArrow(weigh, "x double, y int").collect())  # at most `rows` pairs of numbers
    return calibrate(model, np.array([x for x, _ in pairs]), np.array([y for _, y in pairs], dtype=float))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, clauses (number of matched clauses) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(1).to_pylist()
            found = [model.clauses(t or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score_of(c) for c in found], pa.float64()),
                pa.array([len(c) for c in found], pa.int64())], names=[id_col, "score", "clauses"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, clauses long")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows that the model doesn't call toxic, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            clean = [model.score(t) < 0.5 for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scores(docs, model)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses")
