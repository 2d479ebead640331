r"""Importance resampling of documents towards a target distribution.

Features of a text are its runs of `shortest` to `longest` words, hashed into BUCKETS buckets. All documents and all
target texts are counted by bucket; a bucket's gain is the floor of 1000 times the log ratio of its smoothed shares, so
weights are integers and sums don't depend on their order. A document's weight is the sum of its features' gains: its
features become bucket numbers in one flat array, the gains are taken from the array of BUCKETS gains, and segments are
summed. A Gumbel number from the hash of the id, in thousandths too, makes the highest scores a sample without
replacement.

The draw is exact, without a global sort: documents are counted by integer score; the histogram is dealt into ranges of
scores, whose sums (one row for each range) give suffix sums, and within a range the counts above a score. So each
score gets the number of documents above it, the cutoff is the score where the draw ends, and only the documents at or
above it are numbered by id within their score. A score is one of about ten thousand Gumbel thousandths for any group
of equal texts, so even a group with a third of all rows puts less than 4 of 10,000 of its rows on one score.

Counting is one pass with one row for each bucket and task; the scored rows (four numbers each) are written once.

Defined results: null texts have no words, no features and weight 0; they aren't drawn with least > 0. Ties of score go
to the smaller id (null first), then to fewer features; rows that are equal in all of these share their ranks in any
order, which gives the same rows. A null id is hashed as the empty string. Very long texts are read whole, in pieces of
PIECE words. Without target texts all T and t are 0. An empty table gives an empty result. Only the named columns are
read, so other columns' names can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.llm.batches import parts
from sparkseam.session import materialise, read_table

#: Buckets of features; words that a document needs; share drawn, in hundredths; seed of the draw.
BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 10, "2024"
#: Scores in one range of the histogram; words of a text that are worked on at once; features a worker remembers.
RANGE_SCORES, PIECE, MEMO = 5_000, 100_000, 200_000

# Bytes of a word after A-Z are lower-cased: digits, letters, and all of any character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Features:
    """Buckets of texts' features; remembers those of frequent ones."""

    def __init__(self, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS):
        self.shortest, self.longest, self.buckets = shortest, longest, buckets
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> Iterator[tuple[int, np.ndarray]]:
        """For each piece of a text its number of words and the buckets of the features that end in it."""
        found = (m[0] for m in _WORD.finditer((text or "").encode().lower()))
        before: list[bytes] = []
        while piece := list(islice(found, PIECE)):
            run = before + piece
            out = []
            for n in range(self.shortest, self.longest + 1):
                first = max(0, len(before) - n + 1)
                out.append(self.numbers(run[first:] if n == 1 else [b" ".join(run[i : i + n]) for i in range(first, len(run) - n + 1)]))
            yield len(piece), np.concatenate(out)
            before = run[len(run) - self.longest + 1 :] if self.longest > 1 else []

    def numbers(self, features: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MEMO:
            known.clear()
        for f in set(features).difference(known):
            known[f] = zlib.crc32(f) % self.buckets
        return np.fromiter(map(known.__getitem__, features), np.int64, len(features))


def bucket_counts(texts: DataFrame, text_col: str, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = Features(shortest, longest, buckets), np.zeros(buckets, np.int64)
        for batch in parts(batches):
            for text in batch.column(0).to_pylist():
                for _, b in of(text):
                    total += np.bincount(b, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares) of each bucket."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)],
        dtype=np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, shortest: int, longest: int) -> DataFrame:
    """id_col, _words, n_features, weight of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(shortest, longest, len(gain))
        for batch in parts(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                n_words = n = weight = 0
                for k, b in of(text):
                    n_words, n, weight = n_words + k, n + len(b), weight + int(gain[b].sum())
                rows.append((n_words, n, weight))
            n_words, n, weight = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (n_words, n, weight))],
                names=[id_col, "_words", "n_features", "weight"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, _words long, n_features long, weight long")


def gumbel(id_col: str, seed: str = SEED):
    """floor(-1000 * ln(-ln u)), u from the first 32 bits of sha256 of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def counts_above(scores: DataFrame, per_range: int = RANGE_SCORES) -> DataFrame:
    """score, n (its rows), above (rows with a higher score), from a column score."""
    histogram = scores.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranges = max(1, -(-histogram.count() // per_range))
    dealt = materialise(histogram.repartitionByRange(ranges, F.desc("score")).withColumn("_range", F.spark_partition_id()), "histogram")
    sums = dealt.groupBy("_range").agg(F.sum("n").alias("_rows"))
    higher = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sums = sums.select("_range", F.coalesce(F.sum("_rows").over(higher), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(sums, "_range").select("score", "n", (F.col("_before") + inside).alias("above"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", shortest: int = 1,
    longest: int = 1, buckets: int = BUCKETS, least: int = LEAST, percent: int = PERCENT, seed: str = SEED, per_range: int = RANGE_SCORES) -> DataFrame:
    """id_col, n_features, weight, score, rank of every row; rank 1, 2, ... for the drawn ones, else null."""
    gain = gains(bucket_counts(docs, text_col, shortest, longest, buckets), bucket_counts(target, target_col, shortest, longest, buckets))
    rows = weights(docs, gain, id_col, text_col, shortest, longest).withColumn("score", F.col("weight") + gumbel(id_col, seed))
    rows = materialise(rows, "scored")
    able = F.col("_words") >= least
    draw = percent * rows.filter(able).count() // 100
    above = counts_above(rows.filter(able), per_range).filter(F.col("above") < draw).select(F.col("score").alias("_score"), "above")
    above = materialise(above, "surviving")
    cutoff = above.agg(F.min("_score")).first()[0]
    if cutoff is None:  # nothing is drawn
        return rows.select(id_col, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    survives = able & (F.col("score") >= cutoff)
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.col(id_col).asc_nulls_first(), "n_features"))
    drawn = rows.filter(survives).join(above, F.col("score") == F.col("_score")).withColumn("_rank", F.col("above") + inside)
    rank = F.when(F.col("_rank") <= draw, F.col("_rank")).cast("long").alias("rank")
    rest = rows.filter(~survives).select(id_col, "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.select(id_col, "n_features", "weight", "score", rank).unionByName(rest)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: crc32 by its table of 256 entries, made from the polynomial, once for each distinct word.
ORACLE = r"""
with recursive bits as (select i as e, i::bigint as c, 0 as k from range(256) r(i)
  union all select e, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as (select list(c order by e) as t from bits where k = 8),
d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
dw as (select r, w, count(*) as n from (select r, unnest(w) as w from d) group by r, w),
bw as (select w, count(*) as n from (select unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark where text is not null) group by w),
hexes as (select w, hex(encode(w)) as x from (select w from dw union select w from bw)),
b as (select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x) // 2), lambda i: (16 * (position(x[2 * i + 1] in '0123456789ABCDEF') - 1) + position(x[2 * i + 2] in '0123456789ABCDEF') - 1)::bigint)),
    lambda c, y: xor(t[xor(c & 255, y) + 1], c >> 8)), 4294967295::bigint) % 10000 as b from hexes, crc),
s as (select b, sum(n) as n from dw join b using (w) group by b), t as (select b, sum(n) as n from bw join b using (w) group by b),
g as (select i as b, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as gain
  from range(10000) r(i) left join s on s.b = i left join t on t.b = i),
x as (select r, sum(n * gain)::bigint as weight from dw join b using (w) join g using (b) group by r),
h as (select d.r, doc_id, len(w)::bigint as n_features, coalesce(weight, 0)::bigint as weight, sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8] as h from d left join x on d.r = x.r),
u as (select r, doc_id, n_features, weight, (list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda i: (position(h[i] in '0123456789abcdef') - 1)::bigint)), lambda a, y: a * 16 + y)::double + 0.5) / 4294967296 as u from h),
c as (select *, weight + floor(-1000 * ln(-ln(u)))::bigint as score from u),
k as (select r, row_number() over (order by score desc, doc_id nulls first, n_features) as rank, count(*) over () as n from c where n_features >= 20)
select doc_id, n_features, weight, score, case when rank <= 10 * n // 100 then rank end::bigint as rank from c left join k using (r)
"""
