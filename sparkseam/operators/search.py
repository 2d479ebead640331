"""Vector search, keyword search, hybrid fusion and reranking.

Rankings end in a unique id so that ties have one order everywhere. A single query is a literal, not a join; a set of
queries is scored in blocks against all rows, each task keeping its own best k before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions.text import terms
from sparkseam.session import materialise

if TYPE_CHECKING:
    from sparkseam.operators.keyword_index import KeywordIndex
    from sparkseam.operators.vector_index import VectorIndex

#: Query vectors, and vectors, scored against each other at a time; bytes of query blocks that are broadcast.
QUERY_BLOCK, VECTOR_BLOCK, BROADCAST_BYTES = 512, 4096, 64 * 2**20


def l2_normalize(vector: Column) -> Column:
    """The vector at length one; a zero vector stays zero."""
    v = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.greatest(norm, F.lit(1e-10)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def length_of(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(length_of(a) * length_of(b), F.lit(1e-10))


def ranked(rows: DataFrame, score: str, k: int, id_col: str) -> DataFrame:
    """The k best rows with rank 1..k: a top-k first, so only k rows meet in the window."""
    top = rows.orderBy(F.desc(score), id_col).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", where: dict | None = None) -> DataFrame:
    """Exact cosine top-k of one query. where: equalities on columns that exist; other keys are ignored."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = equal_to(vectors, where or {})
    return ranked(rows.withColumn("score", F.round(cosine(F.col("embedding"), q), 6)), "score", k, id_col)


def equal_to(rows: DataFrame, where: dict) -> DataFrame:
    for name, value in where.items():
        if name in rows.columns:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def _blocks(rows: DataFrame, id_col: str, size: int, prefix: str) -> DataFrame:
    """Rows of `size` vectors at most: ids and unit vectors as binary."""
    names = [f"{prefix}_ids", f"{prefix}_unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                unit = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-10)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([unit.tobytes()],
                    pa.binary())], names=names)

    return rows.select(F.col(id_col).cast("long"), "embedding").mapInArrow(run, f"{names[0]} binary, {names[1]} binary")


def vector_batch_topk(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """query_id, id_col, score, rank: exact cosine top-k for every query, block against block; no side reaches the driver.

    A block pair keeps its k best for each query before the shuffle. Query blocks are broadcast while they are small,
    else the blocks' pairs are dealt out. Null ids or vectors take no part.
    """
    usable = lambda rows: rows.filter(F.col(id_col).isNotNull() & F.col("embedding").isNotNull())
    asked = materialise(_blocks(usable(queries), id_col, QUERY_BLOCK, "q"), "queries")
    size = asked.agg(F.coalesce(F.sum(F.length("q_unit")), F.lit(0))).first()[0]
    pairs = _blocks(usable(vectors), id_col, VECTOR_BLOCK, "v").crossJoin(F.broadcast(asked) if size <= broadcast_bytes else asked.hint("shuffle_replicate_nl"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, vu, q, qu in zip(*(batch.column(i) for i in range(4)), strict=True):
                own, ids = np.frombuffer(v.as_buffer(), np.int64), np.frombuffer(q.as_buffer(), np.int64)
                rows, matrix = np.frombuffer(vu.as_buffer()).reshape(len(own), -1), np.frombuffer(qu.as_buffer()).reshape(len(ids), -1)
                scores = np.round(matrix @ rows.T, 6)
                best = np.lexsort((np.broadcast_to(own, scores.shape), -scores), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(own[best].ravel()),
                    pa.array(np.take_along_axis(scores, best, 1).ravel())], names=["query_id", id_col, "score"])

    out = pairs.mapInArrow(run, f"query_id long, {id_col} long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def minmax(score: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi == lo, F.when(score > 0, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise((score - lo) / (hi - lo))


TFIDF_TOKEN = r"[a-zA-Z0-9_./-]{2,}"


def query_counts(corpus: DataFrame, query: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, dl (terms of the document), tf (map of the query's terms that it holds): one pass over the texts, written.

    What scoring reads again and again is this table, a few numbers for each document, and not the texts.
    """
    asked = F.array(*[F.lit(t) for t in dict.fromkeys(query)])
    docs = corpus.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("t"))
    docs = docs.select("id", F.size("t").alias("dl"), F.filter("t", lambda x: F.array_contains(asked, x)).alias("h"))
    tf = F.map_from_arrays(F.array_distinct("h"), F.transform(F.array_distinct("h"), lambda x: F.size(F.filter("h", lambda y: y == x))))
    return materialise(docs.select("id", "dl", tf.alias("tf")), "counts")


def bm25(corpus: DataFrame, query: list[str], id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """id, raw, score (min-max over the whole corpus) of the documents with a query term."""
    counts = query_counts(corpus, query, id_col, text_col)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return bm25_of(counts.select("id", "dl", F.explode("tf").alias("term", "tf")), stats, query, k1, b)


def bm25_of(hits: DataFrame, stats: DataFrame, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The same from postings. hits: id, dl, term, tf of the query's terms; stats: one row with n and avgdl."""
    weight = Counter(query)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # as many rows as query terms
    qtf = F.coalesce(*[F.when(F.col("term") == t, F.lit(float(n))) for t, n in weight.items()])
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = qtf * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    raw = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats)).groupBy("id").agg(F.sum(part).alias("raw"), F.first("n").alias("n"))
    span = raw.agg(F.max("raw").alias("hi"), F.when(F.count(F.lit(1)) < F.first("n"), F.lit(0.0)).otherwise(F.min("raw")).alias("lo"))
    return raw.crossJoin(F.broadcast(span)).select("id", "raw", minmax(F.col("raw"), F.col("lo"), F.col("hi")).alias("score"))


def tfidf_terms(corpus: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf (1 + ln of its count) of every document. Texts are dealt by id, so their terms are counted where they are."""
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition("id")
    rows = rows.select("id", F.regexp_extract_all(F.lower(F.coalesce("_text", F.lit(""))), F.lit(TFIDF_TOKEN), F.lit(0)).alias("t"))
    return rows.select("id", F.explode("t").alias("term")).groupBy("id", "term").agg((1 + F.ln(F.count(F.lit(1)))).alias("tf"))


def tfidf(corpus: DataFrame, query: str, id_col: str, text_col: str) -> DataFrame:
    """id, score: cosine of sublinear tf-idf vectors with smooth idf; query terms the corpus lacks are dropped."""
    tf = materialise(tfidf_terms(corpus, id_col, text_col), "tf")
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    idf = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term",
        (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    asked = query_weights(idf, query)
    hits = tf.join(F.broadcast(asked), "term").select("id", "q", (F.col("tf") * F.col("idf")).alias("w"))
    # norms need all terms of the documents that hold a query term, and of no others
    norms = tf.join(hits.select("id").distinct(), "id", "left_semi").join(idf, "term").groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2)))).alias("norm"))
    return cosine_scores(hits, norms, asked)


def query_weights(idf: DataFrame, query: str) -> DataFrame:
    """term, idf, q (tf-idf weight) of the query's terms that idf knows; as few rows as the query has terms."""
    asked = idf.sparkSession.range(1).select(F.explode(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(TFIDF_TOKEN), F.lit(0))).alias(
        "term")).groupBy("term").agg((1 + F.ln(F.count(F.lit(1)))).alias("qtf"))
    return materialise(idf.join(F.broadcast(asked), "term").select("term", "idf", (F.col("qtf") * F.col("idf")).alias("q")), "asked")


def cosine_scores(hits: DataFrame, norms: DataFrame, asked: DataFrame) -> DataFrame:
    length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("ql"))
    sums = hits.groupBy("id").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
    return sums.join(norms, "id").crossJoin(F.broadcast(length)).select("id", (F.col("s") / (F.col("norm") * F.col("ql"))).alias("score"))


def idf_overlap(corpus: DataFrame, query: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, score: the sum of idf over distinct terms that the query shares with a document."""
    counts = query_counts(corpus, query, id_col, text_col)
    hits = counts.select("id", F.explode("tf").alias("term", "tf"))
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1
    return hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(n)).groupBy("id").agg(F.sum(idf).alias("score"))


def fuse(semantic: DataFrame, keyword: DataFrame, w_semantic: float = 0.7, w_keyword: float = 0.3) -> DataFrame:
    """Full outer union of two (id, score) branches; a missing side counts as 0."""
    if not 0 <= w_semantic <= 1 or not 0 <= w_keyword <= 1:
        raise ValueError("weights lie between 0 and 1")
    s, k = semantic.select("id", F.col("score").alias("s")), keyword.select("id", F.col("score").alias("k"))
    both = s.join(k, "id", "full").select("id", F.coalesce("s", F.lit(0.0)).alias("semantic_score"), F.coalesce("k", F.lit(0.0)).alias("keyword_score"))
    return both.withColumn("final_score", F.col("semantic_score") * w_semantic + F.col("keyword_score") * w_keyword)


def fetch_size(k: int, factor: int = 3) -> int:
    return max(k * factor, 10)


def with_ties(rows: DataFrame, n: int) -> DataFrame:
    """id, score of the n best by score and of all that equal the last of these."""
    bar = rows.orderBy(F.desc("score")).limit(n).agg(F.min("score").alias("_bar"))
    return rows.crossJoin(F.broadcast(bar)).filter(F.col("score") >= F.col("_bar")).select("id", "score")


def agreed(rows: DataFrame, other: DataFrame, n: int) -> DataFrame:
    """The n best of rows (id, score); of equal ones those that the other branch has first, by its score, then by id."""
    both = rows.join(other.select("id", F.col("score").alias("_other")), "id", "left")
    return both.orderBy(F.desc("score"), F.desc_nulls_last("_other"), "id").limit(n).select("id", "score")


def hybrid(corpus: DataFrame, vectors: DataFrame, query: list[str], vector: list[float], k: int, id_col: str = "doc_id", text_col: str = "text",
    vec_id: str = "vec_id", where: dict | None = None, filter_both: bool = False, keep: int | None = None, keywords: KeywordIndex | None = None,
    cells: VectorIndex | None = None, agree: bool = False) -> DataFrame:
    """id, the two scores, final_score, rank of the k best, or of the `keep` best of the merged list. A metadata filter holds for the vector branch, and for keywords only with filter_both.

    keywords, cells: stored indexes of the corpus and the vectors, searched in place of them (keywords not with filter_both, which changes the corpus).
    agree: of rows that a branch scores equally it takes those that the other branch found too, not those with the smallest ids (not with cells);
    else, of very many equal rows, each branch may take others, and none gets both scores.
    """
    n = fetch_size(k)
    base = equal_to(corpus, where or {}) if filter_both else corpus
    words = keywords.bm25_topk(query, n) if keywords and not filter_both else bm25(base, query, id_col, text_col)
    words = words.withColumn("score", F.round("score", 6)).filter("score > 0")
    if agree:
        q = F.array(*[F.lit(float(x)) for x in vector])
        scored = equal_to(vectors, where or {}).select(F.col(vec_id).alias("id"), F.round(cosine(F.col("embedding"), q), 6).alias("score"))
        near, said = materialise(with_ties(scored, n), "near"), materialise(with_ties(words, n), "said")
        semantic, keyword = agreed(near, said, n), agreed(said, near, n)
    else:
        found = cells.topk(vector, n, where) if cells else vector_topk(vectors, vector, n, vec_id, where)
        semantic, keyword = found.select(F.col(vec_id).alias("id"), "score"), ranked(words, "score", n, "id").select("id", "score")
    return ranked(fuse(semantic, keyword).withColumn("final_score", F.round("final_score", 6)), "final_score", keep or k, "id")


def rerank(rows: DataFrame, vectors: DataFrame, query: list[float], pool: int, k: int, vec_id: str = "vec_id") -> DataFrame:
    """The `pool` best rows get (cosine + 1) / 2 as their final score, ties by the old one; the others follow in their order."""
    q = F.array(*[F.lit(float(x)) for x in query])
    joined = rows.join(vectors.select(F.col(vec_id).alias("id"), "embedding"), "id", "left")
    inside = F.col("rank") <= pool
    fresh = F.round((F.coalesce(cosine(F.col("embedding"), q), F.lit(0.0)) + 1) / 2, 6)
    out = joined.select("id", F.col("final_score").alias("base_score"), F.when(inside, fresh).alias("rerank_score"), F.when(inside,
        fresh).otherwise(F.col("final_score")).alias("final_score"), inside.cast("int").alias("_in"), F.col("rank").alias("_old"))
    order = [F.desc("_in"), F.when(F.col("_in") == 1, F.col("final_score")).otherwise(F.lit(0.0)).desc(), F.desc("base_score"), "_old", "id"]
    return out.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("id", "base_score", "rerank_score",
        "final_score", "rank")


def post_filtered(rows: DataFrame, where: Column, k: int, score: str = "final_score", id_col: str = "id") -> DataFrame:
    """The k best of over-fetched rows that pass a filter."""
    return ranked(rows.filter(where).drop("rank"), score, k, id_col)


def same_group(hits: DataFrame, corpus: DataFrame, group: str, where: Column) -> DataFrame:
    """All rows of the groups that hits lie in which pass a test; the hits themselves where none does."""
    found = corpus.join(hits.select(group).distinct(), group, "left_semi").filter(where)
    some = found.agg((F.count(F.lit(1)) > 0).alias("_some"))
    alone = corpus.join(hits.select("id"), corpus[corpus.columns[0]] == hits["id"], "left_semi").crossJoin(F.broadcast(some)).filter("not _some").drop("_some")
    return found.unionByName(alone)
