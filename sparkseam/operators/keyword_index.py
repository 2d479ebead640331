"""A stored keyword index with block bounds, and document frequencies and norms that follow every change.

Documents of a segment are dealt into blocks of BLOCK by length. A posting row holds one term in one block: the ids,
counts and lengths of its documents, and beside them the largest count and the least length. BM25 grows with the count
and falls with the length, so these two bound what a document of the block can get from the term, whatever the mean
length and the numbers of documents are by then. A top-k search reads the bounds of its terms (not the lists) first,
scores the blocks with the highest bounds, and then only those that can still reach the k-th score.

Every change (add, replace, remove) is a segment: its postings, its documents (a null length takes a document out), the
differences of document frequencies, and the difference of the two sums behind the mean length. With norms, it also
holds what changes of each document's tf-idf norm. idf is L - u with L = ln(1 + n) + 1 of the corpus and u = ln(1 + df)
of the term, so with a = (1 + ln tf)^2 a squared norm is L^2 sum(a) - 2 L sum(a u) + sum(a u^2): a new n changes no
stored sum, and a new df changes the sums of the documents that hold the term, by a (u' - u) and a (u'^2 - u^2). A
change therefore reads the postings of the terms whose df it changes, and the blocks of the documents it replaces.

`totals` is written last; a segment without its row counts for nothing and is overwritten by the next change.
Null ids aren't indexed, null texts have no terms, an id may stand once in a change.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.functions.text import BETWEEN, term_counts, terms
from sparkseam.operators.ranges import row_numbers
from sparkseam.operators.search import TFIDF_TOKEN, bm25_of, minmax, query_weights
from sparkseam.session import exists, materialise, published, remove

#: Documents in a block; blocks that a search scores at first; block numbers that are pushed to the files as literals.
BLOCK, FIRST, LITERALS = 128, 16, 500
#: Ids that are broadcast to find their texts; terms of documents that are listed at once, beyond those of one block.
BROADCAST_IDS, AT_ONCE = 1_000_000, 500_000


def tfidf_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TFIDF_TOKEN), F.lit(0))


def _lists(rows: pa.Table) -> pa.RecordBatch:
    """The posting rows of whole blocks, whose documents come as (block, id, dl, terms, tf)."""
    rows = rows.sort_by([("block", "ascending"), ("id", "ascending")]).combine_chunks()
    words = pc.split_pattern(rows["terms"].combine_chunks(), BETWEEN)
    coded = words.flatten().dictionary_encode()
    # a term's number and a document's place in one number: sorted, they are the lists in the order of their ids
    each = coded.indices.to_numpy().astype(np.int64) * rows.num_rows + pc.list_parent_indices(words).to_numpy()
    order = np.argsort(each)
    term, place = each[order] // rows.num_rows, each[order] % rows.num_rows
    tf, block, dl = rows["tf"].combine_chunks().flatten().to_numpy()[order], rows["block"].to_numpy()[place], rows["dl"].to_numpy()[place]
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[first, len(each)].astype(np.int32)
    docs = pa.StructArray.from_arrays([rows["id"].combine_chunks().take(pa.array(place)), pa.array(tf), pa.array(dl)], ["id", "tf", "dl"])
    columns = [coded.dictionary.take(pa.array(term[first])), pa.array(block[first]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, first)),
        pa.array(np.minimum.reduceat(dl, first)), pa.ListArray.from_arrays(ends, docs)]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "df", "max_tf", "min_dl", "docs"])


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of documents that come sorted by block; a few blocks are held at once."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks, held_by = batch["block"].to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(batch["tf"]).to_numpy(), dtype=np.int64)]
        cut = 0
        for at in np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]]).tolist():
            begins = at > 0 or (held and held[-1]["block"][-1].as_py() != blocks[0])  # else the block that is held goes on
            if begins and size + held_by[at] - held_by[cut] >= AT_ONCE:
                yield _lists(pa.Table.from_batches([*held, batch.slice(cut, at - cut)]))
                held, size, cut = [], 0, at
        if cut < batch.num_rows:
            held.append(batch.slice(cut))
            size += int(held_by[-1] - held_by[cut])
    if held:
        yield _lists(pa.Table.from_batches(held))


class KeywordIndex:
    """ids of type id_type in a folder of the shared store. norms: also keep tf-idf norms; tokens: the terms of a text."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str = "bigint", norms: bool = False, tokens=None):
        self.spark, self.folder, self.id_type, self.norms = spark, folder.rstrip("/"), id_type, norms
        self.tokens = tokens or (tfidf_tokens if norms else terms)

    # ---- tables

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], f"{schema}, segment int")
        return self.spark.read.schema(f"{schema}, segment int").parquet(path).filter(F.col("segment") < self.segments())

    def _write(self, rows: DataFrame, name: str, segment: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/segment={segment}")

    def segments(self) -> int:
        return published(self.spark, f"{self.folder}/totals")

    def totals(self) -> tuple[int, int]:
        """Documents, and terms in all of them."""
        return tuple(self._read("totals", "n long, dl long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def docs(self) -> DataFrame:
        """id, dl, block, segment of the documents that count."""
        rows = self._read("docs", f"id {self.id_type}, dl int, block int")
        last = rows.groupBy("id").agg(F.max_by(F.struct("dl", "block"), "segment").alias("_d"), F.max("segment").alias("segment"))
        return last.select("id", "_d.dl", "_d.block", "segment").filter("dl is not null")

    def _postings(self) -> str:
        return f"term string, block int, df int, max_tf int, min_dl int, docs array<struct<id: {self.id_type}, tf: int, dl: int>>"

    def blocks(self, asked: list[str] | None = None) -> DataFrame:
        """Posting rows, of some terms only: the filter reaches the files, each of which is sorted by term."""
        rows = self._read("postings", self._postings())
        return rows if asked is None else rows.filter(F.col("term").isin(list(asked)))

    def df(self) -> DataFrame:
        """term, df of the documents that count."""
        return self._read("df", "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def postings(self, asked: list[str] | None = None) -> DataFrame:
        """id, term, tf, dl, segment of the documents that count."""
        return self._live(self.blocks(asked)).select("id", "term", "tf", "dl", "segment")

    def _live(self, blocks: DataFrame) -> DataFrame:
        rows = blocks.select("term", "block", "segment", F.inline("docs"))
        return rows.join(self.docs().select("id", "segment"), ["id", "segment"], "left_semi") if self.segments() > 1 else rows

    # ---- changes

    def add(self, corpus: DataFrame, id_col: str, text_col: str) -> None:
        rows = corpus.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), term_counts(F.col(text_col), self.tokens).alias("t"))
        # one string takes half the bytes of an array
        rows = rows.select("id", F.array_join("t.terms", BETWEEN).alias("terms"), "t.tf", F.aggregate("t.tf", F.lit(0), lambda a, x: a + x).alias("dl"))
        rows = materialise(rows, "terms")
        twice = rows.groupBy("id").count().filter("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"id {twice[0]['id']} stands more than once in a change")
        self._change(rows)

    def remove(self, ids: DataFrame, id_col: str) -> None:
        gone = ids.select(F.col(id_col).alias("id")).distinct()
        self._change(gone.select("id", F.lit("").alias("terms"), F.array().cast("array<int>").alias("tf"), F.lit(None).cast("int").alias("dl")))

    def clear(self) -> None:
        remove(self.spark, self.folder)

    def _change(self, rows: DataFrame) -> None:
        segment = self.segments()
        fresh = rows.filter("dl is not null")
        placed = row_numbers(fresh.select("id", "dl"), [F.col("dl"), F.col("id")], "_n").select("id", "dl", F.expr(f"int((_n - 1) div {BLOCK})").alias("block"))
        placed = materialise(placed.unionByName(rows.filter("dl is null").select("id", "dl", F.lit(None).cast("int").alias("block"))), "placed")
        # the documents of a block meet in one task and stay there: their terms are counted and listed without another shuffle
        dealt = fresh.filter("dl > 0").select("id", "terms", "tf").join(placed.filter("block is not null"), "id").select("block", "id", "dl", "terms", "tf")
        lists = dealt.repartition("block").sortWithinPartitions("block").mapInArrow(listed, self._postings())
        self._write(lists.sortWithinPartitions("term", "block"), "postings", segment)
        lists = self.spark.read.schema(self._postings()).parquet(f"{self.folder}/postings/segment={segment}")

        # what gives way, and how many of it each list held
        old = self.docs().join(placed.select("id"), "id", "left_semi")
        old = materialise(old, "old") if segment else old.limit(0)
        count = lambda t: t.agg(F.count("dl"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        (n, dl), (n_old, dl_old) = count(placed), count(old)
        if n_old <= BROADCAST_IDS:
            lost = self.blocks().select("term", "segment", F.explode("docs.id").alias("id"))
            lost = lost.join(F.broadcast(old.select("id", "segment")), ["id", "segment"], "left_semi").select("term", F.lit(1).alias("df"))
        else:  # a block's ids meet its lists, whose rows are moved once each
            gone = old.groupBy("segment", "block").agg(F.collect_list("id").alias("_gone"))  # BLOCK ids at most
            lost = self.blocks().select("term", "segment", "block", F.col("docs.id").alias("_ids")).join(gone, ["segment", "block"])
            lost = lost.select("term", F.size(F.array_intersect("_gone", "_ids")).alias("df")).filter("df > 0")
        # was: documents that held the term before; df: how many more do now; held: by the new ones
        of = lambda rows, was, df, held: rows.select("term", *[(x if isinstance(x, Column) else F.lit(x)).cast("long").alias(n)
            for n, x in (("was", was), ("df", df), ("held", held))])
        change = of(lists, 0, F.col("df"), 1).unionByName(of(lost, 0, -F.col("df"), 0))
        if self.norms:
            change = change.unionByName(of(self._read("df", "term string, df long"), F.col("df"), 0, 0))
        change = change.groupBy("term").agg(F.sum("was").alias("was"), F.sum("df").alias("df"), F.max("held").alias("held")).filter("df <> 0 or held > 0")
        if self.norms:
            change = materialise(change, "changed")
            self._follow(lists, old, change, segment)
        self._write(change.filter("df <> 0").select("term", "df"), "df", segment)
        self._write(placed, "docs", segment)
        self._write(self.spark.range(1).select(F.lit(n - n_old).cast("long").alias("n"), F.lit(dl - dl_old).cast("long").alias("dl")), "totals", segment)

    def _follow(self, lists: DataFrame, old: DataFrame, change: DataFrame, segment: int) -> None:
        """Writes the sums of new documents, and what changes in those of the others.

        Lists go to their terms' numbers and back to their blocks as they are, so that a row that is shuffled is a list and not a document's
        term. Of new documents all terms count, those too whose df is as before, since as many documents lost them.
        """
        all_ = self.blocks().unionByName(lists.withColumn("segment", F.lit(segment)))
        each = all_.select("segment", "block", "term", F.col("docs.id").alias("id"), F.col("docs.tf").alias("tf")).join(change, "term")
        each = each.filter(f"df <> 0 or segment = {segment}")
        each = each.select("segment", "block", "id", "tf", F.when(F.col("segment") < segment, F.col("was")).cast("int").alias("was"), (F.col("was") + F.col(
            "df")).cast("int").alias("now")).repartition("segment", "block").select("segment", "block", "was", "now", F.inline(F.arrays_zip("id", "tf")))
        u, v = F.coalesce(F.ln(1 + F.col("was")), F.lit(0.0)), F.ln(1 + F.col("now"))
        a = F.pow(1 + F.ln("tf"), F.lit(2))
        sums = each.groupBy("segment", "block", "id").agg(F.sum(F.when(F.col("segment") == segment, a).otherwise(0.0)).alias("s0"), F.sum(a * (v - u)).alias("s1"),
            F.sum(a * (v * v - u * u)).alias("s2"))
        sums = materialise(sums.select("id", F.col("segment").alias("of"), "s0", "s1", "s2"), "sums")
        # of the others only those count that are still there
        named = lambda rows: rows.select("id", F.col("segment").alias("of"))
        stay = sums.filter(f"of < {segment}").join(named(self.docs()), ["id", "of"], "left_semi").join(named(old), ["id", "of"], "left_anti")
        self._write(stay.unionByName(sums.filter(f"of = {segment}")), "norms", segment)

    def sync(self, corpus: DataFrame, id_col: str, text_col: str, hash_col: str | None = None, texts: DataFrame | None = None) -> bool:
        """Brings the index to a corpus if its (count, sum of the hashes of ids and texts) isn't the one it holds; says whether it did.

        Only documents that are new, gone or changed are indexed again. hash_col: a hash of the text that stands for it, so that texts that are
        known aren't read. texts: a table that holds the corpus's ids and texts, each id once, and maybe others; texts are taken from there.
        """
        key = lambda i, t: F.xxhash64(i, F.coalesce(t, F.lit("")))
        named = lambda rows, *more: rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *more)
        kept = named(corpus, key(F.col(id_col), F.col(hash_col or text_col)).alias("key"))
        kept = materialise(kept, "state") if hash_col else kept
        state = kept.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("key").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
        path = f"{self.folder}/state"
        was = self.spark.read.parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], f"id {self.id_type}, key long")
        had = was.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("key").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()
        if state == had and (state["n"] or exists(self.spark, path)):
            return False
        kept = kept if hash_col else materialise(kept, "state")
        gone = materialise(was.join(kept, "id", "left_anti").select("id"), "gone")
        now = named(corpus if texts is None else texts, F.col(text_col).alias("text"))
        if had["n"] or texts is not None:  # ids alone are compared; texts meet only those of what is new
            fresh = materialise(kept.join(was, ["id", "key"], "left_anti").select("id"), "fresh")
            now = now.join(F.broadcast(fresh) if fresh.count() <= BROADCAST_IDS else fresh, "id", "left_semi")
        self.add(now, "id", "text")
        if not gone.isEmpty():
            self.remove(gone, "id")
        kept.write.mode("overwrite").parquet(path)
        return True

    # ---- BM25

    def bm25(self, query: list[str], k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """id, raw, score of all documents with a query term, as search.bm25 over the indexed documents."""
        n, dl = self.totals()
        stats = self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(dl / max(1, n)).alias("avgdl"))
        return bm25_of(self.postings(list(dict.fromkeys(query))).select("id", "dl", "term", "tf"), stats, query, k1, b)

    def bm25_topk(self, query: list[str], k: int, k1: float = 1.5, b: float = 0.75, first: int = FIRST) -> DataFrame:
        """id, raw, score of documents among which are the k best by score rounded to six digits: the blocks that can't reach the k-th aren't scored."""
        n, dl = self.totals()
        asked = Counter(query)
        df = {r["term"]: r["df"] for r in self.df().filter(F.col("term").isin(list(asked))).collect()}  # a row for each query term
        if not df:
            return self.spark.createDataFrame([], f"id {self.id_type}, raw double, score double")
        weights = {t: asked[t] * F.ln(F.lit(1 + (n - df[t] + 0.5) / (df[t] + 0.5))) for t in df}
        weight = F.coalesce(*[F.when(F.col("term") == t, w) for t, w in weights.items()])
        part = lambda tf, dl_: weight * F.col(tf) * (k1 + 1) / (F.col(tf) + k1 * (1 - b + b * F.col(dl_) / (dl / max(1, n))))
        lists = self.blocks(list(df))
        bounds = lists.groupBy("segment", "block").agg(F.sum(part("max_tf", "min_dl")).alias("bound"), F.sum("df").alias("held"))
        bounds = materialise(bounds, "bounds")

        def scored(some: DataFrame) -> DataFrame:
            chosen = some.select("segment", "block")
            near = chosen.limit(LITERALS + 1).collect()
            rows = lists.filter(F.col("block").isin(sorted({r["block"] for r in near}))) if len(near) <= LITERALS else lists
            rows = rows.join(chosen, ["segment", "block"], "left_semi")
            return self._live(rows).groupBy("id").agg(F.sum(part("tf", "dl")).alias("raw"))

        all_, top = bounds.agg(F.count(F.lit(1)), F.max("bound")).first()
        best: list = []
        while len(best) < k:
            best = scored(bounds.orderBy(F.desc("bound"), "segment", "block").limit(first)).orderBy(F.desc("raw")).limit(k).select("raw").collect()
            if first >= all_:
                break
            first *= 4
        # scores that are equal when rounded may differ by this much
        bar = best[-1]["raw"] - 2e-6 * top if len(best) == k else -1.0
        self.scored_blocks = (bounds.filter(F.col("bound") >= bar).count(), all_)
        raw = scored(bounds.filter(F.col("bound") >= bar))
        low = 0.0 if self._some_without(lists, bounds, sum(df.values()), n) else self.bm25(query, k1, b).agg(F.min("raw")).first()[0]
        raw = materialise(raw, "raw")
        high = raw.agg(F.max("raw")).first()[0]
        return raw.select("id", "raw", minmax(F.col("raw"), F.lit(low), F.lit(high)).alias("score"))

    def _some_without(self, lists: DataFrame, bounds: DataFrame, total: int, n: int) -> bool:
        """Whether a document holds none of the query's terms: by the sums of df, else by a block's, else by counting."""
        if total < n:
            return True
        live = self.docs().groupBy("segment", "block").agg(F.count(F.lit(1)).alias("n"))
        if not live.join(bounds, ["segment", "block"], "left").filter("n > coalesce(held, 0)").isEmpty():
            return True
        return self._live(lists).select("id").distinct().count() < n

    # ---- tf-idf

    def tfidf(self, query: str) -> DataFrame:
        """id, score of the documents with a query term, as search.tfidf over the indexed documents; only their norms are summed."""
        if not self.norms:
            raise ValueError("this index keeps no norms")
        n, _ = self.totals()
        idf = self.df().select("term", (F.ln(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf"))
        asked = query_weights(idf, query)
        names = [r[0] for r in asked.select("term").collect()]  # the query's own terms
        hits = self.postings(names).join(F.broadcast(asked), "term")
        sums = hits.groupBy("id", "segment").agg(F.sum((1 + F.ln("tf")) * F.col("idf") * F.col("q")).alias("s"))
        parts = self._read("norms", f"id {self.id_type}, of int, s0 double, s1 double, s2 double")
        parts = parts.join(sums.select("id", F.col("segment").alias("of")), ["id", "of"], "left_semi")
        top = F.lit(1.0 + n)
        large = F.ln(top) + 1
        norm = F.sqrt(large * large * F.sum("s0") - 2 * large * F.sum("s1") + F.sum("s2"))
        norms = parts.groupBy("id").agg(norm.alias("norm"))
        length = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("ql"))
        return sums.join(norms, "id").crossJoin(F.broadcast(length)).select("id", (F.col("s") / (F.col("norm") * F.col("ql"))).alias("score"))
