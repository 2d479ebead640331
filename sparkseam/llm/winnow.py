"""Document fingerprints by winnowing.

Each word is hashed once; a k-gram's rolling hash is the cyclic polynomial of its K words' hashes, mixed once more so
that minima fall evenly. Grams that begin before the text take zeros, so even a one-word text has a gram. Of every
WINDOW consecutive grams the smallest hash is kept, the rightmost among equals, with its position (the index of the
gram's last word). Two texts that share K + WINDOW - 1 words in a row share a kept hash.

Hashes are compared by their upper 64 - PLACE_BITS bits; ones that agree there count as equal.

The query's neighbour (next id in ascending order, the last's is the first) comes from a table of ids alone: ranges of
ids, each in one task, and one row for each range to bridge them. Texts are shuffled once.

Defined results: null counts as empty; a text without words has an empty fingerprint, alike (1.0) only to another
such. A null id sorts first. Rows that repeat an id share a neighbour; as neighbours themselves, the smallest text
stands for the id. With one id only, it is its own neighbour. Equal hashes in a window are the ties: the rightmost
counts. Very long texts are read whole. An empty table gives an empty result. Only the id and the text are read, so other
columns' names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.llm.line_quality import let, words
from sparkseam.session import materialise

K, WINDOW = 3, 8
#: Bits of a place: a row holds two billion bytes at most, so no text has more words than this counts.
PLACE_BITS = 30
#: Ids in one range, and ids that are broadcast as a whole (about 50 bytes each); beyond it that join shuffles.
RANGE_IDS, BROADCAST_IDS = 200_000, 1_000_000


def characters(text: Column) -> Column:
    """The code points of a text (nothing for null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")


def gram_hashes(text: Column, k: int = K, units: Callable[[Column], Column] = words) -> Column:
    """array<bigint>: the hash of the k-gram that ends at each word (or other unit)."""

    def turn(h: Column, bits: int) -> Column:
        return F.shiftleft(h, bits).bitwiseOR(F.shiftrightunsigned(h, 64 - bits))

    def grams(h: Column) -> Column:
        def gram(x: Column, i: Column) -> Column:
            out = x
            for j in range(1, k):
                out = out.bitwiseXOR(F.coalesce(turn(F.get(h, i - j), 21 * j % 63 + 1), F.lit(0).cast("long")))
            return F.xxhash64(out)

        return F.transform(h, gram)

    return let(F.transform(units(text), lambda w: F.xxhash64(w)), grams)


def kept(hashes: Column, window: int = WINDOW) -> Column:
    """Ascending places of hashes (a bound array) that winnowing keeps.

    A number with the hash's upper bits above and the place, counted backwards, below: the smallest of a window then is
    its smallest hash, the rightmost among equals, with its place. Smallest numbers of 2, 4, 8... grams come from those
    of half as many, and of `window` grams from two such stretches. Kept places never go back from window to window, so
    a place that is kept again is kept by the window before.
    """
    low, n = F.lit(2**PLACE_BITS - 1).cast("long"), F.size(hashes)
    packed = F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS) + low - i)

    def places(least: Column) -> Column:
        whole = F.slice(least, F.lit(1), F.greatest(n - window + 1, F.lit(1)))
        fresh = let(whole, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))
        return F.transform(fresh, lambda x: (low - x.bitwiseAND(low)).cast("int"))

    def widened(m: Column, reach: int) -> Column:
        """m: smallest numbers of the `reach` grams from each place on; what lies behind the end is null, which least() skips."""
        if reach == window:
            return places(m)
        step = min(reach, window - reach)
        return let(F.transform(m, lambda x, i: F.least(x, F.get(m, i + step))), lambda wider: widened(wider, reach + step))

    return F.when(n > 0, let(packed, lambda p: widened(p, 1))).otherwise(F.array().cast("array<int>"))


def fingerprint(text: Column, k: int = K, window: int = WINDOW, units: Callable[[Column], Column] = words) -> Column:
    """struct<hashes, places> of a text. units: words, or characters."""
    return let(gram_hashes(text, k, units), lambda h: let(kept(h, window), lambda p: F.struct(F.transform(p, lambda i: F.get(h, i)).alias("hashes"),
        p.alias("places"))))


def fingerprint_string(print_: Column) -> Column:
    return F.array_join(F.zip_with(print_["hashes"], print_["places"], lambda h, p: F.concat(F.hex(h), F.lit(":"), p.cast("string"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash arrays, 1.0 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total)


def previous_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _rows, _before (the id before it in the ring) and _before_chars (of that id's longest text)."""
    ids = docs.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("_rows"), F.max(F.length(F.coalesce(text_col, F.lit("")))).alias("_chars"))
    n = docs.select(id_col).distinct().count()
    ids = materialise(ids.repartitionByRange(max(1, -(-n // RANGE_IDS)), F.col("_id").asc_nulls_first()).withColumn("_part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("_part").orderBy(F.col("_id").asc_nulls_first())
    ids = ids.withColumn("_row", F.row_number().over(inside)).withColumn("_own", F.lag(F.struct("_id", "_chars")).over(inside))
    # one row for each range: its last id is what the next range's first id follows
    ends = ids.groupBy("_part").agg(F.max_by(F.struct("_id", "_chars"), "_row").alias("_last"))
    ring = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("_part", F.coalesce(F.lag("_last").over(Window.orderBy("_part")), F.last("_last").over(ring)).alias("_bridge"))
    ids = ids.join(F.broadcast(ends), "_part").withColumn("_from", F.when(F.col("_row") == 1, F.col("_bridge")).otherwise(F.col("_own")))
    ids = ids.select("_id", "_rows", F.col("_from")["_id"].alias("_before"), F.col("_from")["_chars"].alias("_before_chars"))
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, _text, _next_text (as much of the next id's text as a fourth of this one), _next_hashes for every row."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    before = previous_ids(docs, id_col, text_col).withColumnRenamed("_id", "_key")
    sent = rows.join(before, rows["_id"].eqNullSafe(before["_key"]))
    once = sent.filter("_rows = 1").select("_before", "_before_chars", "_text")
    more = sent.filter("_rows > 1").groupBy("_key", "_before", "_before_chars").agg(F.min("_text").alias("_text")).select("_before", "_before_chars", "_text")
    sent = once.unionByName(more).select("_before", F.left("_text", F.floor(F.col("_before_chars") / 4).cast("int")).alias("_next_text"),
        fingerprint(F.col("_text"))["hashes"].alias("_next_hashes"))
    return rows.join(sent, rows["_id"].eqNullSafe(sent["_before"])).select("_id", "_text", "_next_text", "_next_hashes")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.length("_text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("_text", n - quarter), F.left("_next_text", quarter))
    rows = rows.select("_id", n.cast("long").alias("n_chars"), edited.alias("_edited"), fingerprint(F.col("_text")).alias("_own"), "_next_hashes")
    rows = rows.select("_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "_own", fingerprint(F.col("_edited")).alias("_other"), "_next_hashes")
    return rows.select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint_string(F.col("_own")).alias("fingerprint"),
            fingerprint_string(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_own")["hashes"], F.col("_other")["hashes"]).alias("near_edited"), likeness(F.col("_own")["hashes"],
            F.col("_next_hashes")).alias("near_next"),
    )
