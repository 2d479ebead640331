r"""Quality rules: cross-document line frequency.

Every document's lines are normalised (white space runs to one space, trimmed, lower case) and hashed; for each host
the distinct documents that hold a line are counted, exact copies of one text counting once. Lines held by more than
MIN_DOCS of the host's documents and by more than MAX_SHARE of them, or by more than MAX_DOCS whatever the share, are
removed, and a document that keeps less than MIN_LEFT of its word characters is depleted and rejected. Documents that
fail the base rules are rejected as well.

Counting runs as one aggregation of (host, line hash) with map-side combination, so a host with a third of all rows is
no hot key; lines are counted for all documents and only lines above the limit go back to the documents, as one array
for each host. Arrays of BROADCAST_LINES hashes together (eight bytes each) are broadcast; beyond that the lines
themselves meet the frequent ones by shuffle, and the texts that hold any meet what was found for them. A document's own
lines and the array meet as sets, so its cost is linear in both.

Defined results: null or empty texts have no words, fail the base rules and are not kept. A null host is a host of its
own. Repeated rows count as copies of one text. Counts at a limit exactly (ties) don't pass it. Very long texts and
lines are read whole. An empty table gives an empty result. Only the named columns are read, so other columns' names
can't clash; keep_good returns all columns, and sets the length only where that column is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.session import materialise

#: A line is frequent above this many distinct texts of its host and above this share of them, or above MAX_DOCS.
MIN_DOCS, MAX_SHARE, MAX_DOCS = 20, 0.05, 1000
#: A document that keeps less than this share of its word characters is depleted.
MIN_LEFT = 0.5
BROADCAST_LINES = 1_000_000
SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text (nothing for null)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def lines(text: Column) -> Column:
    r"""The \n-split lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def _covered(starts: Column) -> Column:
    """Words in 3-word windows that begin at these ascending places."""
    return F.aggregate(starts, F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("at"),
        (a["n"] + F.least(F.lit(3), i - a["at"])).alias("n")), lambda a: a["n"])


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows found twice or more in the word array w."""

    def of(arr: Column) -> Column:
        n = F.size(arr)
        grams = F.transform(arr, lambda x, i: F.xxhash64(x, F.get(arr, i + 1), F.get(arr, i + 2)))
        return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.slice(grams, 1, F.greatest(n - 2, F.lit(1))), covered))

    def covered(h: Column) -> Column:
        # a fast sort of plain longs tells whether any window repeats; only such texts look for the places
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                lambda s: _covered(F.sort_array(F.transform(F.filter(s, lambda x, i: twin(s, x, i)), lambda x: x["i"]))))
        )

    def twin(s: Column, x: Column, i: Column) -> Column:
        return F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))

    return let(w, of)


def base(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    w, own = words(text), lines(text)
    return [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
        let(own, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(w).alias("n_repeat_words"),
    ]


def frequent_lines(docs: DataFrame, host_col: str, text_col: str, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
    max_docs: int = MAX_DOCS) -> tuple[DataFrame, DataFrame]:
    """(host, key): the hashes of the lines that too many distinct texts of a host hold; (host, text, key): all lines of all texts."""
    own = docs.select(F.col(host_col).alias("_host"), F.xxhash64(text_col).alias("_text"), F.array_distinct(F.transform(lines(F.col(text_col)),
        line_key)).alias("_keys"))
    # copies of a text collapse first: one row for each text and host, combined before the shuffle
    own = own.groupBy("_host", "_text").agg(F.first("_keys").alias("_keys"))
    texts = own.groupBy("_host").agg(F.count(F.lit(1)).alias("_texts")).withColumnRenamed("_host", "_of")
    each = own.select("_host", "_text", F.explode("_keys").alias("_key"))
    counts = each.groupBy("_host", "_key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > min_docs)
    counts = counts.join(texts, F.col("_host").eqNullSafe(F.col("_of")))
    return counts.filter((F.col("_n") > max_share * F.col("_texts")) | (F.col("_n") > max_docs)).select("_host", "_key"), each


def with_frequent(docs: DataFrame, host_col: str, text_col: str, row: str, broadcast_lines: int = BROADCAST_LINES, **limits) -> DataFrame:
    """row (a struct of all columns of docs) and _frequent: hashes of frequent lines, all of the host's or those of the text."""
    rows = docs.select(F.struct("*").alias(row))
    host, text = F.col(row)[host_col], F.xxhash64(F.col(row)[text_col])
    known, each = frequent_lines(docs, host_col, text_col, **limits)
    known = materialise(known, "frequent")
    if known.count() <= broadcast_lines:
        sets = known.groupBy(F.col("_host").alias("_at")).agg(F.collect_set("_key").alias("_frequent"))
        return rows.join(F.broadcast(sets), host.eqNullSafe(F.col("_at")), "left").select(row, "_frequent")
    known = known.withColumnsRenamed({"_host": "_h", "_key": "_k"})
    held = each.join(known, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_key") == F.col("_k")), "left_semi")
    sets = held.groupBy(F.col("_host").alias("_at"), F.col("_text").alias("_t")).agg(F.collect_set("_key").alias("_frequent"))
    return rows.join(sets, host.eqNullSafe(F.col("_at")) & (text == F.col("_t")), "left").select(row, "_frequent")


def without(text: Column, keys: Column) -> Column:
    """text without the lines whose hashes are in keys (null: none)."""
    text = F.coalesce(text, F.lit(""))
    held = F.array_intersect(F.array_distinct(F.transform(lines(text), line_key)), keys)
    rest = lambda hits: F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(hits, line_key(x)) | ~x.rlike(r"[^\x20\x09-\x0D]")),
        "\n")
    return let(held, lambda hits: F.when(F.size(hits) > 0, rest(hits)).otherwise(text))


FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_left: float = MIN_LEFT, keep: tuple[str,
    ...] = (), **limits) -> DataFrame:
    """id_col, keep columns, the base figures, base_failed, left_chars, cleaned (the text without frequent lines), kept."""
    rows = with_frequent(docs.select(*dict.fromkeys([id_col, text_col, host_col, *keep])), host_col, text_col, "_row", **limits)
    text = F.col("_row")[text_col]
    rows = rows.select(F.col("_row")[id_col].alias(id_col), *[F.col("_row")[c].alias(c) for c in keep], *base(text), without(text,
        F.col("_frequent")).alias("cleaned"))
    left = F.length(F.regexp_replace("cleaned", SPACE, "")).cast("long")
    return rows.withColumn("left_chars", left).withColumn("base_failed", F.expr(FAILED)).withColumn("kept",
        ~F.col("base_failed") & (F.col("left_chars") >= min_left * F.col("word_chars")))


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", min_left: float = MIN_LEFT,
    **limits) -> DataFrame:
    """The kept rows with all their columns, text_col without frequent lines and length_col to match where a line went."""
    rows = with_frequent(docs, host_col, text_col, "_row", **limits)
    text = F.col("_row")[text_col]
    rows = rows.select("_row", without(text, F.col("_frequent")).alias("_cleaned"), *base(text)).filter(~F.expr(FAILED))
    rows = rows.filter(F.length(F.regexp_replace("_cleaned", SPACE, "")) >= min_left * F.col("word_chars"))
    new = {text_col: F.col("_cleaned")}
    if length_col in docs.columns:
        length = F.when(F.col("_cleaned") == text, F.col("_row")[length_col]).otherwise(F.length("_cleaned"))
        new[length_col] = length.cast(docs.schema[length_col].dataType)
    return rows.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "left_chars")


ORACLE = r"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text, text as raw from documents),
w as (select r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as t from w where len(w) > 2),
t as (select r, i from (select r, i, count(*) over (partition by r, t) as n from g) where n > 1),
c as (select r, count(*) as n from (select distinct r, i + k as p from t, (values (0), (1), (2)) v(k)) group by r),
n as (select r, unnest(list_transform(list_distinct(list_transform(l, lambda x: lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))))), lambda x: x)) as line from w),
u as (select source, raw, min(r) as r from d group by source, raw),
h as (select source, count(*) as texts from u group by source),
f as (select u.source, line from u join n using (r) join h on u.source is not distinct from h.source group by u.source, line, texts having count(*) > 20 and (count(*) > 0.05 * texts or count(*) > 1000)),
k as (select d.r, sum(length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))) as n
  from d join (select r, unnest(l) as x from w) l on d.r = l.r
  where not exists (select 1 from f where f.source is not distinct from d.source and f.line = lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')))) group by d.r),
a as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, coalesce(k.n, 0)::bigint as left_chars
  from d join w using (r) left join c using (r) left join k using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and left_chars >= 0.5 * word_chars as kept, left_chars from a
"""
