"""Column -> Column text functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType


def words(text: Column) -> Column:
    r"""Runs of non-space characters (an empty array for null)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def terms(text: Column) -> Column:
    """Search terms: lower case, split outside letters, digits, dots and slashes, two characters at least."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-zA-Z0-9./]+"), lambda x: F.length(x) >= 2)


#: Characters of terms that are counted at once, beyond those of one text; what stands between terms that are given as one string.
AT_ONCE, BETWEEN = 4_000_000, "\x00"
_OF_TERMS = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789./"))


def _counted(texts: pa.Array, inside: np.ndarray, least: int) -> pa.StructArray:
    """The distinct runs of bytes that are inside of each text, of some length at least, and how often each is there."""
    n, at = len(texts), np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at, here = at - at[0], inside[data]
    begins, ends = here.copy(), here.copy()
    begins[1:] &= ~here[:-1]
    ends[:-1] &= ~here[1:]
    # a run ends with its text
    whole = np.flatnonzero(np.diff(at))
    begins[at[whole]], ends[at[whole + 1] - 1] = here[at[whole]], here[at[whole + 1] - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    long = last - first >= least
    first, last = first[long], last[long]
    # runs and what lies between them share the text's bytes; every second one is a run
    edges = pa.py_buffer(np.column_stack([first, last]).ravel())
    runs = pa.LargeStringArray.from_buffers(max(0, 2 * len(first) - 1), edges, pa.py_buffer(data)).take(pa.array(np.arange(0, 2 * len(first), 2)))
    coded = runs.dictionary_encode()
    size = max(1, len(coded.dictionary))
    of, count = np.unique((np.searchsorted(at, first, side="right") - 1) * size + coded.indices.to_numpy(), return_counts=True)
    where = pa.array(np.searchsorted(of, np.arange(n + 1) * size).astype(np.int32))
    words = coded.dictionary.take(pa.array(of % size)).cast(pa.string())
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(where, words), pa.ListArray.from_arrays(where, pa.array(count.astype(np.int32)))], ["terms", "tf"])


def _counter(inside: np.ndarray, least: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            texts = texts.cast(pa.large_string()).fill_null("")
            step, out = max(1, AT_ONCE * len(texts) // max(1, texts.nbytes)), []
            for k in range(0, len(texts), step):
                out.append(_counted(texts[k : k + step], inside, least))
            yield pa.concat_arrays(out) if out else pa.array([], COUNTS)

    return run


COUNTS = pa.struct([("terms", pa.list_(pa.string())), ("tf", pa.list_(pa.int32()))])


def term_counts(text: Column, tokens=None) -> Column:
    """The distinct terms of a text and how often each is there, as (terms, tf); tokens: another way to take a text's terms than terms().

    Splitting by a pattern and counting in Spark's arrays took most of an ingest's time, so bytes are looked up in tables by an Arrow function.
    """
    schema = "struct<terms: array<string>, tf: array<int>>"
    count = lambda inside, least: F.arrow_udf(_counter(inside, least), schema, ArrowUDFType.SCALAR_ITER)
    if tokens in (None, terms):
        return count(_OF_TERMS, 2)(F.lower(F.coalesce(text, F.lit(""))))
    return count(np.arange(256) != ord(BETWEEN), 1)(F.array_join(tokens(text), BETWEEN))


def alnum_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a lambda would compute it again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits for each character; 0 for the empty string. Counts by distinct character, so nothing is exploded."""

    def of(chars: Column) -> Column:
        def part(c: Column) -> Column:
            p = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return -p * F.log2(p)

        return F.when(F.size(chars) == 0, F.lit(0.0)).otherwise(F.aggregate(F.transform(F.array_distinct(chars), part), F.lit(0.0), lambda a, x: a + x))

    return let(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?s)."), F.lit(0)), of)


def long_text_entropy(text: Column) -> Column:
    """The same for long texts: code points are sorted once, and where a run ends the next character's count begins."""
    codes = F.sort_array(F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c: F.ascii(c)))

    def of(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        part = lambda b: F.transform(b, lambda x, i: let((F.coalesce(F.get(b, i + 1), n) - x) / n, lambda p: -p * F.log2(p)))
        return let(starts, lambda b: F.aggregate(part(b), F.lit(0.0), lambda a, x: a + x))

    # the empty string splits into one empty part
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(0.0)).otherwise(let(codes, of))


#: Classes of characters that take all of a text but its other ones, and how many each has.
_CLASSES = [("[etaoinsr]+", 8), ("[a-z]+", 18), (" +", 1), ("[A-Z]+", 26), ("[0-9]+", 10)]


def entropy_bound(text: Column) -> Column:
    """Not below the entropy: that of the classes, and within each class that of equally frequent characters.

    Of other characters each may be a different one.
    """
    text = F.coalesce(text, F.lit(""))

    def part(n: Column, all_: Column, size: Column) -> Column:
        return F.when(n > 0, n / all_ * (F.log2(size) + F.log2(all_ / n))).otherwise(F.lit(0.0))

    def of(left: Column, all_: Column, rest: list[tuple[str, int]]) -> Column:
        if not rest:
            return part(F.length(left), all_, F.length(left).cast("double"))
        (pattern, size), *more = rest
        return let(F.regexp_replace(left, pattern, ""), lambda x: part(F.length(left) - F.length(x), all_, F.lit(float(size))) + of(x, all_, more))

    return let(F.length(text), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(of(text, n, _CLASSES)))


def entropy_is_above(text: Column, limit: float) -> Column:
    """Whether a text's entropy is above a limit; only texts whose bound is above it are counted by character."""
    return F.when(entropy_bound(text) + 1e-6 <= limit, F.lit(False)).otherwise(long_text_entropy(text) > limit)


def repetition(text: Column) -> Column:
    """Share of word pairs that repeat an earlier one; 0 below two words."""

    def of(w: Column) -> Column:
        # 64-bit hashes stand for the pairs: a set of longs is found by hashing, one of strings by comparing all with all
        pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(w) < 2, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(pairs)) / F.nullif(F.size(w) - 1, F.lit(0)))

    return let(words(text), of)


def windows(text: Column, size: int, overlap: int) -> Column:
    """array<string>: windows of `size` words, each beginning `size - overlap` words after the last, up to the first that reaches the end."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - overlap - 1, F.lit(0)), F.lit(size - overlap))
        return F.when(F.size(w) > 0, F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(words(text), of)


def contains_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def first_match(text: Column, cases: list[tuple[str, list[str]]], default: str) -> Column:
    """The name of the first case of which text contains a needle; text is computed once for all needles."""

    def of(t: Column) -> Column:
        out = F.lit(default)
        for name, needles in reversed(cases):
            out = F.when(contains_any(t, needles), F.lit(name)).otherwise(out)
        return out

    return let(text, of)


def chunk_id(base: Column) -> Column:
    """Letters, digits and single underscores, none at the ends, 120 characters at most."""
    out = F.regexp_replace(F.regexp_replace(base, "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")
    return F.substring(F.regexp_replace(out, "_+", "_"), 1, 120)


def token_estimate(text: Column) -> Column:
    """Tokens by words: three for every four words, one at least."""
    return F.greatest(F.lit(1), F.floor(F.size(words(text)) * 0.75)).cast("int")


def severity_rank(severity: Column, order: tuple[str, ...], default: int) -> Column:
    out = F.lit(default)
    for i, name in reversed(list(enumerate(order))):
        out = F.when(severity == name, F.lit(i)).otherwise(out)
    return out
