"""Word tokens, word n-grams, in-word character n-grams and portable hash buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of two or more letters, digits or underscores; words for
# character n-grams are separated by any Unicode white space.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
BLANK_PATTERN = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]+"


def tokens(text: Column) -> Column:
    """Lower-cased word tokens of the whole text; empty for NULL."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0)
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` for an array-valued ``use``, evaluating ``value`` a single time per row.

    Inside a lambda Spark re-evaluates captured expressions per element, but not variables.
    """
    return F.flatten(F.transform(F.array(value), use))


def ngrams(words: Column, low: int, high: int) -> Column:
    """All n-grams of ``words`` for n in [low, high], words joined by one blank."""
    if low == high == 1:
        return words

    def of_order(bound: Column, n: int) -> Column:
        if n == 1:
            return bound
        starts = F.sequence(F.lit(0), F.size(bound) - n)
        grams = F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(bound, i + j) for j in range(n)]))
        return F.when(F.size(bound) >= n, grams).otherwise(F.array().cast("array<string>"))

    return _once(words, lambda w: reduce(F.concat, [of_order(w, n) for n in range(low, high + 1)]))


def blank_split(text: Column) -> Column:
    """Lower-cased words between blanks; empty ones at the ends are still there."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK_PATTERN)


def char_wb(text: Column, low: int, high: int) -> Column:
    """Character n-grams of each blank-padded word; a short word is emitted once."""
    words = F.filter(blank_split(text), lambda w: w != "")

    def of_word(padded: Column) -> Column:
        size = F.length(padded)

        def of_order(n: int) -> Column:
            last = F.greatest(size - (n - 1), F.lit(1))
            grams = F.transform(
                F.sequence(F.lit(1), last), lambda i: F.substring(padded, i, F.lit(n))
            )
            if n == low:
                return grams
            return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

        return reduce(F.concat, [of_order(n) for n in range(low, high + 1)])

    padded_words = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded_words, of_word))


def grams(text: Column, analyzer: str, low: int, high: int) -> Column:
    """The n-gram array of ``analyzer`` ``"word"`` or ``"char_wb"``."""
    if analyzer == "word":
        return ngrams(tokens(text), low, high)
    if analyzer == "char_wb":
        return char_wb(text, low, high)
    raise ValueError(f"unknown analyzer {analyzer!r}")


def marked_grams(text: Column, analyzer: str, low: int, high: int) -> Column:
    """The n-grams of a text as (term, new): ``new`` is 1 at one occurrence of each distinct n-gram, else 0."""

    def mark(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda g, i: F.struct(
                g.alias("term"), F.when((i > 0) & F.get(ordered, i - 1).eqNullSafe(g), 0).otherwise(1).alias("new")
            ),
        )

    return _once(F.sort_array(grams(text, analyzer, low, high)), mark)


def char_wb_list(word: str, low: int, high: int) -> list[str]:
    """What ``char_wb`` gives for one lower-cased word, inside a task."""
    padded = f" {word} "
    out = []
    for n in range(low, high + 1):
        if n == low or len(padded) >= n:
            out += [padded[i : i + n] for i in range(max(len(padded) - n, 0) + 1)]
    return out


def hash_number(text: Column) -> Column:
    """A 32-bit content hash that any SQL engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_bucket(text: Column, buckets: int) -> Column:
    return (hash_number(text) % buckets).cast("int")
