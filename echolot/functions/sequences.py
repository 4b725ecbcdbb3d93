"""Token sequences as arrays: slices, keys, n-grams and their hashes.  Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The polynomial n-gram hash.
HASH_BASE, HASH_MODULUS = 60013, 10**18 + 3


def words(text: Column) -> Column:
    """Whitespace-separated tokens of a text; a null text has a null array."""
    return F.split(F.trim(text), r"\s+")


def token_id(word: Column) -> Column:
    """A 16-bit id: the first four hex digits of the word's MD5."""
    return F.conv(F.substring(F.md5(word), 1, 4), 16, 10).cast("int")


def token_ids(text: Column) -> Column:
    return F.transform(words(text), token_id)


def first_tokens(tokens: Column, n: int) -> Column:
    return F.slice(tokens, 1, n)


def last_tokens(tokens: Column, n: int) -> Column:
    """The last n tokens; a shorter array whole (slice alone would give an empty one)."""
    return F.when(F.size(tokens) > n, F.slice(tokens, -n, n)).otherwise(tokens)


def sequence_key(tokens: Column, by: str = "_") -> Column:
    return F.array_join(tokens.cast("array<string>"), by)


def key_tokens(key: Column, by: str = "_") -> Column:
    return F.transform(F.split(key, by), lambda x: x.cast("int"))


def window_count(tokens: Column, n: int, drop_last: bool = False) -> Column:
    """How many n-grams an array has; drop_last leaves out the last one, as the corpus scan does."""
    return F.greatest(F.size(tokens) - n + (0 if drop_last else 1), F.lit(0))


def ngrams(tokens: Column, n: int, drop_last: bool = False) -> Column:
    """Array of (offset, gram).  sequence(0, -1) would count down, so an array without windows is guarded."""
    count = window_count(tokens, n, drop_last)
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(i.alias("offset"), F.slice(tokens, i + 1, n).alias("gram")))).otherwise(F.array().cast("array<struct<offset:int,gram:array<int>>>"))


def polynomial_hash(gram: Column, n: int) -> Column:
    """sum(token * HASH_BASE**i) modulo HASH_MODULUS of n tokens below 2**20.

    The powers are literals in limbs of 20 bits, so that the sums for each limb fit a long; only they are put together as decimals.
    """
    powers = [pow(HASH_BASE, i, HASH_MODULUS) for i in range(n)]
    limbs = [sum((F.get(gram, F.lit(i)).cast("long") * F.lit(p >> shift & 0xFFFFF).cast("long") for i, p in enumerate(powers)), F.lit(0).cast("long")) for shift in (0, 20, 40)]
    scaled = [limb.cast("decimal(19,0)") * F.lit(str(1 << shift)).cast("decimal(13,0)") for limb, shift in zip(limbs, (0, 20, 40), strict=True)]
    return (sum(scaled[1:], scaled[0]) % F.lit(str(HASH_MODULUS)).cast("decimal(19,0)")).cast("long")


def detokenize(tokens: Column, vocabulary: Column) -> Column:
    """Text of ids by a map from id to token."""
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.element_at(vocabulary, t), F.lit(""))), "")


def token_texts(tokens: Column, vocabulary: Column) -> Column:
    return F.transform(tokens, lambda t: F.element_at(vocabulary, t))


def normalise_text(text: Column) -> Column:
    """Newlines and tabs to spaces, runs of spaces to one, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\n\t]", " "), " +", " "))


def has_non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def count_sublist(tokens: Column, sub: Column) -> Column:
    """Occurrences of the sublist's digits in the digits of the tokens (ids are joined without a mark, as in the source); empty: length + 1."""
    text, part = sequence_key(tokens, ""), sequence_key(sub, "")
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int"))
