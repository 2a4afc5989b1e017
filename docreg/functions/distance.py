"""Edit distances over code points and over words, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes run from 256 up to the surrogates at 0xD800 and go on in the planes from 0x10000 on.
_FIRST, _SURROGATES, _PLANES = 256, 0xD800, 0x10000
_MAX_WORDS = _SURROGATES - _FIRST + 0x110000 - _PLANES


def char_distance(reference: Column, hypothesis: Column) -> Column:
    return F.levenshtein(reference, hypothesis)


def words(c: Column) -> Column:
    """White-space tokens, empty ones dropped."""
    return F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def word_distance(reference: Column, hypothesis: Column) -> Column:
    """Edit distance over word tokens.

    Each distinct word of the pair gets one character, so the built-in character
    distance of the two encoded strings is the word distance. The token lists are
    bound once per row; inside a lambda they would be split again for every word.
    """
    def compare(pair: Column) -> Column:
        return _bind(F.array_distinct(F.concat(pair["ref"], pair["hyp"])), lambda d: _encoded_distance(pair, d))

    return _bind(F.struct(words(reference).alias("ref"), words(hypothesis).alias("hyp")), compare)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _encoded_distance(pair: Column, distinct: Column) -> Column:
    ref, hyp = pair["ref"], pair["hyp"]

    def encode(tokens: Column) -> Column:
        plain = F.transform(tokens, lambda w: F.array_position(distinct, w) + (_FIRST - 1))
        code = F.transform(plain, lambda c: F.lpad(F.hex(F.when(c < _SURROGATES, c).otherwise(c + (_PLANES - _SURROGATES))), 8, "0"))
        return F.decode(F.unhex(F.array_join(code, "")), "UTF-32")

    too_many = F.raise_error(F.lit(f"more than {_MAX_WORDS} distinct words in one pair"))
    return (
        F.when(ref.isNull() | hyp.isNull(), F.lit(None).cast("int"))
        .when(F.size(ref) == 0, F.size(hyp))
        .when(F.size(hyp) == 0, F.size(ref))
        .when(F.size(distinct) > _MAX_WORDS, too_many.cast("int"))
        .otherwise(F.levenshtein(encode(ref), encode(hyp)))
    )
