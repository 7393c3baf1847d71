"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfolk.functions.vocabulary import NULL_WORDS, SKELETON_FROM, SKELETON_PAIRS, SKELETON_TO


def country_key(country: Column) -> Column:
    return F.lower(F.trim(F.coalesce(country, F.lit(""))))


def is_null_word(text: Column) -> Column:
    """Null, or one of the spellings of a missing value."""
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*NULL_WORDS)


def skeleton(token: Column) -> Column:
    """Consonant skeleton of a lower-case token; digits and empty tokens pass."""
    t = token
    for pair, single in SKELETON_PAIRS:
        t = F.replace(t, F.lit(pair), F.lit(single))
    t = F.concat(F.substring(t, 1, 1), F.replace(F.substring(t, 2, 1 << 20), F.lit("h"), F.lit("")))
    t = F.translate(t, SKELETON_FROM, SKELETON_TO)
    t = F.concat(F.substring(t, 1, 1), F.translate(F.substring(t, 2, 1 << 20), "aeiou", ""))
    return F.when((token == "") | token.rlike("^[0-9]+$"), token).otherwise(F.regexp_replace(t, r"(.)\1+", "$1"))


def has_native_script(text: Column) -> Column:
    """Whether a letter lies beyond Latin Extended-B."""
    return text.rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]")


def is_non_latin(text: Column) -> Column:
    """Has characters beyond ASCII and no ASCII letter."""
    return text.rlike(r"[^\x00-\x7F]") & ~text.rlike("[A-Za-z]")


def words(text: Column) -> Column:
    """Runs of letters and digits, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def retrieval_terms(name: Column, address: Column) -> Column:
    """Prefixed words of both fields, and 4-grams of the squashed name."""
    name, address = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(address, F.lit("")))
    squashed = F.regexp_replace(name, r"[^0-9a-z\x{0900}-\x{097F}]", "")
    grams = F.when(F.length(squashed) >= 4, F.transform(F.sequence(F.lit(1), F.length(squashed) - 3), lambda i: F.concat(F.lit("g:"), F.substring(squashed, i, F.lit(4)))))
    return F.concat(F.transform(words(name), lambda w: F.concat(F.lit("n:"), w)), F.transform(words(address), lambda w: F.concat(F.lit("a:"), w)), F.coalesce(grams, F.array().cast("array<string>")))


def first_house_number(numbers: Column) -> Column:
    """The first all-digit token of a space-joined list, else -1."""
    found = F.filter(F.split(F.coalesce(numbers, F.lit("")), " "), lambda t: t.rlike("^[0-9]+$"))
    return F.coalesce(F.get(found, F.lit(0)).try_cast("long"), F.lit(-1).cast("long"))


def encoder_text(name: Column, address: Column) -> Column:
    return F.concat(F.lit("query: "), F.coalesce(name, F.lit("")), F.lit(" | "), F.coalesce(address, F.lit("")))


def clipped_fields(name: Column, address: Column, country: Column, most: int = 100) -> Column:
    """One line per field, each cut to ``most`` characters, for a cross-encoder."""
    cut = lambda c: F.substring(F.coalesce(c, F.lit("")), 1, most)
    return F.concat(F.lit("name: "), cut(name), F.lit(" address: "), cut(address), F.lit(" country: "), cut(country))


def id_fold(key: Column, folds: int = 10) -> Column:
    return (F.crc32(key.cast("string").cast("binary")) % folds).cast("int")


def hash_sample(key: Column, share: float, salt: str = "dev") -> Column:
    """A predicate that keeps about ``share`` of the keys, the same ones always."""
    return F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % 1000 < int(share * 1000)
