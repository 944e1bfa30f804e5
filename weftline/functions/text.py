"""Text columns: native tokens, request splitting, key and log-line parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A token is a run of letters and digits, or one other visible character.
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("bigint")


def is_present(text: Column) -> Column:
    """Neither null nor empty; white space alone counts as present."""
    return text.isNotNull() & (text != "")


def has_last_word(text: Column) -> Column:
    return F.instr(text, " ") > 0


def last_word(text: Column) -> Column:
    """What follows the last single space (empty after a trailing space)."""
    return F.substring_index(text, " ", -1)


def before_last_word(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - F.length(last_word(text)) - 1)


def fill_blank(sentence: Column, option: Column) -> Column:
    return F.replace(sentence, F.lit("_"), option)


def keep_last(ids: Column, limit: int) -> Column:
    """The last ``limit`` elements; shorter arrays are returned whole."""
    return F.when(F.size(ids) > limit, F.slice(ids, -limit, limit)).otherwise(ids)


def zero_padded(number: Column, width: int) -> Column:
    """``%0{width}d``: pads, and never cuts a longer number."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0"))


# Answer keys and the choice each stands for.
ANSWER_KEYS = {"A": 0, "B": 1, "C": 2, "D": 3, "1": 0, "2": 1, "3": 2, "4": 3}


def answer_index(key: Column) -> Column:
    """Choice position of an answer key; null where the key is unknown."""
    table = F.create_map(*[F.lit(v) for pair in ANSWER_KEYS.items() for v in pair])
    return F.try_element_at(table, key)
