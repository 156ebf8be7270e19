"""Tokenizers: functions from a text column to an array of token strings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.joins import lookup_join
from ..plans.ranking import global_index

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Maximal runs without white space."""
    return F.filter(F.split(text, r"\s+"), lambda token: token != "")


def words_and_marks(text: Column) -> Column:
    """Identifiers and numbers as words, every other visible character alone."""
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), F.lit(0))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda token: token != "")


def count_and_last(tokenizer: Tokenizer, text: Column) -> tuple[Column, Column]:
    """How many tokens a text has, and its last one (null where there is none).

    Characters are counted without being taken apart.
    """
    if tokenizer is characters:
        return F.length(text), F.when(F.length(text) > 0, F.right(text, F.lit(1)))
    tokens = tokenizer(text)
    return F.size(tokens), F.try_element_at(tokens, F.lit(-1))


def token_count(tokens: Column) -> Column:
    return F.size(tokens)


def join_tokens(tokens: Column, separator: str = " ") -> Column:
    return F.array_join(tokens, separator)


def vocabulary(tokens: DataFrame, token: str = "token") -> DataFrame:
    """``(token, token_id)``: every distinct token numbered in sort order from 0."""
    return global_index(tokens.select(token).distinct(), [F.col(token)], "token_id")


def encode_ids(
    texts: DataFrame, vocab: DataFrame, key: str, tokenizer: Tokenizer = words, column: str = "Code"
) -> DataFrame:
    """``(key, ids)``: every text as the vocabulary numbers of its tokens, in order.

    A token outside the vocabulary is null. Lists are as long as their texts; a text without tokens
    has an empty list.
    """
    tokens = texts.select(key, F.posexplode_outer(tokenizer(F.col(column))).alias("pos", "token"))
    return _gather(lookup_join(tokens, vocab, ["token"], "left", [key, "pos"]), key, "token_id", "ids")


def decode_ids(encoded: DataFrame, vocab: DataFrame, key: str, separator: str = " ") -> DataFrame:
    """``(key, text)``: the tokens of the numbers, joined."""
    numbers = encoded.select(key, F.posexplode_outer("ids").alias("pos", "token_id"))
    tokens = _gather(lookup_join(numbers, vocab, ["token_id"], "left", [key, "pos"]), key, "token", "tokens")
    return tokens.select(key, join_tokens(F.col("tokens"), separator).alias("text"))


def _gather(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """The values of each text as one list in the order of their positions."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", value))))
    return rows.groupBy(key).agg(ordered.alias("_rows")).select(key, F.col(f"_rows.{value}").alias(name))
