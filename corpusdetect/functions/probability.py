"""Probabilities over arrays of logits, without leaving the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A lambda evaluates everything in its body per element, so what does not
    depend on the element must be bound outside of it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _log_norm(values: Column, top: Column) -> Column:
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Log probabilities, stable for large logits."""
    scaled = F.transform(logits, lambda x: x.cast("double") / F.lit(temperature))
    return _let(
        scaled,
        lambda values: _let(
            _let(F.array_max(values), lambda top: _log_norm(values, top)),
            lambda norm: F.transform(values, lambda x: x - norm),
        ),
    )


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def same_vocabulary(logits: Column, other: Column) -> Column:
    """``logits`` cut to the smaller of the two vocabularies."""
    return F.slice(logits, 1, F.least(F.size(logits), F.size(other)))


def token_logprob(logprobs: Column, token_id: Column) -> Column:
    """Log probability of one token; null outside the vocabulary."""
    return F.get(logprobs, token_id)


def token_rank(logits: Column, token_id: Column) -> Column:
    """1-based position of the token by descending logit; ties share the best place."""
    return _let(
        F.get(logits, token_id),
        lambda own: F.size(F.filter(logits, lambda x: x > own)) + F.lit(1),
    )


def entropy(logprobs: Column) -> Column:
    return -_total(F.transform(logprobs, lambda lp: F.exp(lp) * lp))


def cross_mean(ref_logprobs: Column, logprobs: Column) -> Column:
    """Mean of ``logprobs`` under the reference distribution."""
    return _total(F.zip_with(ref_logprobs, logprobs, lambda r, lp: F.exp(r) * lp))


def cross_square(ref_logprobs: Column, logprobs: Column) -> Column:
    """Mean of the squared ``logprobs`` under the reference distribution."""
    return _total(F.zip_with(ref_logprobs, logprobs, lambda r, lp: F.exp(r) * lp * lp))


def cross_entropy(ref_logprobs: Column, logprobs: Column) -> Column:
    return -cross_mean(ref_logprobs, logprobs)


def padding_mask(token_id: Column, pad_id: int) -> Column:
    """True for real tokens."""
    return token_id != F.lit(pad_id)
