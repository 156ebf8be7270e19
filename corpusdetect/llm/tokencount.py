"""Token counts of whole texts by a compiled transducer."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .transducer import CountTransducer

LIMIT = 4096


@lru_cache(maxsize=2)
def _transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def model_path(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Counts equal the piece library's for the model at ``path`` (a file that every executor can
    open). Null and empty texts have no bytes and no tokens; null ids and repeated rows are kept; an
    empty table gives no rows. Long texts are scanned in lanes like all others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.array([len(t.encode()) for t in texts], dtype=np.int64)
            tokens = transducer.counts(texts)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
