"""Token counts by trie-shared dynamic programming.

The distinct pre-tokens of a slice of texts form a trie. For each prefix the best unigram forward score and its number
of pieces are computed once, from those of the shorter prefixes; the counts stored at the pre-tokens' terminals are
then added up for each text. Probabilities follow Zipf's law on the vocabulary's own order; nothing is trained.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apitables.llm.pieces import VOCABULARY, Trie, cached, pre_tokens
from apitables.llm.texts import slices


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values along the last axis; `first` has where each text begins, and the end."""
    total = np.concatenate((np.zeros((*values.shape[:-1], 1), values.dtype), np.cumsum(values, axis=-1)), axis=-1)
    return total[..., first[1:]] - total[..., first[:-1]]


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", model: str = VOCABULARY) -> DataFrame:
    """(id, n_pre_tokens, n_tokens) for each row of `df`: pieces in the likeliest segmentation of the whole text.

    Of equally likely segmentations the shortest counts. Null and empty texts have no tokens. Other columns are not
    read; repeated rows are counted each.
    """
    sent = df.sparkSession.sparkContext.broadcast(Path(model).read_bytes())
    kind = df.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = cached(sent.value)
        log_p = vocab.log_zipf()
        for part in slices(batches, "text"):
            tokens = pre_tokens(part.column("text"))
            trie = Trie(tokens.distinct, vocab)
            counts = trie.best(trie.scores(log_p, vocab.byte))[trie.terminal]
            yield pa.record_batch({"id": part.column("id"), "n_pre_tokens": pa.array(np.diff(tokens.first)), "n_tokens": pa.array(sums(counts[tokens.which], tokens.first))})

    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, n_pre_tokens bigint, n_tokens bigint")
