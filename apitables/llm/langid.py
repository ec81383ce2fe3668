"""Language ID: unigram piece models per language, scored by a forward algorithm over all segmentations.

A language is a probability for each piece of a fixed public vocabulary. The likelihood of a text is the sum over all
its segmentations, so no segmentation has to be chosen. The probabilities come from expectation maximisation: in each
round the expected use of each piece, over all segmentations, is added up on the executors and normalised with
add-one smoothing; the first round starts from Zipf's law on the vocabulary's order.

The models are fitted on a bounded sample: of each language the SAMPLE_DOCS training rows that come first by a hash
of their ids, up to SAMPLE_BYTES. A model has one number for each (language, piece), whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apitables.llm.pieces import VOCABULARY, Trie, cached, pre_tokens
from apitables.llm.sampling import bounded
from apitables.llm.texts import slices
from apitables.llm.token_counts import sums
from apitables.session import materialize

SAMPLE_DOCS, SAMPLE_BYTES = 2000, 8 << 20
ROUNDS = 2
UNKNOWN = "und"


@dataclass
class Model:
    """log probabilities, a row of pieces for each language; `vocab` is the vocabulary's model file."""

    languages: list[str]
    log_p: np.ndarray
    vocab: bytes


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def fit(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", model: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Models of the languages named in `lang` on rows where `train` holds; rows without lang or letters teach nothing."""
    context = df.sparkSession.sparkContext
    file = Path(model).read_bytes()
    vocab = cached(file)
    rows = df.where(train & F.col(lang).isNotNull() & has_letter(text))
    row_id = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("h1"), F.crc32(F.col(text).cast("binary")).alias("h2")).alias("id")
    ids = rows.select(F.col(lang).cast("string").alias("kind"), row_id, F.octet_length(text).alias("size"))
    sample = materialize(bounded(ids, rows.select(row_id, F.col(text).alias("text")), sample_docs, sample_bytes))
    languages = sorted(r[0] for r in sample.select("kind").distinct().toLocalIterator())
    log_p = np.tile(vocab.log_zipf(), (len(languages), 1))
    for _ in range(ROUNDS if languages else 0):
        sent = context.broadcast(Model(languages, log_p, file))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            now = sent.value
            vocab = cached(now.vocab)
            used = np.zeros(now.log_p.shape)
            for part in slices(batches, "text"):
                tokens = pre_tokens(part.column("text"))
                trie = Trie(tokens.distinct, vocab)
                names = np.array(part.column("kind").to_pylist(), object)
                of = np.repeat(np.arange(part.num_rows), np.diff(tokens.first))
                for i, name in enumerate(now.languages):
                    weight = np.bincount(tokens.which[(names == name)[of]], minlength=len(tokens.distinct)).astype(float)
                    if weight.any():
                        score = trie.scores(now.log_p[i], vocab.byte)
                        edges = trie.expected(score, trie.forward(score), weight)
                        used[i] += np.bincount(np.maximum(trie.piece, 0), weights=np.where(trie.piece < 0, 0, edges), minlength=used.shape[1])
            lang, piece = np.nonzero(used)
            yield pa.record_batch({"lang": pa.array(lang, pa.int32()), "piece": pa.array(piece, pa.int32()), "used": pa.array(used[lang, piece])})

        found = sample.mapInArrow(expect, "lang int, piece int, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used")).toArrow()
        used = np.zeros(log_p.shape)
        used[found["lang"].to_numpy(), found["piece"].to_numpy()] = found["used"].to_numpy()
        # Byte pieces keep their Zipf weight: all languages spell unknown characters alike.
        used[:, vocab.usable] += 1
        rest = np.exp(vocab.log_zipf())
        rest[vocab.usable] = 0
        share = 1 - rest.sum()
        with np.errstate(divide="ignore"):
            log_p = np.log(used * share / used.sum(axis=1, keepdims=True) + rest)
    return Model(languages, log_p, file)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang_pred, score) for each row of `df`: the likeliest language of the whole text and its posterior probability.

    Columns named in `keep` come along, in front; they must not have the names above.

    Languages are equally likely before; of equals the first by name is taken. A text that is null or has no letter is
    `und` with score 0, and so is every text if no language was learnt. Only the text is looked at.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    read = f"kept_{text}" if text in keep else "text"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        vocab, languages = cached(model.vocab), model.languages
        for part in slices(batches, read):
            letters = part.column("letters").to_numpy(zero_copy_only=False)
            names, scores = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
            if languages:
                tokens = pre_tokens(part.column(read))
                trie = Trie(tokens.distinct, vocab)
                own = trie.forward(trie.scores(model.log_p, vocab.byte))[:, trie.terminal]
                total = sums(own[:, tokens.which], tokens.first)
                best = total.argmax(axis=0)
                posterior = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                names = np.where(letters, np.array(languages, object)[best], UNKNOWN)
                scores = np.where(letters, posterior, 0.0)
            kept = {name: part.column(f"kept_{name}") for name in keep}
            yield pa.record_batch(kept | {"id": part.column("id"), "lang_pred": pa.array(names.tolist(), pa.string()), "score": pa.array(scores)})

    kept = "".join(f"`{name}` {df.schema[name].dataType.simpleString()}, " for name in keep)
    along = [F.col(name).alias(f"kept_{name}") for name in keep]
    own = [] if text in keep else [F.col(text).alias("text")]
    rows = df.select(*along, F.col(key).alias("id"), *own, has_letter(text).alias("letters"))
    return rows.mapInArrow(score, f"{kept}id {kind}, lang_pred string, score double")
