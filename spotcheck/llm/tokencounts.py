"""Token counts with the whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one token are
proven whole.  A text is cut into pre-tokens, pre-tokens that are proven whole count one
each without a merge, and only the rest is merged, each distinct one once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spotcheck.llm.frames import text_batches
from spotcheck.llm.pretokens import Encoder, whole_tokens
from spotcheck.llm.textbytes import chunks, kept_between_tasks, tidy

_encoders: dict[tuple, Encoder] = {}
kept_between_tasks.append(_encoders)


def encoder(path: str, spaces: bool, whole: dict[str, int] | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives until the worker runs a task of another kind."""
    key = (path, spaces, len(whole or ()))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, spaces, whole)
    return _encoders[key]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Bytes and tokens of each whole text, for a word-end BPE file of the tokenizers library.

    tokenizer: the file's path, readable on every executor.  limit: ``over_limit`` tells
    whether a text has more tokens.  No row is moved: one pass over the text, no shuffle.

    A null text counts as empty (0 bytes, 0 tokens); texts of any length are counted whole;
    repeated rows and null keys give a row each; an empty table gives an empty one; further
    columns are left out whatever their names.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))  # bounded by the vocabulary

    def count(batches):
        worker = encoder(tokenizer, False, whole.value)
        for batch in batches:
            sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, data, offsets in chunks(batch, "text"):
                sizes.append(np.diff(offsets))
                counts.append(worker.encode(data, offsets, want_ids=False)[0])
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("doc_id"), docs[text].cast("string").alias("text"))
    return text_batches(rows).mapInArrow(tidy(count, keep=True), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
