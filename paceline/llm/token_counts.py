"""Token counts without ids.

In each partition the distinct pre-tokens (a blank-led word with its punctuation
is taken as one) are given their number of pieces once and those numbers are joined to each document's pre-token frequencies; the sum
of number times frequency is the document's count.  The join is local to the
partition: a join by shuffle would write every (document, pre-token, frequency)
row, more than the texts themselves (see README).

Defined results: a null text counts as empty; a special string is one token, as
the file says; repeated rows get equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceline.llm.bpe import DEFAULT_FILE, ENTRY_BYTES, LONG_WORD, chunk_text, chunks, load
from paceline.llm.common import small, table

LIMIT = 1024
#: Bytes of pre-tokens whose piece numbers a worker remembers before it starts anew.
MEMO_BYTES = 96 << 20


class PieceCounts:
    """Pre-token -> number of pieces, counted once by the library's model."""

    def __init__(self, file: str, text_of):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(file))
        self.known: dict[str, int] = {}
        self.held = 0
        self.text_of = text_of

    def counted(self, words: list[str]) -> dict[str, int]:
        got = self.library.encode_batch_fast([self.text_of(w) for w in words], add_special_tokens=False)
        return dict(zip(words, map(len, got), strict=True))

    def total(self, frequency: Counter[str]) -> int:
        """Sum of number times frequency over a document's pre-tokens."""
        known = self.known
        new = [w for w in frequency if w not in known]
        if not new:
            return sum([known[w] * f for w, f in frequency.items()])
        fresh = self.counted(new)
        n = sum([(fresh[w] if w in fresh else known[w]) * f for w, f in frequency.items()])
        keep = {w: k for w, k in fresh.items() if len(w) <= LONG_WORD}
        self.held += sum(map(len, keep)) + ENTRY_BYTES * len(keep)
        if self.held > MEMO_BYTES:
            known.clear()
            self.held = 0
        known.update(keep)
        return n


@cache
def counts_of(file: str, cut: bool = True) -> PieceCounts:
    """For pre-tokens as ``chunks`` gives them, or else as the pattern does."""
    return PieceCounts(file, chunk_text if cut else str)


def count_tokens(docs: DataFrame, file: str = DEFAULT_FILE, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""
    if not file.endswith(".json"):
        raise ValueError("pre-tokens are defined for byte-level vocabularies (.json)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunked, plain = load(file), counts_of(file), counts_of(file, False)
        for batch in small(batches):
            sizes, tokens = [], []
            for t in batch.column(1):
                text, n = t.as_py() or "", 0
                for special, s in split.parts(text):
                    if special:
                        n += 1
                    elif (cut := chunks(s)) is None:
                        n += plain.total(Counter(split.find(s)))
                    else:
                        n += chunked.total(Counter(cut)) - len(split.line_end)
                sizes.append(len(text.encode("utf-8")))
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
