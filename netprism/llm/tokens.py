"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are encoded together, and bytes of a piece of a long text.
BATCH_BYTES, PIECE_BYTES = 1 << 20, 1 << 18
#: Distinct words whose lengths a Python worker remembers.
MEMO_WORDS = 400_000
_SPACES = b" \t\n\r\x0b\x0c"
_STATE: dict[str, tuple] = {}


def load(path: str):
    """The tokenizer of a file as a function from words to lengths; special strings are handled as the library does by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core for each Spark task
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]


def pieces(text: bytes, limit: int = PIECE_BYTES) -> Iterator[bytes]:
    """Cuts a long text before ASCII white space; a run without white space stays whole."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(bytes([c]), at + 1, at + limit) for c in _SPACES)
        if end < 0:
            after = [x for x in (text.find(bytes([c]), at + limit) for c in _SPACES) if x >= 0]
            if not after:
                break
            end = min(after)
        yield text[at:end]
        at = end
    yield text[at:]


def balanced(texts: list[bytes | None], limit: int = BATCH_BYTES, piece: int = PIECE_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """(row, piece) pairs in batches of about as many bytes each."""
    batch, held = [], 0
    for row, text in enumerate(texts):
        for part in pieces(text or b"", piece):
            batch.append((row, part))
            held += len(part)
            if held >= limit:
                yield batch
                batch, held = [], 0
    if batch:
        yield batch


def token_count(text: Column, path: str, by_word: bool = True) -> Column:
    """Tokens of each whole text (null: 0).

    by_word: right for tokenizers that drop white space and never join what it parts, as the word-end BPE does: lengths then
    add up over words, each distinct word is encoded once and its length remembered within MEMO_WORDS. Otherwise whole
    texts are encoded. Binary input keeps the text as UTF-8; bytes that aren't UTF-8 count as the replacement character.
    """

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _STATE:
            _STATE[path] = (load(path), {})
        lengths, memo = _STATE[path]
        for series in batches:
            texts = series.tolist()
            out = [0] * len(texts)
            if by_word:
                for batch in balanced(texts):
                    parted = [(row, part.split()) for row, part in batch]
                    new = list({w for _, words in parted for w in words}.difference(memo))
                    if len(memo) + len(new) > MEMO_WORDS:
                        memo.clear()
                        new = list({w for _, words in parted for w in words})
                    memo.update(zip(new, lengths([w.decode("utf-8", "replace") for w in new]), strict=True))
                    for row, words in parted:
                        out[row] += sum(map(memo.__getitem__, words))
            else:
                for batch in balanced(texts, piece=1 << 62):
                    for (row, _), n in zip(batch, lengths([t.decode("utf-8", "replace") for _, t in batch]), strict=True):
                        out[row] += n
            yield pd.Series(out, dtype="int64")

    return F.coalesce(count(text.cast("binary")), F.lit(0))


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048, by_word: bool = True) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit added (columns of these names are replaced).

    Null and empty texts have 0 tokens; very long texts are cut at white space; repeated rows each get their count; an
    empty table gives no rows. The work is one scan: tables need no shuffle, and memory is bounded by a batch and the memo.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    t = docs[text]
    counted = docs.select(*[docs[c] for c in kept], F.coalesce(F.octet_length(t), F.lit(0)).cast("long").alias("n_bytes"), token_count(t, path, by_word).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
