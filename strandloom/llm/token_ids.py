"""Problem 8 as queries: ids, and sizes, of every text."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession

from ..shared import spread
from .bpe import TOKENIZERS, VOCABULARY, encoder, ragged

#: Bytes of text whose ids are held at once before they are handed to Spark.
CHUNK_BYTES = 4 << 20


def chunks(batch, column: str):
    """Slices of an Arrow batch with about CHUNK_BYTES of text each; a longer text is a slice of its own."""
    start, held = 0, 0
    sizes = [len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)]
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def token_ids(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of each row: the exact ids of the whole text without special tokens, an empty list for empty and
    null texts. Rows stay rows: repeated and null keys come out as often as they are there."""
    kind = texts.schema[key].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        e = encoder(vocabulary, folder)
        for batch in batches:
            for part in chunks(batch, text):
                ids = ragged([e.encode(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(key), ids], [key, "ids"])

    return spread(texts.select(key, text)).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


#: What ends the prompt of a text: its first blank line.
_BLANK_LINE = re.compile(r"\n\s*\n")


def prompt_of(text: str) -> str:
    """The first paragraph of a text of several, with the blank line; empty if there is no other paragraph."""
    end = _BLANK_LINE.search(text)
    return text[: end.end()] if end and text[end.end() :].strip() else ""


def token_counts(texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, folder: str = TOKENIZERS) -> DataFrame:
    """(key, n_tokens, n_prompt) of each row: the tokens of the text, and those of its prompt, which bear no loss. The ids
    themselves never leave the worker."""
    kind = texts.schema[key].dataType.simpleString()

    def count(batches):
        import pyarrow as pa

        e = encoder(vocabulary, folder)
        for batch in batches:
            n, prompt = [], []
            for t in batch.column(text):
                t = t.as_py() or ""
                first = prompt_of(t)
                parts = e.pieces(t) if first else None  # whole pieces up to the prompt's end
                n.append(sum([len(p) for _, p in parts]) if first else len(e.encode(t)))
                ends = accumulate(len(p) for p, _ in parts) if first else ()
                prompt.append(sum(len(p) for (_, p), end in zip(parts or (), ends) if end <= len(first)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(prompt, pa.int64())], [key, "n_tokens", "n_prompt"])

    return spread(texts.select(key, text)).mapInArrow(count, f"`{key}` {kind}, n_tokens long, n_prompt long")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
