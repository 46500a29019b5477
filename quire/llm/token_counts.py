"""Token counts by batch encoding in Arrow functions that return lengths only.

Texts are split where no token of the byte-level pre-tokenizer can cross: before a single space that stands between two
visible characters. Each worker encodes a piece once and keeps its length (``kept`` pieces at most, then it starts
anew); batches for the library are filled by bytes, not by rows. A sentencepiece model may join words, so there texts
stay whole.

Defined cases: null and empty texts have 0 bytes and 0 tokens; special strings inside a text become their special
token, as is the library's default; repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def pieces(text: str) -> list[str]:
    """``text`` in parts whose token counts add up to that of the whole."""
    first, *rest = SAFE_CUT.split(text)
    return [first, *[f" {x}" for x in rest]]


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """A function from texts to their numbers of tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def in_batches(texts: list[str], size: int) -> Iterator[list[str]]:
    """``texts`` in lists of about ``size`` bytes."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text) if text.isascii() else len(text.encode())
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, path: str, batch_bytes: int = 1 << 20, kept: int = 400_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every text; ``path`` is a tokenizer's file."""
    cut = (lambda text: [text]) if path.endswith(".model") else pieces

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lengths = encoder(path), {}
        for batch in batches:
            ids, sizes, tokens = batch.column("doc_id").cast(pa.int64()), [], []
            for docs_part in in_batches([t or "" for t in batch.column("text").to_pylist()], batch_bytes):
                if len(lengths) > kept:
                    lengths.clear()
                parts = [cut(t) if t else [] for t in docs_part]
                new = list({x for part in parts for x in part if x not in lengths})
                for some in in_batches(new, batch_bytes):
                    lengths.update(zip(some, encode(some), strict=True))
                tokens += [sum(map(lengths.__getitem__, part)) for part in parts]
                sizes += [len(t.encode()) for t in docs_part]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(count, SCHEMA)
