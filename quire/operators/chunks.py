"""Chunks of long texts, cut where a reader would."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, page_no int, chunk_no int, text string"
NAMES, ROWS = ["doc_id", "page_no", "chunk_no", "text"], 200


def windows_of(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` that end after the last sentence beyond 60 % of it, each starting ``overlap`` before the last's end."""
    if len(text) <= size:
        return [text] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            stop = max(text.rfind(mark, start, end) for mark in (". ", "? ", "! "))
            if stop - start > 0.6 * size:
                end = stop + 1
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def paragraphs_of(text: str, longest: int, least: int) -> list[str]:
    """Paragraphs at blank lines and lines that end a sentence; long ones split at sentences, short pieces merged."""
    pieces, held = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            held.append(line.strip())
        if held and (not line.strip() or line.rstrip().endswith(".")):
            paragraph, held = " ".join(held), []
            parts = re.split(r"(?<=[.!?])\s+", paragraph) if len(paragraph) > longest else [paragraph]
            for part in parts:
                while len(part) > longest:
                    cut = part.rfind(" ", 0, longest)
                    cut = cut if cut > longest // 2 else longest
                    pieces.append(part[:cut].strip())
                    part = part[cut:].strip()
                if part:
                    pieces.append(part)
    merged: list[str] = []
    for piece in pieces:
        if merged and len(merged[-1]) < least:
            merged[-1] += " " + piece
        else:
            merged.append(piece)
    return merged


def chunks(pages: DataFrame, cut, *sizes: int) -> DataFrame:
    """doc_id, page_no, chunk_no, text: every page's chunks by ``cut``; a null text has none.

    Arrow batches are worked through and given back by slices of ``ROWS`` pages, so Python holds the chunks of these and no more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [cut(t.as_py() or "", *sizes) for t in part.column("text")]
                owner = np.repeat(np.arange(part.num_rows), [len(f) for f in found])
                numbers = np.concatenate([np.arange(len(f)) for f in found]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), part.column("page_no").take(pa.array(owner)), pa.array(numbers), pa.array([piece for f in found for piece in f], pa.string())], NAMES)

    return pages.select(F.col("doc_id").cast("long"), F.col("page_no").cast("int"), "text").mapInArrow(run, SCHEMA)
