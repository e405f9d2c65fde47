"""Texts above a size, cut at natural boundaries by agglomerative merging."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mistrail.llm.tokens import token_starts

#: Boundaries by strength: headings of claims, claims, paragraphs, sentences; a word boundary has strength 1.
_BOUNDARIES = (
    (5, re.compile(r"\n[ \t]*(?=(?:<claims>|(?:patent )?claims?\b|what (?:is|we) claimed?\b|we claim\b|(?:patent)?ansprüche\b|revendications\b|【?特許請求の範囲)[^\n]{0,24}\n)", re.IGNORECASE)),
    (4, re.compile(r"\n[ \t]*(?=\d{1,3}[ \t]*[.)][ \t])")),
    (3, re.compile(r"\n[ \t\r]*\n\s*|\s(?=\[\d{4,5}\])")),
    (2, re.compile(r"[.!?;]['\")\]]*\s+(?=[\[(\"'A-Z0-9À-Þ])|[。！？]\s*")),
)


@dataclass(frozen=True)
class SplitModel:
    """Most tokens of a piece, and how many of them repeat the end of the piece before."""

    limit: int = 1000
    overlap: int = 64


def atoms(text: str, starts: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """First token of each atomic segment, and the strength of the boundary before it. No atom is above ``most``."""
    strength: dict[int, int] = {}
    for value, pattern in _BOUNDARIES:
        ends = [m.end() for m in pattern.finditer(text)]
        for token in np.searchsorted(starts, ends).tolist() if ends else ():
            if 0 < token < len(starts):
                strength[token] = max(strength.get(token, 0), value)
    first = [0, *sorted(strength)]
    cut, power = [], []
    for at, after in zip(first, [*first[1:], len(starts)]):
        pieces = -(-(after - at) // most)
        for i in range(max(1, pieces)):
            cut.append(at + (after - at) * i // max(1, pieces))
            power.append(strength.get(at, 0) if i == 0 else 1)
    return cut, power


def merged(cut: list[int], power: list[int], n: int, model: SplitModel) -> list[int]:
    """First tokens of the pieces.

    Adjacent segments wait in a heap by the strength of the boundary between them, then by their joint size; the weakest
    boundary goes first, as long as the two and the overlap fit the limit. Two that don't fit never will, as segments only
    grow.
    """
    end = [*cut[1:], n]
    before = list(range(-1, len(cut) - 1))
    after = [*range(1, len(cut)), -1]
    alive = [True] * len(cut)
    heap = [(power[i], end[i] - cut[i - 1], i) for i in range(1, len(cut))]
    heapq.heapify(heap)
    while heap:
        _, size, right = heapq.heappop(heap)
        if not alive[right]:
            continue
        left = before[right]
        joint = end[right] - cut[left]
        if joint != size:
            # One of the two has grown since: it waits again, behind lighter pairs.
            heapq.heappush(heap, (power[right], joint, right))
            continue
        if joint + (model.overlap if cut[left] else 0) > model.limit:
            continue
        alive[right] = False
        end[left] = end[right]
        after[left] = after[right]
        if after[right] >= 0:
            before[after[right]] = left
    return [c for c, a in zip(cut, alive) if a]


def pieces_of(text: str | None, model: SplitModel = SplitModel()) -> list[tuple[int, int, int, int]]:
    """(first token, tokens, first character, end) of each piece; all but the first begin with the overlap."""
    text = text or ""
    # A token has a character at least.
    starts = token_starts(text)
    n = len(starts)
    if n <= model.limit:
        return [(0, n, 0, len(text))]
    first = merged(*atoms(text, starts, model.limit - model.overlap), n, model)
    result = []
    for k, at in enumerate(first):
        stop = first[k + 1] if k + 1 < len(first) else n
        begin = max(0, at - model.overlap) if k else 0
        result.append((begin, stop - begin, int(starts[begin]) if k else 0, int(starts[stop]) if stop < n else len(text)))
    return result


def split_texts(documents: DataFrame, doc_id: str, text: str, model: SplitModel = SplitModel()) -> DataFrame:
    """(doc_id, piece_no, n_pieces, first_token, n_tokens, start_char, end_char, piece) of every document.

    Documents of at most ``limit`` tokens are one piece. Longer ones are cut into pieces of at most ``limit`` tokens; each
    piece after the first begins with the last ``overlap`` tokens of the one before. Cuts lie before claims, paragraphs or
    sentences where that fits, and between words only within a sentence that alone is too long.

    Method: atomic segments (sentences) are merged with their neighbours, weakest boundary first, through a heap of
    adjacent pairs. Each document is read whole by one task and in no shuffle; a text of any length takes time in
    proportion to n log n.

    Defined results: null and empty texts are one piece of 0 tokens; repeated rows are split each; null ids stay null.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece_no", pa.int32()), ("n_pieces", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("piece", pa.string())]
    )

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for low in range(0, len(ids), 512):
                rows = []
                for number, body in zip(ids[low : low + 512], texts.slice(low, 512).to_pylist()):
                    cuts = pieces_of(body, model)
                    rows.extend((number, k, len(cuts), *cut, (body or "")[cut[2] : cut[3]]) for k, cut in enumerate(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, piece_no int, n_pieces int, first_token long, n_tokens long, start_char long, end_char long, piece string"
    return documents.selectExpr(f"CAST(`{doc_id}` AS LONG) AS doc_id", f"`{text}` AS text").mapInArrow(split, ddl)
