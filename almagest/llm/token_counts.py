"""Token counts of sections, from tokens of whole documents.

Each document is encoded once as a whole. The bytes that tokens stand for give every token its span, and
spans are joined with the sections they meet. A token that crosses a boundary is allocated by a stated rule.
"""

from __future__ import annotations

import base64
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.llm.common import text_slices

# Pattern that parts text before byte pairs merge; it belongs to the vocabulary. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
# A token belongs to the section of its first byte; to the one that holds most of its bytes, the first of
# equals; or to each by its share of bytes.
RULES = ("first", "most", "share")

_ROWS = "doc_id long, section long, start long, end long, n_tokens double, n_crossing long, doc_tokens long"


def line_sections(data: np.ndarray) -> np.ndarray:
    """Where lines begin in a text's bytes; a line holds its line feed. An empty text is one empty section."""
    ends = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], ends[ends < len(data)]])


def allocated(edges: np.ndarray, sections: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens per section, tokens that begin in a section and end beyond it). ``edges``: where tokens begin, then the end."""
    begin, end = edges[:-1], edges[1:]
    first = np.searchsorted(sections, begin, "right") - 1
    last = np.searchsorted(sections, end - 1, "right") - 1
    crossing = last > first
    across = np.bincount(first[crossing], minlength=len(sections))
    if rule == "first":
        return np.bincount(first, minlength=len(sections)).astype(float), across
    counts = np.bincount(first[~crossing], minlength=len(sections)).astype(float)
    stops = np.append(sections[1:], size)
    for t in np.flatnonzero(crossing).tolist():
        met = np.arange(first[t], last[t] + 1)
        held = np.minimum(stops[met], end[t]) - np.maximum(sections[met], begin[t])
        if rule == "most":
            counts[met[int(np.argmax(held))]] += 1
        else:
            counts[met] += held / held.sum()
    return counts, across


def _counter(shared, rule: str):
    def count(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines())}
        encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        for batch in batches:
            ids, done = batch.column("doc_id"), 0
            for data, offsets in text_slices(batch.column("text")):
                parts, owner = [], []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    own = data[a:b]
                    tokens = np.array(encoding.encode_ordinary(own.tobytes().decode()), np.int64)
                    edges = np.concatenate([[0], np.cumsum(lengths[tokens])])
                    sections = line_sections(own)
                    counts, across = allocated(edges, sections, len(own), rule)
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    stops = np.append(sections[1:], len(own))
                    n = len(sections)
                    parts.append((np.arange(n), chars[sections], chars[stops], counts, across, np.full(n, len(tokens))))
                    owner.append(np.full(n, done + k))
                done += len(offsets) - 1
                columns = [np.concatenate(x) for x in zip(*parts)]
                keys = ids.take(pa.array(np.concatenate(owner)))
                yield pa.RecordBatch.from_arrays(
                    [keys, *(pa.array(c) for c in columns)], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing", "doc_tokens"]
                )

    return count


def sections(docs: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", rule: str = "first") -> DataFrame:
    """One row per line of every document: doc_id, section (from 0), start, end (code points, end exclusive),
    n_tokens, n_crossing, doc_tokens.

    ``vocabulary`` is a file of byte-pair ranks on the driver, sent to tasks (one or two MB). Tokens of a
    document's sections add up to ``doc_tokens`` under every rule. Null and empty texts have one empty section and no
    tokens. Repeated rows are counted each; other columns are not read; an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_counter(shared, rule), _ROWS)
