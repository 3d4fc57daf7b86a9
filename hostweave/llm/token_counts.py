"""Token counts by section: whole documents are encoded once, tokens mapped by offset.

Cutting a text first and encoding the parts gives other tokens than training
sees. So the whole text is encoded, every token gets its span of characters, and
spans are joined to the sections they overlap. A token that crosses a border is
given out by an explicit rule.
"""

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hostweave.llm.common import text_chunks

#: Which section a token belongs to that overlaps several: that of its first or last
#: character, or the one with most of its characters (the earlier one on a tie).
RULES = ("first", "last", "largest")


class ByteEncoder:
    """Ids and byte lengths of a byte-level BPE given as ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)

    def spans(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and last character of each token; tokens may share a character."""
        ids = np.array(self.encoding.encode_ordinary(text), dtype=np.int64)
        ends = np.cumsum(self.lengths[ids])
        heads = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
        character = np.cumsum(heads) - 1  # of each byte
        return character[ends - self.lengths[ids]], character[ends - 1]


@functools.cache
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for each Python worker."""
    return ByteEncoder(path, pattern)


def line_borders(text: str) -> np.ndarray:
    """Ends of a text's lines, each with its line break; they cover the whole text."""
    ends = [m.end() for m in re.finditer("\n", text)]
    return np.array(ends if ends and ends[-1] == len(text) else [*ends, len(text)], dtype=np.int64)


def attribute(
    first: np.ndarray, last: np.ndarray, borders: np.ndarray, rule: str = "first"
) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them also overlap another one.

    ``first`` and ``last`` are the tokens' characters in ascending order,
    ``borders`` the ascending ends of adjoining sections that start at 0.
    """
    low = np.searchsorted(borders, first, side="right")
    high = np.searchsorted(borders, last, side="right")
    if rule == "first":
        own = low
    elif rule == "last":
        own = high
    else:
        own = low.copy()
        starts = np.concatenate([[0], borders[:-1]])
        for i in np.flatnonzero(low != high).tolist():
            touched = np.arange(low[i], high[i] + 1)
            shared = np.minimum(borders[touched], last[i] + 1) - np.maximum(starts[touched], first[i])
            own[i] = touched[int(shared.argmax())]
    size = len(borders)
    return np.bincount(own, minlength=size), np.bincount(own[low != high], minlength=size)


def section_tokens(docs: DataFrame, ranks: str, pattern: str, rule: str = "first") -> DataFrame:
    """Rows (doc_id, section, start, end, n_tokens, n_crossing), one for each line of a text.

    Sections are the lines of a text, each with its line break, numbered from 0;
    start and end are characters, end exclusive. ``n_tokens`` sums up to the
    tokens of the whole document, ``n_crossing`` counts those of them that overlap
    another section too. Null and empty texts have one empty section without
    tokens. Repeated rows and null ids give rows of their own; other columns are
    ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(ranks, pattern)
        for (ids,), texts in text_chunks(batches, ["doc_id"], "text"):
            columns: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for at, data in enumerate(texts):
                text = data.decode()
                borders = line_borders(text)
                tokens, crossing = attribute(*encoder.spans(text, data), borders, rule)
                starts = np.concatenate([[0], borders[:-1]])
                for column, value in zip(columns, (
                        np.full(len(borders), at), np.arange(len(borders)), starts, borders,
                        tokens, crossing)):
                    column.append(value)
            at, *rest = (np.concatenate(c).astype(np.int64) for c in columns)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at)), *map(pa.array, rest)],
                names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, section bigint, start bigint, end bigint,"
        " n_tokens bigint, n_crossing bigint")
