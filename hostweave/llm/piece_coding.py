"""SentencePiece encoding and decoding with a table of distinct chunks.

White space is written as a marker, and no piece of the vocabulary has a marker
after another character. So merges never cross the start of a run of markers:
each marked word can be segmented by itself. Words repeat, so each batch of texts
is cut into chunks, every distinct chunk that is not yet known is segmented once,
and the ids are joined back by position.
"""

import functools
import gc
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hostweave.llm.common import text_chunks

MARK = "▁"
_MARK = MARK.encode()
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class PieceCoder:
    """Ids of texts, and texts of ids, equal to those of the sentencepiece library.

    ``chunks`` keeps the ids of at most ``keep`` distinct chunks and then starts
    anew; chunks of more than ``longest`` bytes are segmented each time they
    occur. Neither bound changes a result. A vocabulary whose normaliser rewrites
    characters, or with pieces that hold a marker behind another character, is
    refused: chunks of it would not be independent.
    """

    def __init__(self, path: str, keep: int = 500_000, longest: int = 100):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        self._check(pieces)
        self.breaks = not any("\n" in p for p in pieces)  # then no piece crosses a line break either
        self.surfaces = [self._surface(i, p) for i, p in enumerate(pieces)]
        self.keep, self.longest = keep, longest
        self.chunks: dict[str, bytes] = {}
        self.alone = [self.library.piece_to_id(MARK)]
        self.begin, self.end = self._packed([self.library.bos_id()]), self._packed([self.library.eos_id()])

    def _check(self, pieces: list[str]) -> None:
        odd = "Ab  \ufb01\u3000\u00bd e\u0301 \u00a0 \t\r x "
        if MARK not in pieces or self.library.decode(self.library.encode(odd)) != odd or not self.library.encode(
                "a", out_type=str)[0].startswith(MARK):
            raise ValueError("the vocabulary normalises characters or spaces; chunks need one that keeps them")
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("the vocabulary has pieces that cross a white space marker")

    def _surface(self, i: int, piece: str) -> bytes | None:
        """The bytes that an id stands for; None where the library has to decide."""
        if self.library.is_control(i) or self.library.is_unknown(i):
            return None
        if self.library.is_byte(i):
            return bytes.fromhex(_BYTE.fullmatch(piece)[1])
        return piece.replace(MARK, " ").encode()

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _segmented(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks. The library puts a marker before each text: the first one of a marked chunk
        is left to it, and for a chunk behind a line break the marker's own id is taken off again."""
        marked = [not c.startswith(b"\n") for c in chunks]
        coded = self.library.encode(
            [c.decode().replace(MARK, " ")[m:] for c, m in zip(chunks, marked)], num_threads=1)
        coded = [ids or self.alone for ids in coded]  # a chunk of one marker is an empty text
        data = np.fromiter(chain.from_iterable(coded), "<u4").tobytes()
        ends = list(accumulate(4 * len(ids) for ids in coded))
        return [data[a if m else a + 4:b] for a, b, m in zip([0, *ends], ends, marked)]

    def _heads(self, data: np.ndarray) -> np.ndarray:
        """Where a run of markers (spaces or the mark itself) or of line breaks starts."""
        gap = data == 0x20
        mark = np.flatnonzero((data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2]))
        for k in range(3):
            gap[mark + k] = True
        head = gap.copy()
        head[1:] &= ~gap[:-1]
        if self.breaks:
            line = data == 0x0A
            head[0] |= line[0]
            head[1:] |= line[1:] & ~line[:-1]
        return head

    def encode(self, texts: list[bytes], ends: bool = True) -> list[bytes]:
        """Ids of each text (UTF-8) as little-endian unsigned 32-bit integers; ``ends`` adds begin and end."""
        begin, end = (self.begin, self.end) if ends else (b"", b"")
        full = [t for t in texts if t]
        if not full:
            return [begin + end] * len(texts)
        # every text with the marker before it, one after the other; chunks are slices of these bytes
        data = b" " + b" ".join(full)
        firsts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in full])])
        head = self._heads(np.frombuffer(data, np.uint8))
        head[firsts[:-1]] = True
        cuts = np.append(np.flatnonzero(head), len(data))
        chunks = pa.Array.from_buffers(
            pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
        ).dictionary_encode()
        distinct = chunks.dictionary.to_pylist()
        if len(self.chunks) > self.keep:
            self.chunks = {}
        known = list(map(self.chunks.get, distinct))
        new = [i for i, ids in enumerate(known) if ids is None]
        for i, ids in zip(new, self._segmented([distinct[i] for i in new])):
            known[i] = ids
            if len(distinct[i]) <= self.longest:
                self.chunks[distinct[i]] = ids
        joined = pa.array(known, pa.large_binary()).take(chunks.indices)
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
        stops = offsets[np.searchsorted(cuts, firsts)].tolist()
        packed = memoryview(joined.buffers()[2])
        coded = iter([b"".join([begin, packed[a:b], end]) for a, b in zip(stops, stops[1:])])
        return [next(coded) if t else begin + end for t in texts]

    def decode(self, data: bytes) -> str:
        """The text of ids, as the library's decode gives it."""
        ids = np.frombuffer(data, dtype="<u4").tolist()
        inner = ids[ids[:1] == [self.library.bos_id()]:len(ids) - (ids[-1:] == [self.library.eos_id()])]
        try:
            text = b"".join([self.surfaces[i] for i in inner]).decode()
        except (TypeError, UnicodeDecodeError):  # unknown or control ids, bytes that are no characters
            return self.library.decode(ids)
        # the marker that encoding puts before a text; a byte piece is never one
        return text[1:] if text.startswith(" ") and not self.library.is_byte(inner[0]) else text


@functools.cache
def piece_coder(path: str) -> PieceCoder:
    """One coder for each Python worker."""
    return PieceCoder(path)


def encoded(docs: DataFrame, model: str, ends: bool = True, decode: bool = False) -> DataFrame:
    """Rows (doc_id, ids): the ids of every whole text as little-endian unsigned 32-bit integers.

    ``decode`` adds ``decoded``, the text that these ids stand for, from the same worker.

    Null and empty texts have only the begin and end ids (or none). Repeated rows
    and null ids give rows of their own; other columns are ignored. Texts of any
    length are encoded whole; a task holds about a megabyte of texts at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        gc.disable()  # the table holds many small objects and no cycles
        for (ids,), texts in text_chunks(batches, ["doc_id"], "text"):
            coded = coder.encode(texts, ends)
            columns = {"doc_id": ids, "ids": pa.array(coded, pa.binary())}
            if decode:
                columns["decoded"] = pa.array(map(coder.decode, coded), pa.string())
            yield pa.RecordBatch.from_pydict(columns)
        gc.enable()

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary" + ", decoded string" * decode)


def with_decoded(coded: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns, and the text that the packed ids of column ``ids`` stand for.

    Null ids give a null text. A column ``out`` is replaced.
    """
    kept = [c for c in coded.columns if c != out]
    kinds = dict(coded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = piece_coder(model)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(texts, pa.string())], names=[*kept, out])

    return coded.select(kept).mapInArrow(
        run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{out}` string")
