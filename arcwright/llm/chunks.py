"""Texts cut column-wise where the byte-level pattern surely cuts, so that each distinct chunk is encoded once.

Cuts are told from neighbouring bytes: between runs of letters, of digits and of signs, and
where white space begins or, after a line break, ends.  ASCII and the Latin letters that
follow it in Unicode are told apart; next to other characters, and after an apostrophe,
which may open a contraction, there is no cut and the chunk is longer.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _LINE, _OTHER = range(1, 8)
_KIND = np.zeros(256, dtype=np.uint8)  # 0: control characters, which may count as white space
_KIND[0x21:0x7F] = _SIGN
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[0x27], _KIND[0x20], _KIND[0x0A], _KIND[0x80:] = _QUOTE, _SPACE, _LINE, _OTHER

_CUT = np.zeros((8, 8), dtype=bool)  # by the kinds before and after
for _a in (_LETTER, _DIGIT, _SIGN, _QUOTE):
    _CUT[_a, [_SPACE, _LINE]] = True
    _CUT[_LINE, _a] = True
_CUT[_LETTER, [_DIGIT, _SIGN, _QUOTE]] = True
_CUT[_DIGIT, [_LETTER, _SIGN, _QUOTE]] = True
_CUT[_SIGN, [_LETTER, _DIGIT]] = True
SLICE_BYTES = 12_000_000


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each (one row at least)."""
    size = np.frombuffer(batch.column(column).fill_null("").buffers()[1], dtype=np.int32)[: batch.num_rows + 1] if batch.num_rows else np.zeros(1)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, size[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def cut_texts(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """All chunks in order, and the number of the first chunk of each text (and the end)."""
    texts = pa.concat_arrays([texts.fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    base, size = int(offsets[0]), int(offsets[-1] - offsets[0])
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[base : base + size] if size else np.zeros(0, dtype=np.uint8)
    ends = (offsets - base).astype(np.int64)
    mark = np.zeros(size + 1, dtype=bool)
    if size > 1:
        kind = _KIND[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # but for the two signs there
        kind[lead] = kind[lead + 1] = _LETTER
        mark[1:size] = _CUT[kind[:-1], kind[1:]]
        mark[lead + 1] = False
        # after a line break only where it stands alone: of more white space the pattern splits off the last
        sure = (kind >= _LETTER) & (kind <= _QUOTE)
        mark[2:size] &= (kind[1:-1] != _LINE) | sure[:-2]
        mark[1] &= bool(kind[0] != _LINE)
    mark[ends] = True
    cuts = np.flatnonzero(mark)
    first = np.searchsorted(cuts, ends)
    chunks = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return chunks, first


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[k] : starts[k] + lengths[k]]`` for k in ``pick``, side by side, and where each ends."""
    n = lengths[pick]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts[pick] - (ends - n), n) + np.arange(total)], ends


class Coded:
    """Runs of ids by chunk, side by side in one array.

    Chunks that come early are the common ones: once there are ``most`` of them, those of a
    later column are forgotten after it.
    """

    def __init__(self, code: str, most: int = 500_000):
        self.most = most
        self.at: dict[str, int] = {}
        self.flat, self.starts, self.lengths = array(code), array("q"), array("q")

    def put(self, chunks: list[str], runs: Iterable[Sequence[int]]) -> None:
        for chunk, ids in zip(chunks, runs, strict=True):
            self.at[chunk] = len(self.starts)
            self.starts.append(len(self.flat))
            self.lengths.append(len(ids))
            self.flat.extend(ids)

    def cut(self, chunks: list[str], count: int) -> None:
        """Forget ``chunks``, which came after the first ``count``."""
        for c in chunks:
            del self.at[c]
        if chunks:
            del self.flat[self.starts[count] :], self.starts[count:], self.lengths[count:]


def encode_column(texts: pa.StringArray, coded: Coded, encode: Callable[[list[str]], Iterable[Sequence[int]]]) -> list[bytes]:
    """Ids of each text as bytes; ``encode`` gets the distinct chunks that ``coded`` lacks."""
    chunks, first = cut_texts(texts)
    if not len(chunks):
        return [b""] * len(texts)
    told = chunks.dictionary_encode()
    some, kept = told.dictionary.to_pylist(), len(coded.starts)
    new = [c for c in some if c not in coded.at]
    coded.put(new, encode(new))
    pick = np.fromiter(map(coded.at.__getitem__, some), dtype=np.int64, count=len(some))[told.indices.to_numpy()]
    ids, ends = gathered(np.array(coded.flat), np.array(coded.starts), np.array(coded.lengths), pick)
    if len(coded.at) > coded.most:
        coded.cut(new, kept)
    stops = np.concatenate([[0], ends])[first]
    return [ids[a:b].tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]
