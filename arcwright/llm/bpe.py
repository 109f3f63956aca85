"""Byte-level BPE: ranked merges, and decoding by putting binary pieces together.

Texts go in slices of bounded size through three steps of one stage, without a shuffle.  The
first cuts a slice by the tokenizer's pattern: for each text the numbers of its pieces, and the
pieces that its task has not met before as single bytes.  The second encodes these by a
fold of Spark's higher-order functions, which merges the leftmost pair of least rank until
no pair has one; the pairs that merge stand in a literal.  The third puts the texts' ids together.

The first and the third step keep a task's pieces from slice to slice, so a task folds each of
them once.  They keep about KEPT_BYTES at most; the pieces of a slice that finds no room are
forgotten after it and folded anew when they come again.

A fold takes time with the square of a piece's length, so pieces of more than FOLD_BYTES
bytes are merged by the same ranks over a heap when they are cut.
"""

from __future__ import annotations

import base64
import heapq
import json
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.llm.chunks import cut_texts, gathered, slices

FOLD_BYTES = 256
SLICE_BYTES = 1_000_000  # of text, whose new pieces stand in one row
KEPT_BYTES = 24_000_000  # of the pieces that a task keeps, PIECE_BYTES added for each
PIECE_BYTES = 100
ID_BITS = 20  # ids of a vocabulary are below 2 ** ID_BITS
NONE = 1 << ID_BITS  # stands for the id of a pair that does not merge


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 and a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _let(value: Column, body) -> Column:
    """Bind ``value`` once: a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _merged(pairs: Column, left: Column, right: Column) -> Column:
    """The id that two ids merge to, or NONE; NONE also where the left or the right one is null."""
    return F.least(F.get(pairs["merged"], F.get(pairs["at"], left) + right).bitwiseXOR(F.shiftleft(left, ID_BITS)), F.lit(NONE))


def fold_ids(ids: Column, pairs: Column) -> Column:
    """array<bigint>: ``ids`` of one piece, merged until no pair of neighbours merges."""
    start = F.transform(ids, lambda x, i: _packed(_merged(pairs, x, F.get(ids, i + 1)), F.shiftleft(i.cast("bigint"), ID_BITS) + x))
    return F.when(F.size(ids) > 1, F.transform(fold_packed(start, pairs), _own)).otherwise(ids)


def _own(x: Column) -> Column:
    return x.bitwiseAND(NONE - 1)


def _packed(rank: Column, rest: Column) -> Column:
    return F.shiftleft(rank, 2 * ID_BITS) + rest


def fold_packed(start: Column, pairs: Column) -> Column:
    """The same on packed numbers: for each token the id it merges to with the next one, its index and its id.

    Packed in this order, the least number is the leftmost pair of least rank and tells where
    it stands (array_position leaves its loop by an exception, which costs more than all the
    rest of a step); the tokens after a merge move up by one index.
    """
    one = F.lit(1 << ID_BITS)

    def step(acc: Column, _: Column) -> Column:
        def merge(low: Column, i: Column) -> Column:
            before, after = F.get(acc, i - 1), F.get(acc, i + 2)
            new = F.shiftright(low, 2 * ID_BITS)
            turned = _packed(_merged(pairs, _own(before), new), before.bitwiseAND((1 << 2 * ID_BITS) - 1))
            here = _packed(_merged(pairs, new, _own(after)), low.bitwiseAND(NONE - 1 << ID_BITS) + new)
            rest = F.transform(F.slice(acc, i + 3, F.size(acc)), lambda x: x - one)
            return F.when(i > 0, F.flatten(F.array(F.slice(acc, F.lit(1), i - 1), F.array(turned, here), rest))).otherwise(F.flatten(F.array(F.array(here), rest)))

        found = lambda low: _let(_own(F.shiftright(low, ID_BITS)).cast("int"), lambda i: merge(low, i))
        return _let(F.array_min(acc), lambda low: F.when(low < NONE << 2 * ID_BITS, found(low)).otherwise(acc))

    last = F.size(start) - 1
    return F.when(F.array_min(start) < NONE << 2 * ID_BITS, F.aggregate(F.sequence(F.lit(1), last), start, step)).otherwise(start)


def word_ids(word: Column, pairs: Column) -> Column:
    """Ids of a piece written with a character for each of its bytes."""
    letters = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.get(pairs["bytes"], F.ascii(F.substring(word, i, F.lit(1)))))
    return _let(letters, lambda ids: fold_ids(ids, pairs))


def _as_bytes(text: Column) -> Column:
    """A string with one character (U+0000 to U+00FF) for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


class Vocabulary:
    """Ranks by token, and the literal that the fold needs."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= NONE:
            raise ValueError(f"ids of 2 ** {ID_BITS} or more")
        self.ranks = ranks

    def rank_map(self) -> Column:
        """Ids of single bytes, and the pairs that merge: ``merged`` has a pair's left id and result at the place ``at`` of the left id plus the right id.

        A token has one such pair, since its bytes merge by themselves as they do between others.
        """
        rows: dict[int, dict[int, int]] = {}
        for token, rank in self.ranks.items():
            if (pair := self._last_merge(token)) is not None:
                rows.setdefault(pair[0], {})[pair[1]] = rank
        at, merged = _displaced(rows, _count(self.ranks))
        single = [self.ranks.get(bytes([i])) for i in range(256)]
        told = json.dumps({"bytes": single, "at": at, "merged": merged}, separators=(",", ":"))
        return F.from_json(F.lit(told), "struct<bytes:array<bigint>,at:array<bigint>,merged:array<bigint>>")

    def _last_merge(self, token: bytes) -> tuple[int, int] | None:
        """The two ids that a token's bytes come down to; None for a single byte, or if they stop before."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            low, i = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(pairwise(parts)))
            if low == NONE:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        left, right = (self.ranks.get(x) for x in parts) if len(parts) == 2 else (None, None)
        return None if left is None or right is None else (left, right)


def _displaced(rows: dict[int, dict[int, int]], ids: int) -> tuple[list[int], list[int]]:
    """Sparse rows laid over each other in one table, the fullest first, each where its entries meet free cells."""
    empty = NONE << ID_BITS  # no left id is NONE
    at, merged = [0] * ids, np.full(2 * ids + 512, empty, dtype=np.int64)
    start, full = 0, 0
    for left, row in sorted(rows.items(), key=lambda x: -len(x[1])):
        rights = np.array(list(row))
        if 2 * len(row) <= full:  # among the rows of half the size, the search starts anew
            start, full = 0, len(row)
        full, step = full or len(row), 32 if len(row) < 8 else 256
        while True:
            if start + step + ids > len(merged):
                merged = np.concatenate([merged, np.full(ids, empty, dtype=np.int64)])
            fits = (merged[start + np.arange(step)[:, None] + rights] == empty).all(axis=1)
            if fits.any():
                break
            start += step
        start += int(fits.argmax())
        at[left] = start
        merged[start + rights] = [left << ID_BITS | x for x in row.values()]
    return at, merged[: max(at, default=0) + ids].tolist()


def heap_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for a long piece: a linked list and a heap of (rank, place)."""
    if piece in ranks:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
    heap = [(ranks[piece[i : i + 2]], i, 2) for i in range(len(parts) - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        right[i] = right[j]
        if right[i] < len(parts):
            left[right[i]] = i
        for a, b in ((left[i], i), (i, right[i])):
            if a >= 0 and b < len(parts):
                pair = parts[a] + parts[b]
                if pair in ranks:
                    heapq.heappush(heap, (ranks[pair], a, len(pair)))
    return [ranks[p] for p in parts if p is not None]


class _Pieces:
    """Numbers of a task's pieces: a token's is its id, the others follow in order of arrival.

    ``at`` holds the number of a chunk that is one piece, and a tuple of them for any other.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, room: int):
        self.ranks, self.cut, self.room = ranks, regex.compile(pattern), room
        self.single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        self.pair = np.full(1 << 16, NONE, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pair[token[0] << 8 | token[1]] = rank
        self.at: dict[str, int | tuple[int, ...]] = {}
        self.next = _count(ranks)

    def numbers(self, chunks: list[str]) -> tuple[array, array, list[bytes], bool]:
        """The numbers of a slice's chunks side by side, how many each has, its new pieces, and whether they are kept."""
        flat, lengths = array("i"), array("i")
        new: list[bytes] = []
        met: list[str] = []
        for chunk, told in zip(chunks, map(self.at.get, chunks), strict=True):
            if told is None and (told := self.at.get(chunk)) is None:
                pieces = self.cut.findall(chunk)
                if pieces == [chunk]:
                    told = self._number(chunk, new, met)
                else:
                    told = self.at[chunk] = tuple([self._number(x, new, met) for x in pieces])
                    met.append(chunk)
            if isinstance(told, int):
                flat.append(told)
                lengths.append(1)
            else:
                flat.extend(told)
                lengths.append(len(told))
        needs = sum(map(len, met)) + PIECE_BYTES * len(met)
        kept = needs <= self.room
        if kept:
            self.room -= needs
            self.next += len(new)
        else:
            for x in met:
                del self.at[x]
        return flat, lengths, new, kept

    def _number(self, piece: str, new: list[bytes], met: list[str]) -> int:
        told = self.at.get(piece)
        if told is None:
            raw = piece.encode()
            told = self.ranks.get(raw)
            if told is None:
                told = self.next + len(new)
                new.append(raw)
            self.at[piece] = told
            met.append(piece)
        return told

    def start(self, new: list[bytes]) -> pa.ListArray:
        """What the fold starts from: single bytes, packed with the ids that they merge to; long pieces are merged over a heap before."""
        lengths = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        packed, a = [], 0
        for b in [*np.flatnonzero(lengths > FOLD_BYTES).tolist(), len(new)]:
            data = np.frombuffer(b"".join(new[a:b]), dtype=np.uint8)
            ends = np.cumsum(lengths[a:b])
            if (self.single[data] < 0).any():
                raise ValueError("a byte of a text is no token")
            rank = np.full(len(data), NONE, dtype=np.int64)
            rank[:-1] = self.pair[data[:-1].astype(np.int64) << 8 | data[1:]]
            rank[ends - 1] = NONE
            index = np.arange(len(data)) - np.repeat(ends - lengths[a:b], lengths[a:b])
            packed.append(rank << 2 * ID_BITS | index << ID_BITS | self.single[data])
            if b < len(new):
                packed.append(NONE << 2 * ID_BITS | np.array(heap_merges(new[b], self.ranks), dtype=np.int64))
                lengths[b] = len(packed[-1])
            a = b + 1
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(packed)))


def _cut_slices(ranks: dict[bytes, int], pattern: str, slice_bytes: int, kept_bytes: int = KEPT_BYTES):
    """A row for each slice: its documents, where their pieces end, all pieces by number, the new ones, and whether these are kept."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Pieces(ranks, pattern, kept_bytes)
        for batch in batches:
            for part in slices(batch, most=slice_bytes):
                chunks, first = cut_texts(part.column("text"))
                told = chunks.dictionary_encode()
                flat, lengths, new, kept = known.numbers(told.dictionary.to_pylist())
                of_chunk = np.array(lengths, dtype=np.int64)
                pieces, ends = gathered(np.array(flat, dtype=np.int32), np.cumsum(of_chunk) - of_chunk, of_chunk, told.indices.to_numpy())
                stops = np.concatenate([[0], ends])[first]
                row = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.record_batch({
                    "docs": row(pa.array(part.column("doc_id"))),
                    "stops": row(pa.array(stops.astype(np.int64))),
                    "pieces": pa.array([pieces.tobytes()], pa.binary()),
                    "new": row(known.start(new)),
                    "kept": pa.array([kept]),
                })

    return work


def _folded_slices(docs: DataFrame, ranks: dict[bytes, int], pattern: str, slice_bytes: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = rows.mapInArrow(_cut_slices(ranks, pattern, slice_bytes), "docs array<long>, stops array<long>, pieces binary, new array<array<long>>, kept boolean")
    folded = _let(Vocabulary(ranks).rank_map(), lambda pairs: F.transform("new", lambda start: fold_packed(start, pairs)))
    return cut.select("docs", "stops", "pieces", folded.alias("new"), "kept")


def _put_together(ranks: dict[bytes, int], decoded: bool):
    """A row for each document of a slice: doc_id, ids and, if asked for, the bytes decoded from them.

    Slices come in the order in which their task cut them.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks) if decoded else []
        runs = np.arange(_count(ranks), dtype="<u4")  # ids of the pieces by number, side by side
        lengths = np.ones(len(runs), dtype=np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                docs, stops, new = (batch.column(c).slice(i, 1).flatten() for c in ("docs", "stops", "new"))
                pieces = np.frombuffer(batch.column("pieces")[i].as_buffer(), dtype=np.int32)
                all_runs = np.concatenate([runs, (new.flatten().to_numpy() & (NONE - 1)).astype("<u4")])
                all_lengths = np.concatenate([lengths, new.value_lengths().to_numpy().astype(np.int64)])
                if batch.column("kept")[i].as_py():
                    runs, lengths = all_runs, all_lengths
                flat, ends = gathered(all_runs, np.cumsum(all_lengths) - all_lengths, all_lengths, pieces)
                at = np.concatenate([[0], ends])[stops.to_numpy()]
                ids = [flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                out = {"doc_id": docs, "ids": pa.array(ids, pa.binary())}
                if decoded:
                    out["decoded"] = pa.array([_joined(tokens, x) for x in ids], pa.binary())
                yield pa.record_batch(out)

    return work


def _count(ranks: dict[bytes, int]) -> int:
    return max(ranks.values(), default=-1) + 1


def _tokens(ranks: dict[bytes, int]) -> list[bytes]:
    tokens = [b""] * _count(ranks)
    for t, i in ranks.items():
        tokens[i] = t
    return tokens


def _joined(tokens: list[bytes], ids: bytes) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``docs(doc_id, text)`` as token ids: rows (doc_id, ids).

    ``ids`` is binary, little-endian unsigned 32-bit integers.  One row per row of
    ``docs``; a null or empty text has no ids.  Repeated rows are encoded one by one; other
    columns are ignored.  Texts are cut by slices of about ``slice_bytes`` bytes; a longer text
    is a slice of its own.
    """
    return _folded_slices(docs, ranks, pattern, slice_bytes).mapInArrow(_put_together(ranks, False), "doc_id long, ids binary")


def decode(coded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``coded(doc_id, ids)`` with the column ``decoded``: the tokens' bytes, put together."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(ranks)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                out = [_joined(tokens, x) for x in part.column("ids").to_pylist()]
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": part.column("ids"), "decoded": pa.array(out, pa.binary())})

    return coded.select("doc_id", "ids").mapInArrow(work, "doc_id long, ids binary, decoded binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the bytes decoded from them.

    Ids are decoded where they are put together, so that a task has two Python workers, not three.
    """
    ranks = read_ranks(path)
    both = _folded_slices(docs, ranks, pattern, SLICE_BYTES).mapInArrow(_put_together(ranks, True), "doc_id long, ids binary, decoded binary")
    return both.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
