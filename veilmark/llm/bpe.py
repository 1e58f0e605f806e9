"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the others by merges from a heap.

A text is split by the vocabulary's pattern.  The pre-tokens of a slice are
hashed together; a minimal perfect hash (hash and displace: a displacement for
each bucket of keys, so that every key has a slot of its own and no slot is
empty) gives the one entry that each can be, and a comparison of bytes says
whether it is.  The others are merged: bytes are a linked list, a heap holds the
pairs that the vocabulary has by rank and place, and the lowest is joined until
none is left, in O(n log n) of a pre-token's bytes.

The vocabulary is a file of at most ``MAX_ENTRIES`` lines of base64 and rank.  The
driver reads it and its tables are broadcast (about 60 bytes an entry).

Null text encodes as empty: no ids.  Repeated rows each get a row; only the
named columns are read.  Decoding gives back every text byte for byte.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from heapq import heapify, heappop, heappush
from itertools import chain, compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow, column_ddl, pa_schema, text_batches
from .shingles import mix

MAX_ENTRIES = 1 << 20
#: Keys of a bucket of the hash, on average.
BUCKET = 4
#: Displacements that are tried together.
TRIES = 256
#: Merged pre-tokens that a worker remembers, before they become the older ones, of which it keeps as many.
REMEMBERED = 1 << 18
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def key_hashes(buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each key buffer[start:start + length].

    Bytes are taken eight at a time as one number, so a key of 8 bytes or fewer costs one step.
    """
    padded = np.concatenate((buffer, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = mix(lengths.astype(np.uint64) * _SEEDS[0])
    todo = np.flatnonzero(lengths > 0)
    done = 0
    while len(todo):
        word = np.ascontiguousarray(eights[starts[todo] + done]).view("<u8")[:, 0]
        left = np.minimum(lengths[todo] - done, 8).astype(np.uint64)
        word &= np.uint64((1 << 64) - 1) >> (np.uint64(64) - left * np.uint64(8))
        out[todo] = mix((out[todo] ^ word) * _SEEDS[1])
        done += 8
        todo = todo[lengths[todo] > done]
    return out


class PerfectHash:
    """A slot in 0..n-1 for each of n distinct 64-bit keys; other keys get some slot too."""

    def __init__(self, keys: np.ndarray):
        self.n = n = len(keys)
        self.buckets = max(1, n // BUCKET)
        self.shift = np.zeros(self.buckets, np.int64)
        if len(np.unique(keys)) < n:
            raise ValueError("keys are not distinct")
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(sizes)
        free = np.ones(n, bool)
        by_size = np.argsort(-sizes, kind="stable")
        for b in by_size[sizes[by_size] > 1].tolist():
            own = keys[order[ends[b] - sizes[b] : ends[b]]]
            at = 1
            while True:
                slots = self._slots(own[None, :], np.arange(at, at + TRIES)[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    good &= (np.diff(np.sort(slots, axis=1), axis=1) > 0).all(axis=1)
                if good.any():
                    first = int(np.argmax(good))
                    self.shift[b] = at + first
                    free[slots[first]] = False
                    break
                at += TRIES
        # A key alone in its bucket takes any slot that is left: the bucket names it.
        lone = np.flatnonzero(sizes == 1)
        self.shift[lone] = -1 - np.flatnonzero(free)

    def _slots(self, keys: np.ndarray, shift: np.ndarray) -> np.ndarray:
        return (mix(keys + shift.astype(np.uint64) * _SEEDS[0]) % np.uint64(self.n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        shift = self.shift[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(shift < 0, -1 - shift, self._slots(keys, np.maximum(shift, 0)))


class Vocabulary:
    """Ranks of byte strings, their perfect hash, and the pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if len(ranks) > MAX_ENTRIES or not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError(f"a vocabulary has all single bytes and at most {MAX_ENTRIES} entries")
        self.ranks, self.pattern = ranks, pattern
        tokens = list(ranks)
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(lengths) - lengths
        buffer = np.frombuffer(b"".join(tokens), np.uint8)
        keys = key_hashes(buffer, starts, lengths)
        self.hash = PerfectHash(keys)
        slot = self.hash(keys)
        self.starts, self.lengths, self.ids = (np.empty(len(tokens), np.int64) for _ in range(3))
        self.starts[slot], self.lengths[slot], self.ids[slot] = starts, lengths, np.fromiter(ranks.values(), np.int64, len(tokens))
        self.buffer = buffer
        self.singles = [ranks[bytes([b])] for b in range(256)]
        #: The rank of each pair of bytes, shifted as in the keys of a heap, or -1.
        self.pairs = [ranks.get(bytes(divmod(i, 256)), -1) << 32 for i in range(1 << 16)]
        self.slot_of = np.full(max(ranks.values()) + 1, -1, np.int64)
        self.slot_of[self.ids] = np.arange(len(tokens))
        #: What a worker has merged, from task to task.
        self.memory: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """From a file on the driver: a line for each entry, base64 of its bytes and its rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def whole(self, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The id of each pre-token that is an entry, else -1."""
        slot = self.hash(key_hashes(buffer, starts, lengths))
        same = np.flatnonzero(self.lengths[slot] == lengths)
        size, ours = lengths[same], self.starts[slot[same]]
        ends = np.cumsum(size)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        equal = buffer[np.repeat(starts[same], size) + step] == self.buffer[np.repeat(ours, size) + step]
        good = np.logical_and.reduceat(equal, ends - size) if len(ends) else np.empty(0, bool)
        out = np.full(len(starts), -1, np.int64)
        out[same[good]] = self.ids[slot[same[good]]]
        return out

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is no entry: the pair of lowest rank is joined first, of equal ones the first."""
        n, rank, pairs = len(piece), self.ranks.get, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # A key holds rank and place, and each place has one key that counts: that of the pair which begins there now.
        own = [pairs[a << 8 | b] + i for i, (a, b) in enumerate(pairwise(piece))]
        own.append(-1)
        ids = [self.singles[b] for b in piece]
        heap = [key for key in own if key >= 0]
        heapify(heap)
        while heap:
            key = heappop(heap)
            i = key & 0xFFFFFFFF
            if own[i] != key:
                continue
            middle = after[i]
            ids[i] = key >> 32
            after[i] = end = after[middle]
            own[middle] = own[i] = -1
            if end < n:
                before[end] = i
                if (r := rank(piece[i : after[end]])) is not None:
                    own[i] = key = r << 32 | i
                    heappush(heap, key)
            if i:
                i = before[i]
                own[i] = -1
                if (r := rank(piece[i:end])) is not None:
                    own[i] = key = r << 32 | i
                    heappush(heap, key)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def encode_slice(self, texts: list[str], memory: dict[str, bytes], older: dict[str, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where those of each text end.

        ``memory`` keeps the ids of merged pre-tokens from slice to slice, four bytes each.  Once full it starts again;
        what it held is left in ``older``, if given, which words that come often are taken back from.
        """
        find = regex.compile(self.pattern).findall
        parts = [find(t) for t in texts]
        flat = list(chain.from_iterable(parts))
        bounds = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)))
        if sum(map(len, texts)) != (bounds[-1] if flat else 0):
            raise ValueError("the pattern passes over some characters")
        per_text = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        if not flat:
            return np.empty(0, np.int32), per_text
        buffer = np.frombuffer("".join(flat).encode(), np.uint8)
        if len(buffer) != bounds[-1]:  # offsets of characters become offsets of bytes
            bounds = np.append(np.flatnonzero((buffer & 0xC0) != 0x80), len(buffer))[bounds]
        starts = np.concatenate(([0], bounds[:-1]))
        ids = self.whole(buffer, starts, bounds - starts)
        rest = np.flatnonzero(ids < 0)
        pieces = list(compress(flat, (ids < 0).tolist()))
        joined = list(map(memory.get, pieces))
        past = {} if older is None else older
        for k in [k for k, known in enumerate(joined) if known is None]:
            piece = pieces[k]
            known = memory.get(piece)  # an earlier one of this slice
            if known is None:
                if len(memory) >= REMEMBERED:
                    past.clear()
                    past.update(memory)
                    memory.clear()
                memory[piece] = known = past.get(piece) or array("i", self.merged(piece.encode())).tobytes()
            joined[k] = known
        counts = np.ones(len(flat), np.int64)
        counts[rest] = np.fromiter(map(len, joined), np.int64, len(joined)) // 4
        ends = np.cumsum(counts)
        out = np.empty(ends[-1], np.int32)
        single = np.ones(len(flat), bool)
        single[rest] = False
        single = np.repeat(single, counts)
        out[single] = ids[ids >= 0]
        out[~single] = np.frombuffer(b"".join(joined), np.int32)
        return out, np.concatenate(([0], ends))[per_text]

    def encode(self, texts: list[str], memory: dict[str, bytes] | None = None) -> Iterable[list[int]]:
        """The ids of each text."""
        ids, ends = self.encode_slice(texts, {} if memory is None else memory)
        starts = np.concatenate(([0], ends[:-1]))
        return (ids[a:b].tolist() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))

    def decode_slice(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes behind the ids of each text."""
        slot = self.slot_of[ids]
        size = self.lengths[slot]
        last = np.cumsum(size)
        data = self.buffer[np.repeat(self.starts[slot] - (last - size), size) + np.arange(last[-1] if len(last) else 0)].tobytes()
        bounds = np.concatenate(([0], last))[np.concatenate(([0], ends))].tolist()
        return [data[a:b] for a, b in pairwise(bounds)]

    def decode(self, ids: Iterable[int]) -> bytes:
        ids = np.fromiter(ids, np.int64)
        return self.decode_slice(ids, np.array([len(ids)]))[0]


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id and ``ids``."""
    ddl = f"{column_ddl(docs, id_col)}, ids array<int>"
    schema = pa_schema(ddl)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for keys, texts in text_batches(batches):
            ids, ends = shared.value.encode_slice(texts, *shared.value.memory)
            yield arrow([keys, pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids))], schema)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ddl)


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes behind its ids; null ids give no bytes."""
    ddl = f"{column_ddl(encoded, id_col)}, {column_ddl(encoded, ids_col, 'ids')}, decoded binary"
    schema = pa_schema(ddl)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            step = max(1, len(batch) * (1 << 19) // max(1, batch.nbytes))
            for at in range(0, len(batch), step):
                keys, ids = (c.slice(at, step) for c in batch.columns)
                sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
                yield arrow([keys, ids, shared.value.decode_slice(ids.flatten().to_numpy(), np.cumsum(sizes))], schema)

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, ddl)
