"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A rank file gives every token's bytes and rank; the rank is the token's id, and the
pair of neighbours whose joined bytes have the lowest rank merges first, leftmost on
ties. Texts are cut by a pattern first and nothing merges across its matches; a match
that is a token itself is that token.

The queue holds one bucket of positions for each rank; a position names the left part
of a pair in a doubly linked list of parts. A bitmap says which buckets hold anything,
and two coarser bitmaps which words of the finer one do, so the next rank is three
find-first-set steps away however many ranks exist. A merge makes pairs stale; they
stay where they are and are skipped when met. One queue works on all new pre-tokens of
a batch at once, laid end to end with breaks between them: each keeps its own order of
merges, and a very long pre-token costs its length times the logarithm of its bucket.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from cosecha.llm.text_kernels import giving_back

#: Pre-tokens whose encoding a worker remembers, longest bytes of one that it does, and bytes encoded at a time.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64
ENCODE_BYTES = 1 << 20


class RankQueue:
    """Buckets of positions by rank, under three levels of bitmaps of 64-bit words."""

    def __init__(self, ranks: int) -> None:
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.fine = [0] * (ranks // 64 + 1)
        self.middle = [0] * (len(self.fine) // 64 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if not bucket:
            word = rank >> 6
            self.fine[word] |= 1 << (rank & 63)
            self.middle[word >> 6] |= 1 << (word & 63)
            self.top |= 1 << (word >> 6)
        bucket.append(position)

    def fill(self, rank: int, positions: list[int]) -> None:
        """Push many positions of one rank, none of which is queued."""
        self.push(rank, positions[0])
        self.buckets[rank].extend(positions[1:])

    def lowest(self) -> int:
        """The lowest rank with a position, or -1."""
        if not self.top:
            return -1
        high = (self.top & -self.top).bit_length() - 1
        group = self.middle[high]
        word = (high << 6) + (group & -group).bit_length() - 1
        bits = self.fine[word]
        return (word << 6) + (bits & -bits).bit_length() - 1

    def clear(self, rank: int) -> list[int]:
        """Take the bucket of ``rank`` out."""
        bucket, self.buckets[rank] = self.buckets[rank], []
        word = rank >> 6
        self.fine[word] &= ~(1 << (rank & 63))
        if not self.fine[word]:
            self.middle[word >> 6] &= ~(1 << (word & 63))
            if not self.middle[word >> 6]:
                self.top &= ~(1 << (word >> 6))
        return bucket


class BytePairEncoder:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.queue = RankQueue(len(self.tokens))
        #: Merged rank of a pair of ids, found when first asked for; -1 if there is none.
        self.pairs: dict[int, int] = {}
        self.byte_ids = np.array([ranks[bytes([k])] for k in range(256)])
        self.byte_pairs = np.array([ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]).reshape(256, 256)
        self.remembered: dict[str, bytes] = {}

    def _pair(self, left: int, right: int) -> int:
        key = left << 32 | right
        rank = self.pairs.get(key)
        if rank is None:
            rank = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
            if len(self.pairs) < 2_000_000:
                self.pairs[key] = rank
        return rank

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each of ``pieces`` (not empty)."""
        sizes = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        count = len(data)
        ids = self.byte_ids[data].tolist()
        starts = np.cumsum(sizes) - sizes
        ahead, back = np.arange(1, count + 1), np.arange(-1, count - 1)
        ahead[starts + sizes - 1] = -1
        back[starts] = -1
        queue, pair = self.queue, self._pair
        first = np.full(count, -1)
        if count > 1:
            first[:-1] = self.byte_pairs[data[:-1], data[1:]]
        first[starts + sizes - 1] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        found, cut = np.unique(first[at], return_index=True)
        for rank, begin, end in zip(found.tolist(), cut.tolist(), [*cut[1:].tolist(), len(at)], strict=False):
            queue.fill(rank, at[begin:end].tolist())
        ahead, back = ahead.tolist(), back.tolist()
        while (rank := queue.lowest()) >= 0:
            bucket = queue.clear(rank)
            bucket.sort()
            for k, i in enumerate(bucket):
                j = ahead[i]
                if j < 0 or ids[i] < 0 or pair(ids[i], ids[j]) != rank:
                    continue  # stale
                ids[i] = rank
                ids[j] = -1
                after = ahead[j]
                ahead[i] = after
                lower = False
                if after >= 0:
                    back[after] = i
                    new = pair(rank, ids[after])
                    if new >= 0:
                        queue.push(new, i)
                        lower = new < rank
                before = back[i]
                if before >= 0:
                    new = pair(ids[before], rank)
                    if new >= 0:
                        queue.push(new, before)
                        lower = lower or new < rank
                if lower and k + 1 < len(bucket):
                    queue.fill(rank, bucket[k + 1 :])
                    break
        out = []
        for begin, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            out.append([x for x in ids[begin : begin + size] if x >= 0])
        return out

    def _learn(self, words: Iterable[str], into: dict[str, bytes]) -> None:
        """Add the encodings of ``words`` as little-endian 32-bit ids."""
        waiting: list[str] = []
        pieces: list[bytes] = []
        held = 0
        for word in words:
            piece = word.encode()
            rank = self.ranks.get(piece)
            if rank is not None:
                into[word] = rank.to_bytes(4, "little")
                continue
            waiting.append(word)
            pieces.append(piece)
            held += len(piece)
            if held > ENCODE_BYTES:
                into.update(zip(waiting, (np.array(x, "<u4").tobytes() for x in self.merge(pieces)), strict=True))
                waiting, pieces, held = [], [], 0
        if pieces:
            into.update(zip(waiting, (np.array(x, "<u4").tobytes() for x in self.merge(pieces)), strict=True))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        begin = 0
        while begin < len(texts):
            end, held = begin, 0
            while end < len(texts) and (end == begin or held + len(texts[end]) <= ENCODE_BYTES):
                held += len(texts[end])
                end += 1
            words = [self.split(t) for t in texts[begin:end]]
            known = self.remembered
            new = set().union(*words)
            new.difference_update(known.keys())
            if new:
                fresh: dict[str, bytes] = {}
                self._learn(new, fresh)
                if len(known) + len(new) > REMEMBERED:
                    old = known
                    known = self.remembered = {}
                    used = set().union(*words).difference(new)
                    fresh.update((w, old[w]) for w in used)
                known.update((w, v) for w, v in fresh.items() if len(w) <= REMEMBERED_BYTES)
                lookup = {w: v for w, v in fresh.items() if len(w) > REMEMBERED_BYTES}
            else:
                lookup = {}
            for row in words:
                if lookup:
                    yield b"".join([known[w] if w in known else lookup[w] for w in row])
                else:
                    yield b"".join(map(known.__getitem__, row))
            begin = end

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids given as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """A rank file: base64 of the token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=2)
def _encoder(name: str, pattern: str) -> BytePairEncoder:
    with open(SparkFiles.get(name), "rb") as lines:
        return BytePairEncoder(read_ranks(lines), pattern)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ids (binary, little-endian unsigned 32-bit) and decoded (binary); columns of these names are replaced.

    ``rank_file`` is sent to the executors once a session (a vocabulary, not corpus data).
    Special tokens are not known: their strings are ordinary text. A null text counts as
    empty and gives no ids; repeated rows give the same ids. Texts of any length are
    encoded whole.
    """
    docs = docs.drop("ids", "decoded")
    docs.sparkSession.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]
    schema = StructType(docs.schema.fields[:]).add("ids", "binary").add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        try:
            for batch in batches:
                # Small slices keep what a worker holds independent of the batch size.
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    ids = list(encoder.encode_all([t or "" for t in part.column(text).to_pylist()]))
                    decoded = [encoder.decode(x) for x in ids]
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=[*part.schema.names, "ids", "decoded"])
        finally:
            # Workers outlive their tasks: tables and remembered pre-tokens would stand beside the next stage's rows.
            _encoder.cache_clear()

    return docs.mapInArrow(giving_back(run), schema)


def digest(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """The contract's columns, hashed where the ids are made so that neither ids nor bytes travel."""
    docs = docs.select("doc_id", "text")
    docs.sparkSession.sparkContext.addFile(rank_file)
    name = rank_file.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, pattern)
        for batch in batches:
            counts, digests, decoded = [], [], []
            for ids in encoder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                counts.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.mapInArrow(giving_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
