"""Byte-level BPE: encoding by merge ranks, decoding by vocabulary strings.

A piece of text starts as a doubly linked list of byte symbols. All neighbouring pairs that have a
merge rank wait in a priority queue; the best is merged, its new neighbours are queued, and entries
whose pair is gone by the time they surface are skipped. Work per piece is n log n in its bytes.
Pieces repeat, so their ids are kept in a bounded table per worker.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgov.llm.common import own_text

# The piece pattern of byte-level BPE vocabularies, white space as Unicode defines it.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
          rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
# A piece never runs from other text into white space, so texts may be cut there first.
CHUNKS = rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+"
KEPT_CHUNKS = 1 << 20
_SPOT = (1 << 32) - 1

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> dict[int, str]:
    """The printable sign that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in signs:
            signs[b] = chr(256 + len(signs) - len(plain))
    return signs


class _Kept(dict):
    """Chunk to ids and the ids as text; emptied when full, so memory is bounded."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str):
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        found = self[chunk] = self.encode(chunk)
        return found


class BytePairCodec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *added.values()]) + 1
        signs = byte_symbols()
        self.first = [vocab[signs[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault(vocab[left] * self.size + vocab[right], len(self.merged))
            self.merged.append(vocab[left + right])
        byte_of = {sign: b for b, sign in signs.items()}
        self.strings = [b""] * self.size
        for token, i in (vocab | added).items():
            self.strings[i] = bytes(byte_of[c] for c in token)
        self.texts = [str(i) for i in range(self.size)]
        self.added = added
        self.pieces = regex.compile(PIECES)
        self.chunks = regex.compile(CHUNKS)
        self.marks = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.piece_ids = functools.lru_cache(KEPT_CHUNKS // 2)(self.merge)
        self.kept = _Kept(self._chunk)

    def merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        first, rank, merged, size = self.first, self.rank, self.merged, self.size
        symbol = [first[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            r = rank.get(symbol[i] * size + symbol[i + 1])
            if r is not None:
                queue.append(r << 32 | i)
        heapq.heapify(queue)
        while queue:
            entry = heapq.heappop(queue)
            i, r = entry & _SPOT, entry >> 32
            right = after[i]
            if right >= n or symbol[i] < 0 or rank.get(symbol[i] * size + symbol[right]) != r:
                continue  # stale: one of the two was merged meanwhile
            symbol[i], symbol[right] = merged[r], -1
            far = after[i] = after[right]
            if far < n:
                before[far] = i
                r = rank.get(symbol[i] * size + symbol[far])
                if r is not None:
                    heapq.heappush(queue, r << 32 | i)
            left = before[i]
            if left >= 0:
                r = rank.get(symbol[left] * size + symbol[i])
                if r is not None:
                    heapq.heappush(queue, r << 32 | left)
        return tuple(s for s in symbol if s >= 0)

    def _chunk(self, chunk: str) -> tuple[tuple[int, ...], str]:
        ids: list[int] = []
        for is_mark, part in self._parts(chunk):
            if is_mark:
                ids.append(self.added[part])
            else:
                for piece in self.pieces.findall(part):
                    ids.extend(self.piece_ids(piece))
        return tuple(ids), ",".join([self.texts[i] for i in ids])

    def _parts(self, chunk: str) -> Iterator[tuple[bool, str]]:
        """The chunk in turns of ordinary text and strings of added tokens."""
        if self.marks is None or not self.marks.search(chunk):
            yield False, chunk
            return
        at = 0
        for found in self.marks.finditer(chunk):
            if found.start() > at:
                yield False, chunk[at:found.start()]
            yield True, found.group()
            at = found.end()
        if at < len(chunk):
            yield False, chunk[at:]

    def encode_with_text(self, text: str) -> tuple[list[int], str]:
        """The ids, and the same ids in decimal joined by commas."""
        found = list(map(self.kept.__getitem__, self.chunks.findall(text)))
        return list(chain.from_iterable(f[0] for f in found)), ",".join([f[1] for f in found])

    def encode(self, text: str) -> list[int]:
        return self.encode_with_text(text)[0]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings put together; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(path: str) -> BytePairCodec:
    """One codec per worker process."""
    return BytePairCodec(path)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode each whole text, decode the ids, and return digests of both.

    Null texts count as empty and give no ids; rows are kept as they are, with repeated and null
    ids; other columns are not read. The text column may hold any length.
    """
    def run(batches):
        own = codec(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for text in batch.column("text").to_pylist():
                ids, listed = own.encode_with_text(text)
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(listed.encode()).hexdigest())
                text_digest.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()),
                 pa.array(text_digest, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), own_text(docs).alias("text")).mapInArrow(run, DIGESTS)
