"""Packing token sequences by minimum bin slack.

Documents are cut into whole windows and one remainder each. Remainders are packed a block at a
time: a bitset subset-sum over the multiset of lengths still in the block picks those that fill the
window closest to its capacity (the longest one left is always in it, so that every round ends), and
the counts are found by walking back through the bitsets. What a partition cannot fill at its end
is laid end to end and cut into pieces of a power of two, which need no padding.

A block has a bounded number of documents, so memory does not depend on the partition. Each input
partition is packed on its own: no shuffle, no hot group, and a lost task is simply run again.

Defined cases: a null text is empty and has only the closing id; repeated rows are packed each for
itself; an empty table gives an empty result; a text of any length is cut, never shortened.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import frame_of, text_batches, whole_number

CAPACITY, BLOCK, REMEMBERED = 2048, 4096, 600_000
_CLOSE_BLANKS = re.compile(r" (?:\s|$)")


class TextEncoder:
    """Ids of whole texts, remembering those of single words.

    The vocabulary's own rule never joins a blank with what stands before it, so a text can be cut
    before each single blank that a word follows, and the pieces encoded alone. The new words of a
    text are encoded together: where a token begins with a blank, a word begins. Where white space
    follows a blank the whole text goes to the tokenizer at once. The memory takes the first
    remembered words it meets (about 130 bytes each), and then no more; it never changes an id.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.opens = np.array([(t or "").startswith("\u0120") for t in map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))])
        self.known: dict[str, bytes] = {}
        self.remembered = remembered

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, dtype="<u4")
        if _CLOSE_BLANKS.search(text):
            return self._encode(text)
        first, *words = text.split(" ")
        known = self.known
        parts = [known.get(w) for w in words]
        if None in parts:
            fresh = list(dict.fromkeys(w for w, part in zip(words, parts) if part is None))
            ids = self._encode(" " + " ".join(fresh))
            starts = np.flatnonzero(self.opens[ids]).tolist()
            data = ids.tobytes()
            new = {w: data[4 * i : 4 * j] for w, i, j in zip(fresh, starts, [*starts[1:], len(ids)], strict=True)}
            parts = [new[w] if part is None else part for w, part in zip(words, parts)]
            if len(known) < self.remembered:
                known.update(new)
        head = self._encode(first).tobytes() if first else b""
        return np.frombuffer(head + b"".join(parts), dtype="<u4")


_encoders: dict[tuple[str, int], TextEncoder] = {}


def encoder_for(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    """One encoder a Python worker; a worker runs many tasks."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = TextEncoder(path, remembered)
    return _encoders[path, remembered]


class BlockPacker:
    """Packs the pieces of a partition. A piece: (row, start, ids). Yields (sequence, offset, piece)."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence, self.loose = capacity, first_sequence, []

    def whole(self, piece):
        yield self.sequence, 0, piece
        self.sequence += 1

    def add(self, piece):
        self.loose.append(piece)
        if len(self.loose) >= BLOCK:
            yield from self.pack(keep=BLOCK // 8)

    def pack(self, keep: int = 0):
        """Fill windows until few pieces are left; those wait for the next block."""
        by_length: dict[int, list] = {}
        for p in self.loose:
            by_length.setdefault(len(p[2]), []).append(p)
        left, counts = len(self.loose), {k: len(v) for k, v in by_length.items()}
        while left > keep and left:
            chosen = best_fill(counts, self.capacity)
            total = sum(k * n for k, n in chosen.items())
            if not keep and total < self.capacity and total & (total - 1):
                break
            offset = 0
            for length, n in chosen.items():
                for _ in range(n):
                    piece = by_length[length].pop()
                    yield self.sequence, offset, piece
                    offset, left = offset + length, left - 1
                counts[length] -= n
                if not counts[length]:
                    del counts[length], by_length[length]
            self.sequence += 1
        self.loose = [p for ps in by_length.values() for p in ps]

    def finish(self):
        yield from self.pack()
        total = sum(len(p[2]) for p in self.loose)
        room, offset = self._next(total), 0
        for row, start, ids in sorted(self.loose, key=lambda p: -len(p[2])):
            while len(ids):
                part = ids[: room - offset]
                yield self.sequence, offset, (row, start, part)
                ids, start, offset, total = ids[len(part) :], start + len(part), offset + len(part), total - len(part)
                if offset == room:
                    self.sequence, offset = self.sequence + 1, 0
                    room = self._next(total)
        self.loose = []

    def _next(self, total: int) -> int:
        """The length of the next closing sequence: full, or the largest power of two that is left."""
        return self.capacity if total >= self.capacity else 1 << max(0, total.bit_length() - 1)


def best_fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """{length: copies} with the longest length in it, whose sum is nearest to capacity from below.

    Bitset subset-sum: bit s of reach says that s can be made of the lengths so far. The bitsets
    before each step are kept for walking back.
    """
    order = sorted(counts, reverse=True)
    longest = order[0]
    room, reach, steps = capacity - longest, 1, []
    mask = (1 << room + 1) - 1
    for length in order:
        many, part = counts[length] - (length == longest), 1
        if length > room:
            continue
        many = min(many, room // length)
        while many > 0:
            use = min(part, many)
            steps.append((length, use, reach))
            reach |= reach << length * use & mask
            many, part = many - use, part * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {longest: 1}
    for length, use, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + use
            at -= length * use
    return chosen


PIECES = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1, key: str = "doc_id", text: str = "text", digest_only: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row a piece with its ids (or, with digest_only, their CRC-32 in ids_crc32).

    vocabulary is the path of a tokenizers file, there on every executor. remembered bounds the word
    memory of a Python worker.
    """
    schema = PIECES.replace("ids array<int>", "ids_crc32 long") if digest_only else PIECES

    def pack(batches):
        encoder, packer = encoder_for(vocabulary, remembered), BlockPacker(capacity, TaskContext.get().partitionId() << 40)
        def rows(placed):
            for sequence, offset, ((doc, tokens), start, ids) in placed:
                yield doc, start, len(ids), zlib.crc32(ids.tobytes()) if digest_only else ids.astype(np.int32), tokens, sequence, offset

        out: list[tuple] = []
        for pdf in batches:
            for doc, words in zip(pdf["key"], pdf["text"]):
                ids = np.append(encoder.ids(words or ""), np.uint32(end_id)).astype("<u4")
                row = (whole_number(doc), len(ids))
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity].copy()
                    out.extend(rows((packer.whole if len(part) == capacity else packer.add)((row, start, part))))
                if len(out) > 500:
                    yield frame_of(out, schema)
                    out = []
        out.extend(rows(packer.finish()))
        if out:
            yield frame_of(out, schema)

    text_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").cast("string").alias("key"), F.col(text).alias("text")).mapInPandas(pack, schema)  # ids as text: pandas would make floats of a column with nulls


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_pack(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary(), digest_only=True)
