"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Every worker packs its own documents and shares nothing with others. A document is cut into pieces whose lengths
are reciprocal shares of the capacity C: whole sequences (C/1), then the halvings C/2, C/4, ... that its rest
holds, down to `least`, and what then remains is a tail shorter than `least`. Class k takes the lengths in
(C/(k+1), C/k] and fills each of its bins with exactly k pieces. Halvings fill a bin without a gap; only tails
leave some padding, below one tail a bin. Pieces still waiting at the end of a partition are cut into powers of
two and set into sequences of a power-of-two length, which need no padding.

Defined results: a null text counts as empty and yields the end-of-text token alone; a null doc_id is carried
through; repeated rows are packed as often as they occur; an empty table gives an empty result; texts are encoded
whole, however long, and cut into pieces; further columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import documents, slices, text_or_empty

END = 1
#: The splitting pattern of byte-level BPE tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_names() -> dict[str, int]:
    """Byte-level vocabularies name a printable byte by itself and the n-th other byte by character 256 + n."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


BYTE_OF = _byte_names()
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codes(dict):
    """Counts up a code for each new key and notes the key."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        code = self[key] = len(self)
        self.new.append(key)
        return code


class WordwiseEncoder:
    """Ids of whole texts for a byte-level BPE, encoding each distinct word once.

    Its splitting pattern always starts a new piece at a single blank before a character that isn't white space,
    so a text may be cut there without changing an id. Texts with an added token are encoded whole.
    """

    #: The characters that engines class differently as white space are no place to cut.
    CUT = re.compile(r" (?=[^\s\x1c-\x1f\x85᠎​﻿])")
    NO_CUT = re.compile(r" (?:[\s\x1c-\x1f\x85᠎​﻿]|\Z)")

    def __init__(self, path: str, most_words: int = 300_000):
        with open(path) as f:
            told = json.load(f)
        self.path, self.most_words, self._whole = path, most_words, None
        self.added = [x["content"] for x in told["added_tokens"]]
        vocab = {bytes(BYTE_OF[c] for c in piece): k for piece, k in told["model"]["vocab"].items()}
        merged = [bytes(BYTE_OF[c] for c in (x if isinstance(x, str) else "".join(x)) if c != " ") for x in told["model"]["merges"]]
        if [vocab[x] for x in merged] != list(range(256, 256 + len(merged))) or told["normalizer"]:
            raise ValueError("the ids of merged pieces have to be in merging order")
        self.lengths = np.zeros(len(vocab), np.int64)
        for piece, k in vocab.items():
            self.lengths[k] = len(piece)
        #: The same merges in an engine that is several times as fast on new words.
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        self._forget()

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def _forget(self) -> None:
        """Words are known without the blank before them; those that start a text are kept apart."""
        self.known, self.leading = Codes(), Codes()
        self.words, self.firsts = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), (np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _learn(self) -> None:
        if new := self.known.new:
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(new)), np.uint32)
            ends = np.cumsum([len(w.encode()) + 1 for w in new])
            sizes = np.diff(np.searchsorted(np.cumsum(self.lengths[ids]), ends, "left") + 1, prepend=0)
            self.words = np.concatenate([self.words[0], ids]), np.concatenate([self.words[1], sizes])
            self.known.new = []
        if new := self.leading.new:
            got = [self.fast.encode_ordinary(x) for x in new]
            self.firsts = np.concatenate([self.firsts[0], np.array([i for x in got for i in x], np.uint32)]), np.concatenate([self.firsts[1], np.array([len(x) for x in got], np.int64)])
            self.leading.new = []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) + len(self.leading) > self.most_words:
            self._forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, counts, codes = [], [0], []
        known, leading = self.known.__getitem__, self.leading.__getitem__
        for k, text in enumerate(texts):
            if any(x in text for x in self.added):
                out[k] = np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
            else:
                words = self.CUT.split(text) if self.NO_CUT.search(text) else text.split(" ")
                first = leading(words.pop(0))
                codes.append(np.array([-1 - first, *map(known, words)], np.int64))
                plain.append(k)
                counts.append(len(words) + 1)
        self._learn()
        cuts = np.cumsum(counts)
        at = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        flat, sizes = np.concatenate([self.words[0], self.firsts[0]]), np.concatenate([self.words[1], self.firsts[1]])
        at = np.where(at < 0, len(self.words[1]) - 1 - at, at)
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[cuts].tolist()
        for k, a, b in zip(plain, bounds[:-1], bounds[1:], strict=True):
            out[k] = ids[a:b]
        return out


class HarmonicPacker:
    """Bins of one worker. Sequence ids start at first_sequence."""

    def __init__(self, capacity: int, least: int, first_sequence: int):
        if capacity & (capacity - 1) or least & (least - 1):
            raise ValueError("capacity and least must be powers of two")
        self.capacity, self.least, self.next = capacity, least, first_sequence
        self.waiting: dict[int, list[tuple]] = defaultdict(list)

    def cut(self, n: int) -> Iterator[tuple[int, int]]:
        """(start, length) of the pieces of n ids."""
        start, share = 0, self.capacity
        while share >= self.least:
            while n - start >= share:
                yield start, share
                start += share
            share //= 2
        if start < n:
            yield start, n - start

    def put(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        """Rows of the bins that this document fills."""
        for start, length in self.cut(len(ids)):
            k = self.capacity // length
            self.waiting[k].append((doc_id, start, ids[start : start + length], len(ids)))
            if len(self.waiting[k]) == k:
                yield from self._bin(self.waiting.pop(k))

    def _bin(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, n in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next, offset
            offset += len(ids)
        self.next += 1

    def close(self) -> Iterator[tuple]:
        """Rows of all pieces that still wait, in sequences of power-of-two lengths."""
        rest = [x for k in sorted(self.waiting) for x in self.waiting[k]]
        self.waiting.clear()
        left = sum(len(x[2]) for x in rest)
        room, held = 0, []
        for doc_id, start, ids, n in rest:
            at = 0
            while at < len(ids):
                if not room:
                    room = min(self.capacity, 1 << (left.bit_length() - 1))
                take = min(room, len(ids) - at)
                held.append((doc_id, start + at, ids[at : at + take], n))
                at, room, left = at + take, room - take, left - take
                if not room:
                    yield from self._bin(held)
                    held = []


def pack(docs: DataFrame, capacity: int = 2048, least: int = 32, tokenizer: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordwiseEncoder(path)
        packer = HarmonicPacker(capacity, least, TaskContext.get().partitionId() << 40)

        def rows_out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 7)], names)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for part in slices(batches, "text", 4 << 20):
            rows: list[tuple] = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()), strict=True):
                rows += packer.put(doc_id, np.append(ids, np.uint32(END)))
            yield rows_out(rows)
        yield rows_out(list(packer.close()))

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, SCHEMA)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
