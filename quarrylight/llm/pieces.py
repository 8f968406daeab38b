"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut before each run of word marks, where no piece can reach across, and the distinct words that are
new to the task are concatenated. A suffix array of that text is searched by bisection for the range of every piece of
the vocabulary; the occurrences are the edges of a lattice. Edges are sorted by where they end and relaxed in that order.

The vocabularies at hand merge pairs by score. The last piece of the encoding of a prefix then is unique: it is the longest
edge that ends there and may follow the last piece of the prefix it starts from. Two pieces may follow each other
if encoding their concatenation gives just these two, which undoing the merges on both sides of the cut decides. So
relaxing keeps one piece a position, and the path back from the end is the encoding. The words of a batch are relaxed
together, position by position; only very long ones are taken alone. Unigram vocabularies would keep the best sum
instead; the operator refuses them.

Pieces of marks alone tie and are merged last, from the left. So of a run of marks the last one goes to the lattice with the
word that it starts, and the others are joined afterwards, in time linear in their number. Characters that no piece has become
byte pieces.

Defined results: null text counts as empty and has no pieces; a null doc_id is carried through; repeated rows get equal
values; an empty table gives an empty result; further columns are ignored. A text round-trips unless it holds the word mark
itself, which decodes to a blank. Texts are encoded whole, however long, and so are words, in time linear in their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import documents, slices, text_or_empty
from quarrylight.llm.packing import Codes

MARK = "▁"
#: Kinds of pieces in a model file.
NORMAL, BYTE, BPE = 1, 6, 2
#: Above all ranks; what stands for the start of a word and for an unknown character among numbered pieces.
NEVER, START, UNKNOWN = 1 << 60, -2, -1


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceModel:
    """Vocabulary, merge order and the rule of which pieces may follow each other."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        told = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            told.ParseFromString(f.read())
        if told.trainer_spec.model_type != BPE or told.normalizer_spec.name != "identity" or told.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("a vocabulary that merges pairs, without normalisation, is needed")
        self.prefix = told.normalizer_spec.add_dummy_prefix
        self.pieces = [p.piece for p in told.pieces]
        self.id_of = {p.piece: k for k, p in enumerate(told.pieces) if p.type == NORMAL}
        self.byte_id = {int(p.piece[3:5], 16): k for k, p in enumerate(told.pieces) if p.type == BYTE}
        self.value_of = {k: b for b, k in self.byte_id.items()}
        if any(MARK in x[1:] for x in self.id_of if x.strip(MARK)):
            raise ValueError("a piece reaches across a word's start")
        self.runs = {len(x) for x in self.id_of if x and not x.strip(MARK)}
        order = sorted((x for x in self.id_of if len(x) > 1), key=lambda x: (-told.pieces[self.id_of[x]].score, self.id_of[x]))
        self.rank = {x: -1 for x in self.id_of if len(x) == 1} | {x: k for k, x in enumerate(order)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.usable = {x for x in self.id_of if len(x) == 1 or self._split(x)}
        self._number()

    def _number(self) -> None:
        """Arrays over numbered pieces: rank, halves, ids, and the rank of what two pieces give together."""
        self.names = list(self.rank)
        self.number = {x: k for k, x in enumerate(self.names)}
        self.ranks = np.array([self.rank[x] for x in self.names], np.int64)
        halves = [self.halves.get(x, ("", "")) for x in self.names]
        self.left, self.right = (np.array([self.number.get(x[k], -1) for x in halves], np.int64) for k in (0, 1))
        self.ids = np.array([self.id_of[x] for x in self.names], np.uint32)
        self.n_chars = np.array([len(x) for x in self.names], np.int64)
        get, n = self.number.get, len(self.names)
        pairs = [(a * n + b, k) for k, x in enumerate(self.names) for i in range(1, len(x)) if (a := get(x[:i])) is not None and (b := get(x[i:])) is not None]
        keys, made = (np.array([x[k] for x in pairs], np.int64) for k in (0, 1))
        order = np.argsort(keys)
        self.as_dict: dict[int, int] | None = None
        self.pair_keys, self.pair_ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(self.ranks[made[order]], NEVER)

    def merged_marks(self, n: int) -> list[int]:
        """The lengths of the pieces of a run of marks: the leftmost two that make a piece are merged, again and again.

        What lies left of the first such pair is settled, so each mark joins a stack and merges there as long as it can.
        """
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and out[-2] + out[-1] in self.runs:
                out[-2:] = [out[-2] + out[-1]]
        return out

    def _tied(self, piece: str) -> float:
        """Runs of marks tie; they come last of all."""
        return np.inf if piece not in self.rank else 1e9 if len(piece) > 1 and not piece.strip(MARK) else self.rank[piece]

    def _split(self, piece: str) -> bool:
        """Notes the last merge of a piece; False if merging doesn't lead to it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min((self._tied(a + b), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == np.inf:
                return False
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        self.halves[piece] = parts[0], parts[1]
        return True

    def follows(self, left: int, right: int) -> bool:
        """`follow` for one pair."""
        limit, ties, n = NEVER, False, len(self.names)
        if self.as_dict is None:
            self.as_dict = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
            self.as_lists = self.ranks.tolist(), self.left.tolist(), self.right.tolist()
        ranks, lefts, rights = self.as_lists
        while True:
            across = self.as_dict.get(left * n + right, NEVER)
            if across < limit or (across == limit and ties):
                return False
            a, b = ranks[left], ranks[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left piece was made later: undo it
                limit, ties, left = a, False, rights[left]
            else:
                limit, ties, right = b, True, lefts[right]

    def follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of numbered pieces, whether the encoding of both together is just these two.

        Undoes the later of the two last merges at the cut, until a merge across it would have come first: one that ranks
        below the last one undone. Of equal merges the left one comes first.
        """
        keys, back = np.unique(left * len(self.names) + right, return_inverse=True)
        left, right = np.divmod(keys, len(self.names))
        out, at = np.zeros(len(keys), bool), np.arange(len(keys))
        limit = np.full(len(keys), NEVER)
        ties = np.zeros(len(keys), bool)
        while len(at):
            key = left * len(self.names) + right
            place = np.searchsorted(self.pair_keys, key)
            across = np.where(self.pair_keys[place] == key, self.pair_ranks[place], NEVER)
            a, b = self.ranks[left], self.ranks[right]
            first = (across < limit) | ((across == limit) & ties)
            done = ~first & (a < 0) & (b < 0)
            out[at[done]] = True
            go = ~first & ~done
            at, left, right, a, b = at[go], left[go], right[go], a[go], b[go]
            later = a > b  # the left piece was made later: undo it
            limit, ties = np.where(later, a, b), ~later
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return out[back]


class SuffixSearch:
    """The suffixes of a text of bytes sorted by their first 16, and the range of each piece among them."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data + bytes(24), np.uint8)
        self.raw, n = raw, len(data)
        key = np.zeros(n + 8, np.uint64)
        for k in range(8):
            key = key << np.uint64(8) | raw[k : k + n + 8].astype(np.uint64)
        self.order = np.lexsort((key[8:], key[:n]))
        self.first, self.second = key[self.order], key[8:][self.order]

    def ranges(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By bisection, where suffixes between two bounds of 16 bytes (rows of two) begin and end."""
        return self._bisect(low, False), self._bisect(high, True)

    def _bisect(self, bound: np.ndarray, after: bool) -> np.ndarray:
        a, b = np.searchsorted(self.first, bound[:, 0], "left"), np.searchsorted(self.first, bound[:, 0], "right")
        while (open_ := a < b).any():
            mid = np.minimum((a + b) // 2, len(self.second) - 1)
            less = (self.second[mid] <= bound[:, 1]) if after else (self.second[mid] < bound[:, 1])
            a, b = np.where(open_ & less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return a


class PieceEncoder:
    """Encodes batches of texts; remembers words it has met."""

    def __init__(self, path: str, most_words: int = 400_000):
        self.model, self.most = PieceModel(path), most_words
        self.order = [x for x in self.model.usable if len(x) > 1]
        self.numbers = np.array([self.model.number[x] for x in self.order], np.int64)
        self.is_byte = np.isin(np.arange(len(self.model.pieces)), list(self.model.value_of))
        raw = [x.encode() for x in self.order]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.chars = np.array([len(x) for x in self.order], np.int64)
        bounds = lambda fill: np.frombuffer(b"".join(x[:16].ljust(16, fill) for x in raw), ">u8").astype(np.uint64).reshape(-1, 2)
        self.low, self.high = bounds(b"\0"), bounds(b"\xff")
        self.long = np.array([len(x) > 16 for x in raw])
        self.raw = raw
        self.cut = re.compile(f"(?<!{MARK})(?={MARK})")
        self._forget()

    def _forget(self) -> None:
        self.known, self.flat, self.at, self.n = Codes(), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where it ends, length in characters, piece) of every piece in the joined words, sorted by end, longest first."""
        text = "\n".join(words)  # joined by a character that no longer piece holds
        data = text.encode()
        search = SuffixSearch(data)
        a, b = search.ranges(self.low, self.high)
        n = b - a
        piece = np.repeat(np.arange(len(n)), n)
        at = search.order[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        far = np.nonzero(self.long[piece])[0]
        wrong = [k for k in far.tolist() if data[at[k] : at[k] + self.sizes[piece[k]]] != self.raw[piece[k]]]
        if wrong:
            keep = np.ones(len(at), bool)
            keep[wrong] = False
            at, piece = at[keep], piece[keep]
        starts = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
        end = np.cumsum(starts)[at] - 1 + self.chars[piece]
        order = np.lexsort((-self.chars[piece], end))
        return end[order], self.chars[piece][order], piece[order]

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of new words to the flat table."""
        marks = [len(w) - len(w.lstrip(MARK)) for w in words]
        cores = [w[m - 1 :] if m > 1 else w for w, m in zip(words, marks, strict=True)]
        ids, n = self.lattice(cores)
        ends, one, kept, done = np.cumsum(n), self.model.id_of[MARK], [], 0
        for k in (k for k, m in enumerate(marks) if m > 1):
            start = int(ends[k] - n[k])
            joins = int(ids[start]) == one  # the lattice's first piece is a mark alone, which joins the run
            run = [self.model.id_of[MARK * x] for x in self.model.merged_marks(marks[k] - 1 + joins)]
            kept += [ids[done:start], np.array(run, np.uint32)]
            done = start + joins
            n[k] += len(run) - joins
        ids = np.concatenate([*kept, ids[done:]])
        starts = np.cumsum(n) - n + len(self.flat)
        self.flat, self.at, self.n = np.concatenate([self.flat, ids]), np.concatenate([self.at, starts]), np.concatenate([self.n, n])

    def lattice(self, words: list[str], together: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row, and how many each has. Words of up to `together` characters are relaxed together."""
        model = self.model
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        end, size, piece = self.edges(words)
        piece = self.numbers[piece]
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        text = "\n".join(words)
        letters = {c: model.number.get(c, UNKNOWN) for c in set(text)}
        last = np.empty(len(text) + 1, np.int64)  # the last piece of the prefix that ends there; at first its last character
        last[1:] = [letters[c] for c in text]
        last[starts] = START
        word = np.searchsorted(starts, end - 1, "right") - 1
        depth = end - starts[word]
        of_end = np.concatenate([[0], np.nonzero(end[1:] != end[:-1])[0] + 1]) if len(end) else np.zeros(0, np.int64)
        turn = np.arange(len(end)) - np.repeat(of_end, np.diff(np.append(of_end, len(end))))
        alone = lengths[word] > together
        set_here = np.zeros(len(last), bool)
        step = depth * 1024 + turn
        order = np.argsort(np.where(alone, np.iinfo(np.int64).max, step), kind="stable")[: len(end) - int(alone.sum())]
        cuts = np.concatenate([[0], np.nonzero(np.diff(step[order]))[0] + 1, [len(order)]]) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            k = order[a:b]
            k = k[~set_here[end[k]]]
            before = last[end[k] - size[k]]
            ok = before < 0
            known = np.nonzero(~ok)[0]
            ok[known] = model.follow(before[known], piece[k[known]])
            k = k[ok]
            last[end[k]], set_here[end[k]] = piece[k], True
        self._relax_alone(np.nonzero(alone)[0], end, size, piece, last)
        return self._paths(words, starts, lengths, last)

    def _relax_alone(self, edges: np.ndarray, end: np.ndarray, size: np.ndarray, piece: np.ndarray, last: np.ndarray) -> None:
        """The same for the edges of very long words, one at a time."""
        done, held, follows = -1, {}, self.model.follows
        kept = last.tolist() if len(edges) else []
        for e, n, right in zip(end[edges].tolist(), size[edges].tolist(), piece[edges].tolist(), strict=True):
            if e == done:
                continue
            left = kept[e - n]
            ok = left < 0 or held.get((left, right))
            if ok is None:
                ok = held[left, right] = follows(left, right)
            if ok:
                kept[e], done = right, e
        if len(edges):
            last[:] = kept

    def _paths(self, words: list[str], starts: np.ndarray, lengths: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each word's end back to its start; an unknown character gives its bytes."""
        at, own = starts + lengths, np.arange(len(words))
        places, owners = [], []
        while len(own):
            places.append(at)
            owners.append(own)
            x = last[at]
            at = at - np.where(x < 0, 1, self.model.n_chars[np.maximum(x, 0)])
            go = at > starts[own]
            at, own = at[go], own[go]
        place = np.sort(np.concatenate(places))
        x = last[place]
        owner = np.searchsorted(starts, place - 1, "right") - 1
        ids = self.model.ids[np.maximum(x, 0)]
        if (x < 0).any():
            text = "\n".join(words)
            raw = [self.model.byte_id[b] for k in place[x < 0].tolist() for b in text[k - 1].encode()]
            n = np.ones(len(x), np.int64)
            n[x < 0] = [len(text[k - 1].encode()) for k in place[x < 0].tolist()]
            ids, unknown, owner = np.repeat(ids, n), np.repeat(x < 0, n), np.repeat(owner, n)
            ids[unknown] = raw
        return ids, np.bincount(owner, minlength=len(words))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.most:
            self._forget()
        get, codes = self.known.__getitem__, []
        for text in texts:
            marked = (" " + text if self.model.prefix and text else text).replace(" ", MARK)
            codes.append(np.fromiter(map(get, filter(None, self.cut.split(marked))), np.int64))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        n = self.n[every]
        ids = self.flat[np.repeat(self.at[every] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(x) for x in codes])] if codes else []
        return np.split(ids, ends[:-1]) if codes else []

    def decode(self, ids: np.ndarray) -> str:
        """Pieces joined, bytes of byte pieces put together, marks to blanks, less the blank put before the text."""
        pieces, value = self.model.pieces, self.model.value_of
        if not self.is_byte[ids].any():
            text = "".join(map(pieces.__getitem__, ids.tolist())).replace(MARK, " ")
            return text[1:] if self.model.prefix and text.startswith(" ") else text
        out, held = [], bytearray()
        for i in ids.tolist():
            if i in value:
                held.append(value[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held = bytearray()
            out.append(pieces[i])
        out.append(held.decode(errors="replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if self.model.prefix and text.startswith(" ") else text


def encode_pieces(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row a document: doc_id, n_pieces, ids_crc32 (little-endian unsigned 32-bit ids), round_trip, ids."""
    held = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(PieceEncoder(model or model_path())))  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = cloudpickle.loads(held.value)
        for part in slices(batches, "text", 4 << 20):
            texts = part.column("text").to_pylist()
            found = encoder.encode(texts)
            same = [encoder.decode(x) == t for x, t in zip(found, texts, strict=True)]
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
            ids = pa.array([x.astype(np.int32) for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(crc, pa.int64()), pa.array(same), ids], ["doc_id", "n_pieces", "ids_crc32", "round_trip", "ids"])

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, ids array<int>")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(documents(spark, sf_dir)).drop("ids")
