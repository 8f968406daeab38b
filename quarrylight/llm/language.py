"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text's UTF-8 bytes are read in stretches of `stretch` bytes, forward and backward; from both states every position gets
language probabilities. A document's probabilities are their mean over the positions of letters (ASCII letters and all
bytes of other characters). The network is trained by backpropagation through time on windows spread over whole
texts of a bounded sample: about `most_documents` documents a language, chosen by a hash of doc_id, of the `most_languages`
most frequent languages (rarer ones are not learned and so never predicted). At most twice as many windows as that sample
has on average are gathered, in the order of a hash; only ids that repeat very often reach that bound.

Defined results: a null text, or one without letters, is `und` with score 0; a null doc_id is carried through and never
used for training; null langs teach nothing; without any language to learn all are `und`; repeated rows get equal values;
an empty table gives an empty result; further columns are ignored. Texts are read whole, however long, in stretches; of equally
probable languages the first by name is told. More languages than `most_languages` are an error, none is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import documents, slices

A_LETTER = regex.compile(r"\p{L}")
IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


class Direction:
    """One gated recurrent layer; arrays are features x rows. Parameters: e (3h x 256, bytes), u (3h x h)."""

    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.e = rng.normal(0, 0.5, (3 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)).astype(np.float32)
        self.e[:hidden] += 1  # at first a state is rather kept

    def states(self, codes: np.ndarray, keep: bool = False) -> np.ndarray:
        """codes: steps x rows. The state after each step: steps x h x rows."""
        h, (steps, rows) = self.h, codes.shape
        out = np.empty((steps, h, rows), np.float32)
        state, self.kept = np.zeros((h, rows), np.float32), []
        for t in range(steps):
            x, r = np.take(self.e, codes[t], axis=1), self.u @ state
            gates = gate(x[: 2 * h] + r[: 2 * h])
            new = np.tanh(x[2 * h :] + gates[h:] * r[2 * h :])
            if keep:
                self.kept.append((state, gates, new, r[2 * h :]))
            state = new + gates[:h] * (state - new)
            out[t] = state
        return out

    def learn(self, codes: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Slopes of e and u by backpropagation through time, from those of the states."""
        h, back = self.h, np.zeros(slope.shape[1:], np.float32)
        de, du = np.zeros_like(self.e), np.zeros_like(self.u)
        inputs = np.empty((len(codes), 3 * h, codes.shape[1]), np.float32)
        for t in range(len(codes) - 1, -1, -1):
            state, gates, new, r = self.kept[t]
            d = back + slope[t]
            keep, reset = gates[:h], gates[h:]
            dn = d * (1 - keep) * (1 - new * new)
            inner = np.concatenate([d * (state - new), dn * r]) * np.float32(0.25) * ((gates > 0) & (gates < 1))
            inputs[t, : 2 * h], inputs[t, 2 * h :] = inner, dn
            through = np.concatenate([inner, dn * reset])
            du += through @ state.T
            back = d * keep + self.u.T @ through
        flat, codes = inputs.transpose(1, 0, 2).reshape(3 * h, -1), codes.ravel()
        for k in range(3 * h):
            de[k] = np.bincount(codes, flat[k], 256)
        return [de, du]


class ByteTagger:
    """Both directions and a linear layer over their states."""

    def __init__(self, languages: list[str], hidden: int = 10, stretch: int = 64, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.stretch = languages, stretch
        self.ahead, self.behind = Direction(hidden, rng), Direction(hidden, rng)
        self.w = rng.normal(0, 0.3, (len(languages), 2 * hidden)).astype(np.float32)
        self.b = np.zeros((len(languages), 1), np.float32)

    def _joined(self, codes: np.ndarray, keep: bool = False) -> np.ndarray:
        return np.concatenate([self.ahead.states(codes, keep), self.behind.states(codes[::-1], keep)[::-1]], axis=1)

    def _probabilities(self, joined: np.ndarray) -> np.ndarray:
        out = self.w @ joined + self.b
        np.exp(out - out.max(1, keepdims=True), out=out)
        return out / out.sum(1, keepdims=True)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 12, rows: int = 256, rate: float = 0.02, seed: int = 11) -> ByteTagger:
        """windows: rows x stretch bytes; labels: index of each row's language. Adam on mean cross-entropy."""
        rng = np.random.default_rng(seed)
        parameters = [self.ahead.e, self.ahead.u, self.behind.e, self.behind.u, self.w, self.b]
        first, second, k = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters], 0
        steps = max(1, epochs * -(-len(windows) // rows))
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for a in range(0, len(order), rows):
                codes, y = windows[order[a : a + rows]].T, labels[order[a : a + rows]]
                joined = self._joined(codes, keep=True)
                slope = self._probabilities(joined)
                slope[:, y, np.arange(len(y))] -= 1
                slope *= (IS_LETTER[codes] / max(1, IS_LETTER[codes].sum()))[:, None, :].astype(np.float32)
                states = self.w.T @ slope
                h = self.ahead.h
                grads = [*self.ahead.learn(codes, states[:, :h]), *self.behind.learn(codes[::-1], states[::-1, h:])]
                grads += [np.einsum("tlr,thr->lh", slope, joined, optimize=True), slope.sum((0, 2))[:, None]]
                k += 1
                for p, g, m, v in zip(parameters, grads, first, second, strict=True):
                    m += np.float32(0.1) * (g - m)
                    v += np.float32(0.001) * (g * g - v)
                    p -= np.float32(rate * (1 - k / (steps + 1))) * (m / np.float32(1 - 0.9**k)) / (np.sqrt(v / np.float32(1 - 0.999**k)) + np.float32(1e-8))
        self.ahead.kept = self.behind.kept = []
        return self

    def tag(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities of each position: stretch x languages x rows."""
        return self._probabilities(self._joined(windows.T))

    def pool(self, texts: list[bytes], rows: int = 2048) -> np.ndarray:
        """Mean probabilities of each text's letters: texts x languages."""
        s = self.stretch
        n = np.array([-(-len(x) // s) for x in texts], np.int64)
        data = np.frombuffer(b"".join(x + bytes(-len(x) % s) for x in texts), np.uint8).reshape(-1, s)
        owner = np.repeat(np.arange(len(texts)), n)
        total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for a in range(0, len(data), rows):
            part = data[a : a + rows]
            weight = IS_LETTER[part].astype(np.float32)
            sums = np.einsum("tlr,rt->rl", self.tag(part), weight)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(owner[a : a + rows], sums[:, k], len(texts))
            letters += np.bincount(owner[a : a + rows], weight.sum(1), len(texts))
        return total / np.maximum(letters, 1)[:, None]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Documents that teach nothing: crc32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, most_documents: int, windows: int, stretch: int, most_languages: int = 1000) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of bytes spread evenly over the whole texts of a bounded sample, their language's index, the languages."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text")
    counts = usable.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"there are more than {most_languages} languages to learn: raise most_languages, which bounds the sample")
    if not counts:
        return np.zeros((0, stretch), np.uint8), np.zeros(0, np.int64), []
    bound = 2 * len(counts) * most_documents * windows
    counts = docs.sparkSession.createDataFrame([tuple(r) for r in counts], "lang string, count long")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = usable.join(F.broadcast(counts), "lang").where(share < F.lit(float(most_documents)) / F.col("count"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            ids, langs, data, place = [], [], [], []
            for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = text.encode()
                for k in range(min(windows, -(-len(raw) // stretch))):
                    a = max(0, len(raw) - stretch) * k // max(1, windows - 1)
                    ids.append(doc_id)
                    langs.append(lang)
                    data.append(raw[a : a + stretch].ljust(stretch, b"\0"))
                    place.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(data, pa.binary()), pa.array(place, pa.int32())], ["doc_id", "lang", "data", "place"])

    rows = sample.select("doc_id", "lang", "text").mapInArrow(cut, "doc_id long, lang string, data binary, place int")
    got = rows.orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place", "data").limit(bound).toPandas()
    languages = sorted(got["lang"].unique())
    data = np.frombuffer(b"".join(map(bytes, got["data"])), np.uint8).reshape(-1, stretch)
    return data, got["lang"].map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64), languages


def identify(docs: DataFrame, most_documents: int = 300, windows: int = 4, stretch: int = 64, most_languages: int = 1000) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    data, labels, languages = training_windows(docs, most_documents, windows, stretch, most_languages)
    tagger = ByteTagger(languages, stretch=stretch).fit(data, labels) if languages else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            texts = [x or "" for x in part.column("text").to_pylist()]
            named = np.array([tagger is not None and A_LETTER.search(x) is not None for x in texts])
            p = tagger.pool([x.encode() for x in texts]) if tagger else np.zeros((len(texts), 1))
            best = p.argmax(1)
            langs = [languages[k] if ok else "und" for k, ok in zip(best, named, strict=True)]
            score = np.where(named, p[np.arange(len(p)), best], 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
