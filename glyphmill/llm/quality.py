"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Every passage is encoded from what its bytes and words look like;
a gated attention (tanh times sigmoid) weighs the passages, and a logistic layer scores their weighted mean.  Encoder,
attention and scorer are learnt together from document labels, by Adam on the cross entropy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import words as W
from glyphmill.llm.session import extended, relieve

PASSAGE = 64
#: Labelled documents that training takes (those of smallest id hash), and passages of each: of a longer text as many,
#: evenly spaced over the whole of it.  Scores use every passage.
SAMPLE_ROWS = 4000
SAMPLE_PASSAGES = 256
ENCODED, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 24, 12, 40, 64, 4e-3, 2e-4

#: Classes of bytes: each printable ASCII sign its own, digits, a-z, A-Z, white space, control, beyond ASCII.
_CLASS = np.zeros(256, dtype=np.int64)
_signs = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_signs] = np.arange(len(_signs))
_CLASS[48:58] = len(_signs)
_CLASS[97:123] = len(_signs) + 1
_CLASS[65:91] = len(_signs) + 2
_CLASS[[9, 10, 11, 12, 13, 32]] = len(_signs) + 3
_CLASS[[*range(9), *range(14, 32), 127]] = len(_signs) + 4
_CLASS[128:] = len(_signs) + 5
_CLASSES = len(_signs) + 6
_HASHED = 64
_SHAPES = 8
FEATURES = _CLASSES + _HASHED + _SHAPES


def passages(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a chunk's documents (float32), and each passage's document.

    A document without words has one passage, all zeros.
    """
    found = W.words(chunk.text, W.NON_SPACE)
    n = len(chunk.bounds) - 1
    at = np.searchsorted(found.starts, chunk.bounds)
    counts = np.diff(at)
    per_doc = np.maximum(1, -(-counts // PASSAGE))
    first = np.append(0, np.cumsum(per_doc))
    total = int(first[-1])
    of_passage = np.repeat(np.arange(n), per_doc)
    x = np.zeros((total, FEATURES), dtype=np.float32)
    if not len(found.hashes):
        return x, of_passage
    doc = np.repeat(np.arange(n), counts)
    of_word = first[doc] + (np.arange(len(doc)) - at[doc]) // PASSAGE
    words_in = np.bincount(of_word, minlength=total)
    new = np.append(True, of_word[1:] != of_word[:-1])
    begin, end = found.starts[new], found.ends[np.append(new[1:], True)]
    filled = of_word[new]
    inside = np.zeros(len(chunk.text) + 1, dtype=np.int64)
    inside[begin] += 1
    inside[end] -= 1
    covered = np.cumsum(inside[:-1]).astype(bool)
    of_byte = np.repeat(filled, end - begin)
    size = np.bincount(of_byte, minlength=total)
    classes = np.bincount(of_byte * _CLASSES + _CLASS[chunk.text[covered]], minlength=total * _CLASSES).reshape(total, _CLASSES)
    x[:, :_CLASSES] = np.sqrt(classes / np.maximum(size, 1)[:, None])
    hashed = np.bincount(of_word * _HASHED + (found.hashes & np.uint64(_HASHED - 1)).astype(np.int64), minlength=total * _HASHED).reshape(total, _HASHED)
    x[:, _CLASSES : _CLASSES + _HASHED] = np.sqrt(hashed / np.maximum(words_in, 1)[:, None])
    shape = x[:, _CLASSES + _HASHED :]
    length = (found.ends - found.starts).astype(np.float64)
    some = np.maximum(words_in, 1)
    mean = np.bincount(of_word, length, total) / some
    shape[:, 0] = np.log1p(words_in)
    shape[:, 1] = np.log1p(mean)
    shape[:, 2] = np.sqrt(np.maximum(0, np.bincount(of_word, length**2, total) / some - mean**2))
    order = np.lexsort((found.hashes, of_word))
    same = np.append(False, (found.hashes[order][1:] == found.hashes[order][:-1]) & (of_word[order][1:] == of_word[order][:-1]))
    shape[:, 3] = np.bincount(of_word[order], same, total) / some
    first_byte, last_byte = chunk.text[found.starts], chunk.text[found.ends - 1]
    shape[:, 4] = np.bincount(of_word, (first_byte >= 65) & (first_byte <= 90), total) / some
    shape[:, 5] = np.bincount(of_word, W.ALNUM[W.LOWER[last_byte]] == 0, total) / some
    shape[:, 6] = np.bincount(of_word, length <= 3, total) / some
    shape[:, 7] = np.log1p(counts)[of_passage]
    return x, of_passage


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Weights of the encoder, the gated attention and the scorer; bags are sorted runs of passages."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 0):
        draw = np.random.default_rng(seed).normal
        self.mean, self.scale = mean, scale
        self.w = {
            "encode": draw(0, FEATURES**-0.5, (FEATURES, ENCODED)),
            "encode_0": np.zeros(ENCODED),
            "tanh": draw(0, ENCODED**-0.5, (ENCODED, ATTENTION)),
            "gate": draw(0, ENCODED**-0.5, (ENCODED, ATTENTION)),
            "attend": draw(0, ATTENTION**-0.5, ATTENTION),
            "score": draw(0, ENCODED**-0.5, ENCODED),
            "score_0": np.zeros(1),
        }

    def forward(self, x: np.ndarray, bag: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        starts = np.flatnonzero(np.append(True, bag[1:] != bag[:-1]))
        own = np.cumsum(np.append(False, bag[1:] != bag[:-1]))
        h = np.tanh(x @ w["encode"] + w["encode_0"])
        t, s = np.tanh(h @ w["tanh"]), _sigmoid(h @ w["gate"])
        e = (t * s) @ w["attend"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[own])
        a = e / np.add.reduceat(e, starts)[own]
        z = np.add.reduceat(h * a[:, None], starts)
        return {"x": x, "own": own, "starts": starts, "h": h, "t": t, "s": s, "a": a, "z": z, "p": _sigmoid(z @ w["score"] + w["score_0"])}

    def gradient(self, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
        w, own, h, t, s, a = self.w, f["own"], f["h"], f["t"], f["s"], f["a"]
        d = (f["p"] - y) / len(y)
        dz = (d[:, None] * w["score"])[own]
        da = (h * dz).sum(1)
        de = a * (da - np.add.reduceat(a * da, f["starts"])[own])
        dg = de[:, None] * w["attend"]
        dt, ds = dg * s * (1 - t * t), dg * t * s * (1 - s)
        dh = (a[:, None] * dz + dt @ w["tanh"].T + ds @ w["gate"].T) * (1 - h * h)
        return {"encode": f["x"].T @ dh, "encode_0": dh.sum(0), "tanh": h.T @ dt, "gate": h.T @ ds, "attend": (t * s).T @ de, "score": f["z"].T @ d, "score_0": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                x = np.concatenate([bags[i] for i in some])
                grads = self.gradient(self.forward(x, np.repeat(np.arange(len(some)), [len(bags[i]) for i in some])), y[some])
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = g + DECAY * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self


def _bag_kernel(columns: list[pa.Array]) -> list[pa.Array]:
    out = []
    for chunk in W.chunks(columns[0]):
        x, doc = passages(chunk)
        for a, b in zip(*(np.searchsorted(doc, np.arange(len(chunk.bounds) - 1), side) for side in ("left", "right"))):
            own = np.arange(a, b) if b - a <= SAMPLE_PASSAGES else np.linspace(a, b - 1, SAMPLE_PASSAGES).astype(int)
            out.append(x[own].tobytes())
    return [pa.array(out, pa.binary())]


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``rows`` labelled documents; None without both labels.

    ``labels(doc_id, quality)``: rows with a null in either are skipped; a document labelled twice counts as its
    smallest label, and rows that share a doc_id as one, with the smallest text.  The choice hangs on hashes of ids
    only.  A text of more than SAMPLE_PASSAGES passages gives as many, evenly spaced.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    got = extended(chosen, ["text"], [T.StructField("bag", T.BinaryType())], _bag_kernel, drop=("text",)).select("doc_id", "quality", "bag").collect()
    got.sort(key=lambda r: (r.doc_id, r.bag))
    y = np.array([r.quality for r in got], dtype=np.float64)
    if len(set(y)) < 2:
        return None
    bags = [np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES).astype(np.float64) for r in got]
    every = np.concatenate(bags)
    relieve(docs.sparkSession)
    return Model(every.mean(0), every.std(0) + 0.02).fit(bags, y)


def _score_kernel(model: Model | None):
    def of(columns: list[pa.Array]) -> list[pa.Array]:
        out = [np.zeros(0)]
        for chunk in W.chunks(columns[0]):
            x, doc = passages(chunk)
            out.append(np.full(len(chunk.bounds) - 1, 0.5) if model is None else model.forward(x, doc)["p"])
        return [pa.array(np.concatenate(out), pa.float64())]

    return of


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` and ``score`` (0 to 1, from whole texts only), which replaces a column of that name.

    Null and empty texts are one empty passage and get its score.  Without a model every score is 0.5.  Equal texts
    have equal scores; an empty table gives no rows.
    """
    return extended(docs, ["text"], [T.StructField("score", T.DoubleType())], _score_kernel(model))


def held_out(doc_id):
    """Whether crc32 of the id as text leaves 1 modulo 3; null for a null id, whose labels train nothing."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1
