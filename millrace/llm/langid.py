"""Language identification: averaged hashed subword embeddings under a linear softmax, trained in numpy.

A text's letters, lower-cased and with single spaces between words, give character n-grams of 1 to 4; each is hashed to
a row of an embedding table, and the mean row goes through a linear layer. Both are trained by stochastic gradient
descent on a bounded sample. As the mean and the layer are linear, prediction sums one row of class scores per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, DIMS, GRAMS = 1 << 15, 12, (1, 2, 3, 4)
#: At most so many documents of each language are learned from; what else is labelled is not read for the fit.
SAMPLE_PER_LANGUAGE = 300
#: Lengths of the pieces of text, in characters, that training sees as units; a document gives about PIECES_OF_ONE, spread
#: over it, so that the sample is bounded in text too. Prediction reads whole texts.
PIECE, PIECES_OF_ONE = (240, 60, 20), 9
#: A prediction is rejected if its confidence is by the first number under the least that any whole document held back
#: from training has, and never above the second: clean documents stay, even where many are mixed.
MARGIN, MOST_ASKED = 0.15, 0.9
_MULTIPLIER = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def _letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> np.ndarray | None:
    """Bucket numbers of all n-grams; None where there are no letters."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letter()[codes]
    if not letters.any():
        return None
    codes = np.where(letters, codes, np.uint32(32))
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = np.concatenate(([np.uint32(32)], codes[keep], [np.uint32(32)])).astype(np.uint32)
    out, h = [], np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] ^ codes[n - 1 :]) * _MULTIPLIER
        h ^= h >> np.uint32(15)
        if n in GRAMS:
            out.append(((h + np.uint32(n)) * _MULTIPLIER) >> np.uint32(17))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # a row of class scores per bucket
    bias: np.ndarray
    least: float  # predictions under this confidence are rejected
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, whether it is rejected; ``und`` with 0 where there are no letters or no language was learned."""
        idx = features(text)
        if idx is None or not self.languages:
            return "und", 0.0, True
        z = (np.bincount(idx, minlength=BUCKETS) @ self.scores / len(idx) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def fit(texts: list[list[str]], langs: list[str], epochs: int = 3, seed: int = 7) -> Model:
    """Trains on labelled texts. One language: it is always predicted, and every text without foreign n-grams accepted; no
    labelled text: a model that knows no language. The result depends on the inputs alone."""
    if not texts:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 0.0, 1.0)
    languages = sorted(set(langs))
    pieces: list[tuple[np.ndarray, int]] = []
    owner: list[int] = []
    for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):  # a text is the list of its pieces
        for j, piece in enumerate(text):
            if (idx := features(piece[: PIECE[j % len(PIECE)]])) is not None:
                pieces.append((idx, languages.index(lang)))
                owner.append(k)
    if not pieces:
        pieces, owner = [(np.zeros(1, np.uint32), k) for k in range(len(languages))], list(range(len(languages)))
    rng = np.random.default_rng(seed)
    # Whole documents are set aside, a fifth of them.
    held = np.isin(owner, rng.permutation(len(texts))[: len(texts) // 5])
    aside, order = np.flatnonzero(held), np.flatnonzero(~held)
    table, layer, bias = rng.normal(0, 1 / DIMS, (BUCKETS, DIMS)), np.zeros((DIMS, len(languages))), np.zeros(len(languages))
    layer[:] = rng.normal(0, 0.1, layer.shape)
    steps = max(1, epochs * -(-len(order) // 32))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(order)
        for at in range(0, len(order), 32):
            rate = 0.5 * (1 - step / steps)
            step += 1
            own = [pieces[k] for k in order[at : at + 32]]
            lengths = np.array([len(x) for x, _ in own])
            idx, starts = np.concatenate([x for x, _ in own]), np.cumsum(lengths) - lengths
            mean = np.add.reduceat(table[idx], starts, axis=0) / lengths[:, None]
            z = mean @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), [y for _, y in own]] -= 1
            back = (p @ layer.T) / lengths[:, None]
            layer -= rate / len(own) * 8 * mean.T @ p
            bias -= rate / len(own) * p.sum(axis=0)
            rows, where = np.unique(idx, return_inverse=True)
            of = np.repeat(np.arange(len(own)), lengths)
            weight = np.bincount(where * len(own) + of, minlength=len(rows) * len(own)).reshape(len(rows), len(own))
            table[rows] -= rate * 20 * weight @ back
    model = Model(languages, table @ layer, bias, 0.0, 1.0)
    # Temperature and the least confidence come from the pieces set aside.
    z = np.array([np.bincount(pieces[k][0], minlength=BUCKETS) @ model.scores / len(pieces[k][0]) + bias for k in aside])
    if len(z):
        y = np.array([pieces[k][1] for k in aside])

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]))

        model.temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
        whose, weights = np.array(owner)[aside], np.array([len(pieces[k][0]) for k in aside], float)
        _, row = np.unique(whose, return_inverse=True)
        mean = np.stack([np.bincount(row, weights * z[:, c]) for c in range(z.shape[1])], axis=1) / np.bincount(row, weights)[:, None] / model.temperature
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        model.least = float(min((p / p.sum(axis=1, keepdims=True)).max(axis=1).min() - MARGIN, MOST_ASKED))
    return model


def learnable(docs: DataFrame) -> DataFrame:
    """The documents that may be learned from: labelled, with text, and crc32(doc_id as text) mod 3 not 1."""
    return docs.where("text is not null and lang is not null and crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 <> 1")


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on at most ``per_language`` documents of each language: those with the least hashes of id and text, so that
    neither the split nor repeated rows decide and no language is left out. No labelled document: see fit().

    One row per language comes to the driver first; labels are taken to be few.
    """
    own = learnable(docs).select("lang", "text", F.xxhash64(F.lit(11), "doc_id", "text").alias("h"))
    counts = own.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("h")).collect()
    # A threshold on the hash first leaves few rows to rank; the least hash passes in any case.
    passes = F.lit(False)
    for r in sorted(counts):
        most = min((3 * per_language << 64) // r["n"], 1 << 64) - (1 << 63) - 1
        passes = passes | ((F.col("lang") == r["lang"]) & (F.col("h") <= F.lit(max(most, r["h"]))))
    ranked = own.where(passes).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text")))
    chosen = ranked.where(F.col("n") <= per_language).select("lang", "h", "n", _pieces_of(F.col("text")).alias("text"))
    rows = sorted(tuple(r) for r in chosen.collect())
    return fit([r[3] for r in rows], [r[0] for r in rows])


def _pieces_of(text: Column) -> Column:
    """What fit() reads of a text: equal pieces spread over it, so the driver gets a bounded number of characters."""
    count = F.ceil(F.char_length(text) / max(PIECE))
    step = F.greatest(F.lit(1), F.floor(count / PIECES_OF_ONE)).cast("int")
    starts = F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)).cast("int"), step)
    return F.transform(starts, lambda k: F.substr(text, k * max(PIECE) + 1, F.lit(max(PIECE))))


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Of (text, and the columns to ``keep``): those columns, lang_pred, score (0 to 1), rejected.

    One row per input row, repeated rows included. Null texts and texts without letters are ``und``, score 0, rejected;
    any other gets a learned language and is rejected if its confidence is under the calibrated least. Only the whole
    text decides. A model without languages (nothing was labelled) says ``und``, score 0, rejected, of every text. An empty
    table gives no rows. Kept columns named like the results are replaced by them.
    """
    new = ["lang_pred", "score", "rejected"]
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.predict(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*keep, *new])

    frame = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    results = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return frame.mapInArrow(rows, T.StructType([*frame.schema.fields[:-1], *results]))


def held_out() -> Column:
    """Whether a row's document may not be learned from; false for a null doc_id."""
    return F.coalesce(F.expr("crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1"), F.lit(False))
