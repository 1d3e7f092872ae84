"""Document quality by a linear-chain conditional random field over lines.

A line is described by binned measures of its characters and words (letters in
capitals, digits, other signs, bars, word length, words repeated near by, line
length, the sign it ends with, earlier copies in the text) and by the same bins
of the line before and after.  A two-state chain labels every line good or bad;
it is trained on lines that carry their document's label.  Forward-backward
marginals, weighted by line length, aggregate to document quality through a
logistic layer.  Labels, language, source and id are never inputs.

Edge cases: null and empty texts have one empty line and get its score; repeated
rows score alike; an empty table gives an empty result; with no labels at all
every score is 0.5.  Lines without any byte count with weight one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf
from .runtime import crc_mod, table, text_or_empty
from .textnp import LOWER, SOLID, chunks, owners, release, span_hashes, spans
from .toxicity import training_rows

MAX_TRAIN_ROWS = 3000
MAX_TRAIN_CHARS = 30_000
#: Lags at which a word counts as repeated.
LAGS = (1, 2, 3)

_CLASS = np.zeros(256, dtype=np.int64)  # 0 other sign, 1 lower, 2 upper, 3 digit, 4 space, 5 usual sign, 6 bar
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[124] = 6
#: The bytes 0x83 and 0xC3..0xC5 start or end capital letters too seldom to matter.

_SHARE = np.array([0.004, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_EDGES = {
    "upper": _SHARE, "digit": _SHARE, "sign": _SHARE, "bar": _SHARE, "usual": _SHARE,
    "repeat": np.array([0.01, 0.05, 0.1, 0.2, 0.4, 0.7]),
    "distinct": np.array([0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95]),
    "word": np.array([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 11.0]),
    "size": np.array([1.0, 10, 25, 60, 150, 400, 1200]),
    "copies": np.array([0.5, 1.5]),
    "end": np.array([0.5, 1.5, 2.5]),
}
_BINS = 8
SLOTS = len(_EDGES)
N_FEATURES = 3 * SLOTS * _BINS


@dataclass
class Lines:
    owner: np.ndarray
    start: np.ndarray
    weight: np.ndarray
    features: np.ndarray


def _lines(chunk) -> Lines:
    data = chunk.data
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(ends)
    owner = owners(chunk, starts)
    length = ends - starts
    line_of = np.repeat(np.arange(n), length + 1)
    counts = np.bincount(line_of * 7 + _CLASS[data], minlength=7 * n).reshape(n, 7).astype(float)
    solid = np.maximum(1.0, length - counts[:, 4] + 1)
    low = LOWER[data]
    ws, we = spans(low, SOLID)
    words = span_hashes(low, ws, we) if len(ws) else np.zeros(0, np.uint64)
    at = np.searchsorted(ends, ws)
    per_line = np.bincount(at, minlength=n).astype(float)
    again = np.zeros(len(words), dtype=bool)
    for lag in LAGS:
        again[lag:] |= (words[lag:] == words[:-lag]) & (at[lag:] == at[:-lag])
    repeat = np.bincount(at, weights=again, minlength=n) / np.maximum(1, per_line)
    if len(words):
        tag = words ^ (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(tag)
        new = np.ones(len(words), dtype=bool)
        new[1:] = tag[order][1:] != tag[order][:-1]
        distinct = np.bincount(at[order], weights=new, minlength=n) / np.maximum(1, per_line)
    else:
        distinct = np.zeros(n)
    # more words make repeats likelier, so the share is put to the power that words of a plain text have
    distinct = np.where(per_line > 0, distinct ** (1 / np.maximum(1.0, np.log10(per_line + 1))), 1.0)
    lh = span_hashes(data, starts, ends) ^ (owner.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, first, inverse = np.unique(lh, return_index=True, return_inverse=True)
    copies = np.where((first[inverse] != np.arange(n)) & (length > 3), 1.0, 0.0)
    last = data[np.maximum(ends - 1, starts)]
    end = np.select([np.isin(last, [46, 63]), last == 33, _CLASS[last] == 1], [0.0, 1.0, 2.0], 3.0)
    letters = np.maximum(1.0, counts[:, 1] + counts[:, 2])
    values = {
        "upper": counts[:, 2] / letters, "digit": counts[:, 3] / solid, "sign": counts[:, 0] / solid, "bar": counts[:, 6] / solid,
        "usual": counts[:, 5] / solid, "repeat": repeat, "distinct": distinct, "word": solid / np.maximum(1.0, per_line), "size": length.astype(float), "copies": copies, "end": end,
    }
    own = np.column_stack([np.searchsorted(edges, values[k], side="right") + i * _BINS for i, (k, edges) in enumerate(_EDGES.items())])
    start = np.ones(n, dtype=bool)
    start[1:] = owner[1:] != owner[:-1]
    before, after = np.full_like(own, -1), np.full_like(own, -1)
    before[1:] = np.where(start[1:, None], -1, own[:-1] + SLOTS * _BINS)
    after[:-1] = np.where(start[1:, None], -1, own[1:] + 2 * SLOTS * _BINS)
    return Lines(owner, start, np.maximum(1.0, length), np.column_stack((own, before, after)))


@dataclass
class QualityModel:
    chain: crf.Model
    layer: np.ndarray


def _tag(lines: Lines, chain: crf.Model) -> np.ndarray:
    return crf.marginals(crf.emission(lines.features, chain.weights, chain.bias), lines.start, chain.trans, chain.init)


def _summary(p: np.ndarray, lines: Lines, n: int) -> np.ndarray:
    """Per text: length-weighted mean of P(good), its logit, and the largest weighted bad share."""
    total = np.bincount(lines.owner, weights=lines.weight, minlength=n)
    good = np.bincount(lines.owner, weights=lines.weight * p, minlength=n) / np.maximum(total, 1e-9)
    logit = np.log((good + 0.01) / (1.01 - good))
    worst = np.zeros(n)
    np.maximum.at(worst, lines.owner, (1 - p) * lines.weight / np.maximum(total, 1)[lines.owner])
    return np.column_stack((good, logit, worst))


def train(texts: pa.Array, quality: np.ndarray) -> QualityModel:
    """A model from a bounded sample, on the driver; deterministic."""
    y = np.asarray(quality, dtype=np.int64)
    parts = [(c, _lines(c)) for c in chunks(texts)]
    if not parts:
        return QualityModel(crf.train(np.zeros((0, 3 * SLOTS), np.int64), np.zeros(0), np.zeros(0, bool), N_FEATURES), np.zeros(4))
    features, start = np.concatenate([x.features for _, x in parts]), np.concatenate([x.start for _, x in parts])
    chain = crf.train(features, np.concatenate([y[c.first + x.owner] for c, x in parts]), start, N_FEATURES, steps=150, l2=0.002)
    summary = np.concatenate([_summary(_tag(x, chain), x, c.n) for c, x in parts])
    return QualityModel(chain, crf.logistic(summary, y, l2=1.0))


def fit(docs: DataFrame, labels: DataFrame, take, *, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> QualityModel:
    rows = training_rows(docs, labels, "quality", take, max_rows, max_chars)
    model = train(rows["t"].combine_chunks(), rows["y"].to_numpy())
    del rows
    release()  # the driver works on
    return model


def score_texts(texts: pa.Array, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score, number of lines and number of lines labelled bad, of every text."""
    score, n_lines, n_bad = np.empty(len(texts)), np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    for c in chunks(texts):
        lines = _lines(c)
        p = _tag(lines, model.chain)
        x = _summary(p, lines, c.n)
        at = slice(c.first, c.first + c.n)
        score[at] = crf.sigmoid(x @ model.layer[:-1] + model.layer[-1])
        n_lines[at] = np.bincount(lines.owner, minlength=c.n)
        n_bad[at] = np.bincount(lines.owner, weights=p < 0.5, minlength=c.n)
    return score, n_lines, n_bad


def rate_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, quality, n_lines, n_bad_lines of every row."""
    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, quality double, n_lines bigint, n_bad_lines bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n, bad = score_texts(b.column("text"), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array(n), pa.array(bad)], ["doc_id", "quality", "n_lines", "n_bad_lines"])

    return source.mapInArrow(run, schema)


def held_out(doc_id):
    return F.coalesce(crc_mod(doc_id, 3) == 1, F.lit(False))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    return rate_quality(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("quality").alias("score"),
        F.when(F.col("quality") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        "n_lines",
        "n_bad_lines",
    )


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score at least 0.5, all their columns and rows.

    Null and empty texts have the score of one empty line, repeated rows the same one; a null id is kept
    or dropped by its text; a text of any length is read whole; an empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column(at), model)[0] >= 0.5))

    return docs.mapInArrow(run, docs.schema)
