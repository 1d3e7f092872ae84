"""Toxic spans and document toxicity by a linear-chain conditional random field.

Tokens are runs of letters and digits, A-Z lower-cased.  Document labels give
token labels by weak supervision: a word or word beginning that occurs almost
only in documents labelled toxic marks its tokens there.  A two-state chain is
trained on those token labels (features: the token's word and beginnings of
four, five and six bytes, whether other words of the text begin so too, and the same of its two neighbours), forward-backward
marginals tag tokens, and a logistic layer turns the marginals into a document
score.  Nothing but the text is an input of a score.

Edge cases: a null or empty text, or one without a token, is scored by the
logistic layer at zero; repeated rows are scored alike; an empty table gives an
empty result; without any label of either kind every score is the base rate
(0.5 for no labels at all).
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
from .textnp import LOWER, WORDY, chunks, code_points, mix, owners, ranges, release, shingles, span_hashes, spans

#: Bounds of the training sample: labelled rows, and characters of one text.
MAX_TRAIN_ROWS = 2500
MAX_TRAIN_CHARS = 30_000
#: Tokens on which the chain's weights are trained (all toxic texts first).
MAX_TRAIN_TOKENS = 400_000
PREFIXES = (4, 5, 6)
#: A feature marks a token of a toxic text as offending from this many toxic texts, if it is so many
#: times as frequent among them as among the others, and from this z score of the difference.
MIN_TEXTS, MIN_RATIO, MIN_Z = 2, 8.0, 4.0
#: A weaker association makes a feature of the chain.
FEATURE_Z = 3.0
TAG_AT = 0.5
_OWNER = np.uint64(0xC2B2AE3D27D4EB4F)
FOLDS = 3


@dataclass
class Tokens:
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    #: (n, 7) hashes: the word, its beginnings (0: shorter than that), and the same
    #: beginnings if other words of the text begin so too (else 0)
    keys: np.ndarray


def _tokens(chunk) -> Tokens:
    low = LOWER[chunk.data]
    starts, ends = spans(low, WORDY)
    keys = np.zeros((len(starts), 1 + 2 * len(PREFIXES)), dtype=np.uint64)
    owner = owners(chunk, starts)
    cuts = [ends] + [np.minimum(starts + p, ends) for p in PREFIXES]
    flat = span_hashes(low, np.concatenate([starts] * len(cuts)), np.concatenate(cuts)) if len(starts) else np.zeros(0, np.uint64)
    for j in range(len(cuts)):
        keys[:, j] = flat[j * len(starts) : (j + 1) * len(starts)] ^ np.uint64(j)
        if j:
            keys[ends - starts < PREFIXES[j - 1], j] = 0
            keys[:, len(PREFIXES) + j] = _of_several_words(keys[:, j], keys[:, 0], owner)
    return Tokens(starts, ends, owner, keys)


def _of_several_words(begin: np.ndarray, word: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Another hash of each beginning that different words of one text share, 0 for the others."""
    out = np.zeros(len(begin), dtype=np.uint64)
    at = np.flatnonzero(begin)
    if len(at):
        group = mix(begin[at] + owner[at].astype(np.uint64) * _OWNER)
        order = np.argsort(group)
        first = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1])))
        words = word[at][order]
        several = np.minimum.reduceat(words, first) != np.maximum.reduceat(words, first)
        several = order[np.repeat(several, np.diff(np.append(first, len(at))))]
        out[at[several]] = mix(begin[at[several]])
    return out


class Lookup:
    """Hash to id, with a bit table in front so that most misses cost one read."""

    BITS = 18

    def __init__(self, keys: np.ndarray, ids: np.ndarray | None = None):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ids = (np.arange(len(keys)) if ids is None else ids)[order]
        self.bits = np.zeros(1 << self.BITS, dtype=bool)
        self.bits[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, dtype=np.int64)
        if len(self.keys):
            may = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, hashes[may]), len(self.keys) - 1)
            hit = self.keys[at] == hashes[may]
            out[may[hit]] = self.ids[at[hit]]
        return out


@dataclass
class ToxicityModel:
    lookup: Lookup
    chain: crf.Model
    layer: np.ndarray


def _features(tokens: Tokens, chunk_n: int, lookup: Lookup) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids (n, 9) - own word and beginnings, best of each neighbour - and sequence starts."""
    n, width = tokens.keys.shape
    own = np.column_stack([lookup(tokens.keys[:, j]) for j in range(width)]) if n else np.zeros((0, width), np.int64)
    start = np.ones(n, dtype=bool)
    start[1:] = tokens.owner[1:] != tokens.owner[:-1]
    best = own.max(axis=1) if n else np.zeros(0, np.int64)
    size = len(lookup.keys)
    before, after = np.full(n, -1), np.full(n, -1)
    if n:
        before[1:] = np.where(start[1:] | (best[:-1] < 0), -1, best[:-1] + size)
        after[:-1] = np.where(start[1:] | (best[1:] < 0), -1, best[1:] + 2 * size)
    return np.column_stack((own, before, after)), start


def _tag(tokens: Tokens, n_texts: int, lookup: Lookup, chain: crf.Model) -> np.ndarray:
    features, start = _features(tokens, n_texts, lookup)
    return crf.marginals(crf.emission(features, chain.weights, chain.bias), start, chain.trans, chain.init)


def _summary(p: np.ndarray, owner: np.ndarray, n_texts: int) -> np.ndarray:
    """Per text: largest marginal, log of the expected number of offending tokens, their density."""
    total = np.bincount(owner, weights=p, minlength=n_texts)
    count = np.bincount(owner, minlength=n_texts)
    top = np.zeros(n_texts)
    np.maximum.at(top, owner, p)
    return np.column_stack((top, np.log1p(total), np.sqrt(total / np.maximum(count, 1))))


def _distinct_texts(parts: list, n: int) -> np.ndarray:
    """One of each set of near copies, by two minimum hashes."""
    keep, seen = np.ones(n, dtype=bool), set()
    for c, t in parts:
        h, own = shingles(t.keys[:, 0], t.owner, c.n, 5)
        for i in range(c.n):
            mine = h[np.searchsorted(own, i) : np.searchsorted(own, i, side="right")]
            if len(mine):
                marks = {int(mine.min()), int((mine ^ np.uint64(0x5555555555555555)).min()) ^ 1}
                keep[c.first + i] = not (marks & seen)
                seen |= marks
    return keep


def _text_keys(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Every key once for each text that has it: text, key."""
    doc, key = [], []
    for c, t in parts:
        for j in range(t.keys.shape[1]):
            ok = t.keys[:, j] != 0
            own, k = t.owner[ok], t.keys[ok, j]
            order = np.lexsort((k, own))
            own, k = own[order], k[order]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (own[1:] != own[:-1]) | (k[1:] != k[:-1])
            doc.append((own[new] + c.first).astype(np.int32))
            key.append(k[new])
    return (np.concatenate(doc), np.concatenate(key)) if doc else (np.zeros(0, np.int32), np.zeros(0, np.uint64))


def _fit_chain(parts: list, y: np.ndarray, use: np.ndarray, named: tuple[np.ndarray, np.ndarray, np.ndarray], keep: np.ndarray) -> tuple[Lookup, crf.Model]:
    """Features and chain from the texts ``use``; ``named``: the keys, and text and key number of every occurrence."""
    names, doc, at = named
    counted = (use & keep)[doc]
    n1 = np.bincount(at[counted], weights=y[doc[counted]], minlength=len(names))
    n0 = np.bincount(at[counted], minlength=len(names)) - n1
    big1, big0 = max(1, int((y * use * keep).sum())), max(1, int(((1 - y) * use * keep).sum()))
    p = (n1 + n0) / (big1 + big0)
    z = (n1 / big1 - n0 / big0) / np.sqrt(p * (1 - p) * (1 / big1 + 1 / big0) + 1e-12)
    feature = (z >= FEATURE_Z) & (n1 >= 2)
    names, n1, n0, z = names[feature], n1[feature], n0[feature], z[feature]
    offending = Lookup(names[(z >= MIN_Z) & (n1 >= MIN_TEXTS) & (n1 * big0 >= MIN_RATIO * n0 * big1)])
    lookup = Lookup(names)
    blocks, labels, starts, toxic = [], [], [], []
    for c, t in parts:
        features, start = _features(t, c.n, lookup)
        bad = np.zeros(len(start), dtype=bool)
        for j in range(t.keys.shape[1]):
            bad |= offending(t.keys[:, j]) >= 0
        used = use[c.first + t.owner]
        blocks.append(features[used].astype(np.int32))
        labels.append((bad & (y[c.first + t.owner] == 1))[used])
        starts.append(start[used])
        toxic.append((y[c.first + t.owner] == 1)[used])
    if not sum(map(len, blocks)):
        return lookup, crf.train(np.zeros((0, 1), np.int64), np.zeros(0), np.zeros(0, bool), 3 * len(names))
    # all toxic texts and as many of the others, interleaved, up to a bound of tokens
    start = np.concatenate(starts)
    begin = np.flatnonzero(start)
    size = np.diff(np.append(begin, len(start)))
    toxic_seq = np.concatenate(toxic)[begin]
    rank = np.where(toxic_seq, np.cumsum(toxic_seq), np.cumsum(~toxic_seq)) * 2 + ~toxic_seq
    order = np.argsort(rank, kind="stable")
    order = order[rank[order] <= 2 * max(50, int(toxic_seq.sum())) + 1]
    order = order[np.cumsum(size[order]) - size[order] < MAX_TRAIN_TOKENS]
    pick = ranges(begin[order], size[order])
    return lookup, crf.train(np.concatenate(blocks)[pick], np.concatenate(labels)[pick], start[pick], 3 * len(names))


def train(texts: pa.Array, toxic: np.ndarray) -> ToxicityModel:
    """A model from a bounded sample, on the driver; deterministic.

    The layer learns from summaries of texts that the chain has not seen: of ``FOLDS``
    parts each is summarised by a chain of the others.
    """
    parts = [(c, _tokens(c)) for c in chunks(texts)]
    y = np.asarray(toxic, dtype=np.int64)
    keep, (doc, key) = _distinct_texts(parts, len(y)), _text_keys(parts)
    names, at = np.unique(key, return_inverse=True)
    del key
    named = (names, doc, at)
    summary, fold = np.zeros((len(y), 3)), np.arange(len(y)) % FOLDS
    for f in range(FOLDS):
        lookup, chain = _fit_chain(parts, y, fold != f, named, keep)
        for c, t in parts:
            mine = np.flatnonzero(fold[c.first : c.first + c.n] == f)
            summary[c.first + mine] = _summary(_tag(t, c.n, lookup, chain), t.owner, c.n)[mine]
    return ToxicityModel(*_fit_chain(parts, y, np.ones(len(y), dtype=bool), named, keep), _layer(summary, y))


def _layer(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return crf.logistic(x, y, l2=0.1) if len(y) else np.zeros(x.shape[1] + 1)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, take, max_rows: int, max_chars: int) -> pa.Table:
    """At most ``max_rows`` labelled texts of at most ``max_chars`` characters,
    by the smallest hash of the id.  ``take``: condition on the id column.

    Conflicting labels of one id: the larger counts.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("k"), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isNotNull() & F.col("k").isNotNull())
        .where(take(F.col("k")))
        .groupBy("k").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("k"), "k").limit(max_rows)
    )
    rows = (
        docs.select(F.col("doc_id").alias("d"), text_or_empty(F.col("text")).alias("t"))
        .where(F.length("t") <= max_chars)
        .join(F.broadcast(chosen), F.col("d") == F.col("k"))
        .groupBy("d", "t").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("d"), "d", "t").limit(max_rows)
    )
    return rows.select("t", "y").toArrow()


def fit(docs: DataFrame, labels: DataFrame, take, *, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> ToxicityModel:
    """Train on labelled rows for which ``take(doc_id)`` holds (a bounded sample)."""
    rows = training_rows(docs, labels, "toxic", take, max_rows, max_chars)
    model = train(rows["t"].combine_chunks(), rows["y"].to_numpy())
    del rows
    release()  # the driver works on
    return model


def score_texts(texts: pa.Array, model: ToxicityModel, spans_too: bool = False) -> tuple[np.ndarray, list | None]:
    """Score of every text and, if asked for, its tagged spans as code point offsets."""
    score, tagged = np.empty(len(texts)), [] if spans_too else None
    for c in chunks(texts):
        t = _tokens(c)
        p = _tag(t, c.n, model.lookup, model.chain)
        x = _summary(p, t.owner, c.n)
        score[c.first : c.first + c.n] = crf.sigmoid(x @ model.layer[:-1] + model.layer[-1])
        if spans_too:
            hit = np.flatnonzero(p >= TAG_AT)
            chars = code_points(c.data)
            base = chars[c.offsets[t.owner[hit]]]
            lo, hi = chars[t.starts[hit]] - base, chars[t.ends[hit]] - base
            cut = np.searchsorted(t.owner[hit], np.arange(c.n + 1))
            tagged += [list(zip(lo[a:b].tolist(), hi[a:b].tolist(), strict=True)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return score, tagged


def tag_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, toxicity, and the offending spans (code points, end exclusive) of every row."""
    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, toxicity double, spans array<struct<start:bigint,end:bigint>>"
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, tagged = score_texts(b.column("text"), model, True)
            rows = [[{"start": x, "end": y} for x, y in one] for one in tagged]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array(rows, type=span)], ["doc_id", "toxicity", "spans"])

    return source.mapInArrow(run, schema)


def held_out(doc_id):
    return F.coalesce(crc_mod(doc_id, 5) == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    tagged = tag_toxic(docs, model)
    return tagged.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
        "spans",
    )


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5, all their columns and rows.

    Null and empty texts have the score of a text without tokens, repeated rows the same one; a null id is kept
    or dropped by its text; a text of any length is read whole; an empty table stays empty.
    """
    model = fit(docs, table(spark, sf_dir, "labels"), lambda k: ~held_out(k))
    names = docs.columns
    schema = docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score, _ = score_texts(b.column(at), model)
            yield b.filter(pa.array(score < 0.5))

    return docs.mapInArrow(run, schema)
