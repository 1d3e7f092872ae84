"""Documents packed into fixed-length token sequences.

Token ids come from a public tokenizer.  ASCII white space separates what its
normaliser and pattern can see together, so each piece between white space is
encoded once per worker and remembered (a bounded cache); the ids are exactly
those of encoding the whole text.  Every document ends with an end id, is cut at
multiples of the sequence length, and the pieces of a randomised group of
documents are packed by first-fit decreasing, the first bin with room being
found in a tournament tree of bin capacities.

Edge cases: a null or empty text is the end id alone; repeated rows are packed
each for itself; ties in length keep the order of hash, id and start; an empty
table gives an empty result.  A null doc_id is kept; groups are drawn by id and text, so rows without id spread too.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import arrow_strings, table, text_or_empty
from .textnp import ranges

SEQUENCE = 2048
END_ID = 1
#: Documents of one packing group, on average.
GROUP_DOCS = 4096
TOKENIZER = "word_bpe_49k.json"
_ASCII = re.compile(rb"[A-Za-z]+")
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: Signs (no apostrophe) between a letter or digit and white space are a token run
#: of their own, so they may be set apart before the cache is asked.
_TAIL = re.compile(rb"(?<=[A-Za-z0-9])([!-&(-/:;=-@\[-`{-~]+)(?=[ \t-\r]|\Z)")
#: Pieces that a worker remembers (about 0.2 KB each).
_CACHE_WORDS = 400_000
_BLOCK = 1 << 21


def _alphabet() -> list[str]:
    """The byte alphabet of byte-level vocabularies: printable Latin-1 bytes are
    themselves, the others follow from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_ALPHABET = _alphabet()


class Encoder:
    """Ids of whole texts through a cache of their white-space separated pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        pending: list[bytes] = []

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                i = self[word] = len(self)
                pending.append(word)
                return i

        self.known, self.pending = Known(), pending
        self.ids, self.used = np.empty(1 << 16, dtype=np.uint32), 0
        self.at, self.size, self.n = np.empty(1 << 14, dtype=np.int64), np.empty(1 << 14, dtype=np.int64), 0

    def _learn(self) -> None:
        if not self.pending:
            return
        parts = [self._one(w) for w in self.pending]
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        flat = np.fromiter(itertools.chain.from_iterable(parts), dtype=np.uint32, count=int(sizes.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while self.n + len(sizes) > len(self.at):
            self.at, self.size = np.concatenate((self.at, np.empty_like(self.at))), np.concatenate((self.size, np.empty_like(self.size)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.at[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n : self.n + len(sizes)] = sizes
        self.used, self.n = self.used + len(flat), self.n + len(sizes)
        self.pending.clear()

    def _one(self, word: bytes) -> list[int]:
        """Ids of one piece.  A run of Latin-1 letters needs neither normaliser nor
        pattern: it is lower-cased, spelt in the vocabulary's byte alphabet, and merged."""
        if _ASCII.fullmatch(word):
            return [t.id for t in self.model.tokenize(word.decode().lower())]
        text = word.decode("utf-8", "replace")
        if _LATIN.fullmatch(text):
            return [t.id for t in self.model.tokenize("".join(map(_ALPHABET.__getitem__, text.lower().encode())))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _block(self, block: bytes) -> np.ndarray:
        if len(self.known) > _CACHE_WORDS:
            self._clear()
        # ASCII capitals are lower-cased by the normaliser too, unless a mark composes
        # with the letter (marks up to U+036F) or a special token may be spelt
        if b"<|" in block:
            words = block.split()
        elif b"\xcc" in block or b"\xcd" in block:
            words = _TAIL.sub(rb" \1", block).split()
        else:
            words = _TAIL.sub(rb" \1", block.lower()).split()
        which = np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))
        self._learn()
        return self.ids[ranges(self.at[which], self.size[which])]

    def __call__(self, text: bytes) -> np.ndarray:
        if len(text) <= _BLOCK:
            return self._block(text)
        out, i = [], 0
        while i < len(text):
            j = min(len(text), i + _BLOCK)
            if j < len(text):
                back = max(text.rfind(b" ", i, j), text.rfind(b"\n", i, j))
                if back > i:
                    j = back
                else:  # one piece longer than a block: up to the next white space
                    after = [k for k in (text.find(b" ", j), text.find(b"\n", j)) if k >= 0]
                    j = min(after, default=len(text))
            out.append(self._block(text[i:j]))
            i = j
        return np.concatenate(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Tournament:
    """Capacities of bins in a complete binary tree of their maxima."""

    def __init__(self, most_bins: int, capacity: int):
        self.leaves = 1 << max(0, (most_bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, which is taken there."""
        tree, i = self.tree, 1
        while i < self.leaves:
            i *= 2
            if tree[i] < size:
                i += 1
        tree[i] -= size
        bin_no = i - self.leaves
        i //= 2
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            best = a if a >= b else b
            if tree[i] == best:
                break
            tree[i] = best
            i //= 2
        return bin_no


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every size (each 1..capacity), larger ones first, ties in order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets, used = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), {}
    tree = Tournament(max(1, len(sizes)), capacity)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        b = tree.place(size)
        bins[i] = b
        offsets[i] = used.get(b, 0)
        used[b] = offsets[i] + size
    return bins, offsets


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of the cut documents, and ``draw``: a hash of id and text."""
    source = docs.select("doc_id", text_or_empty(F.col("text")).alias("text"))
    source = source.withColumn("draw", F.xxhash64("doc_id", "text", F.lit("pack")))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "draw", "start", "length", "ids_crc32", "doc_tokens"]
    schema = f"doc_id {kind}, draw bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            column = arrow_strings(b.column("text")).cast(pa.binary())
            row, start, length, crc, total = [], [], [], [], []
            for r in range(len(column)):
                ids = np.append(encode(column[r].as_buffer().to_pybytes()), np.uint32(END_ID)).astype("<u4")
                for s in range(0, len(ids), sequence):
                    part = ids[s : s + sequence]
                    row.append(r), start.append(s), length.append(len(part)), crc.append(zlib.crc32(part)), total.append(len(ids))
            ints = [pa.array(x, type=pa.int64()) for x in (start, length, crc, total)]
            rows = pa.array(row, type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), b.column("draw").take(rows), *ints], names)

    return source.mapInArrow(run, schema)


def pack(docs: DataFrame, *, tokenizer_path: str, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS, n_docs: int | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset.

    ``n_docs`` (counted if not given) only sets the number of groups.
    """
    groups = max(1, -(-(docs.count() if n_docs is None else n_docs) // group_docs))
    cut = pieces(docs, tokenizer_path, sequence).withColumn("pack_group", F.pmod("draw", F.lit(groups))).drop("draw")
    schema = cut.drop("pack_group").schema.simpleString()[len("struct<") : -1] + ",sequence_id:bigint,offset:bigint"

    def run(key: tuple, group: pa.Table) -> pa.Table:
        t = group.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(t["length"].to_numpy(), sequence)
        t = t.drop_columns(["pack_group"])
        return t.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    return cut.groupBy("pack_group").applyInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path(TOKENIZER))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, as ``op3_packing`` gives them.

    Null and empty texts are their end id; repeated rows are packed each for itself; a null id is
    kept; texts of any length are cut, never shortened; other columns are left out; an empty table has no piece.
    """
    return pack(docs, tokenizer_path=public_tokenizers.path(TOKENIZER))
