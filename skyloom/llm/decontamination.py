"""Benchmark decontamination by template canonicalisation.

Words are runs of letters, digits and non-ASCII characters; a number with signs
inside (1,200 or 3.5) is one word, and so is a run of names (Mary Ann).  A word that begins
with a digit becomes a number, a capitalised word inside a sentence a name, a unit word after
a number a unit; other words are lower-cased.  Windows of ``WINDOW`` canonical
words of texts and benchmark items are hash-joined; a window of fewer than
``LITERALS`` plain words is also sent with its words as they are, and one without any only so.  Matching windows on one diagonal of a text and an item are taken
together, and with those of diagonals at most ``MERGE`` away (words put in or left out) as
long as their slots agree: they must cover ``COVER`` of the item's words, and their slots must be
consistent (one value of the item always becomes the same value of the text).
Unless all values are the item's own, ``LEAST_PLAIN`` of the covered words and
``PLAIN_SHARE`` of them must be plain.
So a copy is found, and also the same question with other numbers, names or
units.

Texts are read once.  A bit table of fixed size made from the item windows keeps
other windows from being sent at all; what it lets through is joined exactly.

Edge cases: null and empty texts and items match nothing; an item of fewer words
than a window is matched as a whole, as it is unless three of them are plain;
repeated rows are one match; a null doc_id or item_id is kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import stored, table, text_or_empty
from .textnp import _Q, LOWER, WORDY, Chunk, chunks, mix, owners, span_hashes, spans

WINDOW = 8
LITERALS = 5
#: Plain words that a whole short item must have.
SHORT_LITERALS = 3
#: Plain words that a passage with other values must have, and their share of its words.
LEAST_PLAIN, PLAIN_SHARE = 3, 0.25
COVER = 0.6
#: Diagonals this near are one passage (words put in or left out at one place).
MERGE = 8
FILTER_BITS = 24

# Unit words that follow a number.
UNITS = """
mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons
ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years
percent degrees celsius fahrenheit kelvin dollar dollars cent cents euro euros usd eur gbp hz khz mhz ghz w kw mw v kv j kj cal kcal pa kpa bar mph kmh
""".split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F))

#: Signs inside a number, and between names of a run.
_SIGN, _BLANK = np.zeros((2, 256), bool)
_SIGN[[44, 46, 58]] = _BLANK[[9, 32, 39, 45]] = True


def _unit_hashes() -> np.ndarray:
    data = " ".join(UNITS).encode()
    flat = np.frombuffer(data, np.uint8)
    s, e = spans(flat, WORDY)
    return np.sort(span_hashes(flat, s, e))


_UNITS = _unit_hashes()


def _canonical(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical hash, own hash, whether a slot, and text of every word."""
    data, low = c.data, LOWER[c.data]
    s, e = spans(low, WORDY)
    if not len(s):
        z = np.zeros(0, np.uint64)
        return z, z, np.zeros(0, bool), np.zeros(0, np.int64)
    own = span_hashes(low, s, e)
    owner = owners(c, s)
    number = (data[s] >= 48) & (data[s] <= 57)
    upper = np.concatenate(([0], np.cumsum((data >= 65) & (data <= 90))))
    first = (data[s] >= 65) & (data[s] <= 90)
    plain_tail = upper[e] - upper[s] == 1
    # a sentence begins after a stop or at a line: look at the signs before the word
    stop = np.concatenate(([0], np.cumsum(np.isin(data, [10, 33, 46, 58, 63]))))
    before = np.concatenate(([0], e[:-1]))
    begins = (stop[s] > stop[before]) | np.concatenate(([True], owner[1:] != owner[:-1]))
    name = first & plain_tail & ~begins & ~number
    after_number = np.concatenate(([False], number[:-1] & (owner[1:] == owner[:-1])))
    at = np.minimum(np.searchsorted(_UNITS, own), len(_UNITS) - 1)
    unit = after_number & (_UNITS[at] == own)
    hashes = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, own)))
    # a number goes on after a single sign, a name after blanks, hyphens and apostrophes
    follows = np.flatnonzero((owner[1:] == owner[:-1]) & ((number[1:] & number[:-1]) | (name[1:] & name[:-1]))) + 1
    gap = s[follows] - e[follows - 1]
    joins = np.where(number[follows], (gap == 1) & _SIGN[data[s[follows] - 1]], True)
    for d in range(int(gap[~number[follows]].max(initial=0))):
        joins &= number[follows] | (gap <= d) | _BLANK[data[np.minimum(e[follows - 1] + d, s[follows] - 1)]]
    more = np.zeros(len(s), bool)
    more[follows[joins]] = True
    if more.any():
        first_of = np.flatnonzero(~more)
        rank = np.arange(len(s)) - np.repeat(first_of, np.diff(np.concatenate((first_of, [len(s)]))))
        own = np.add.reduceat(np.where(more, mix(own + rank.astype(np.uint64)), own), first_of)
        hashes, number, name, unit, owner = hashes[first_of], number[first_of], name[first_of], unit[first_of], owner[first_of]
    return hashes, own, number | name | unit, owner


def _windows(hashes: np.ndarray, own: np.ndarray, slot: np.ndarray, owner: np.ndarray, k: int, least: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, hash and whether taken as it is, of the windows of k words: by template from
    ``least`` plain words on, as they are below ``literals``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    h, exact = np.zeros(n, np.uint64), np.full(n, 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(_Q) + hashes[i : n + i]
        exact = exact * np.uint64(_Q) + own[i : n + i]
    plain = np.concatenate(([0], np.cumsum(~slot)))
    whole, plain = owner[:n] == owner[k - 1 :], plain[k:] - plain[:-k]
    a, b = np.flatnonzero(whole & (plain >= least)), np.flatnonzero(whole & (plain < literals))
    return np.concatenate((a, b)), mix(np.concatenate((h[a], exact[b])) + np.uint64(k)), np.arange(len(a) + len(b)) >= len(a)


def _rows(column: pa.Array, ids: pa.Array, lengths: list[int], bits: np.ndarray | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """Windows of a column of texts: id, window, at, size, n_words, slots, mask, verbatim.

    ``lengths``: window lengths wanted; ``whole``: of items, only their own length
    if shorter than a window; ``bits``: the filter of windows worth sending.
    """
    for c in chunks(column):
        hashes, own, slot, owner = _canonical(c)
        count = np.bincount(owner, minlength=c.n)
        begin = np.concatenate(([0], np.cumsum(count)))
        for k in lengths:
            at, h, verbatim = _windows(hashes, own, slot, owner, k, *((1, LITERALS) if k == WINDOW else (SHORT_LITERALS, SHORT_LITERALS)))
            if whole and k < WINDOW:
                keep = count[owner[at]] == k
                at, h, verbatim = at[keep], h[keep], verbatim[keep]
            if bits is not None:
                keep = bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                at, h, verbatim = at[keep], h[keep], verbatim[keep]
            if not len(at):
                continue
            text = owner[at]
            inside = slot[at[:, None] + np.arange(k)]
            values = own[at[:, None] + np.arange(k)][inside].view(np.int64)
            offsets = np.concatenate(([0], np.cumsum(inside.sum(axis=1)))).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            mask = (inside * (1 << np.arange(k))).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + c.first)), pa.array(h.view(np.int64)), pa.array(at - begin[text]), pa.array(np.full(len(at), k)), pa.array(count[text]), slots, pa.array(mask), pa.array(verbatim)], ["id", "window", "at", "size", "n_words", "slots", "mask", "verbatim"])


def _schema(kind: str) -> str:
    return f"id {kind}, window bigint, at bigint, size bigint, n_words bigint, slots array<bigint>, mask bigint, verbatim boolean"


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the benchmark items (columns item_id, text)."""
    source = items.select("item_id", text_or_empty(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(b.column("text"), b.column("item_id"), list(range(1, WINDOW + 1)), None, True)

    return source.mapInArrow(run, _schema(source.schema["item_id"].dataType.simpleString()))


def matches(docs: DataFrame, key: str, items: DataFrame) -> DataFrame:
    """key, item_id, cover, exact, of every contaminated text and item."""
    known = stored(item_windows(items), "item-windows")
    lengths = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most WINDOW
    bit = F.shiftrightunsigned(F.col("window"), 64 - FILTER_BITS).cast("int")
    bits = np.zeros(1 << FILTER_BITS, dtype=bool)
    bits[known.select(bit.alias("b")).distinct().toArrow()["b"].to_numpy()] = True  # at most 2 ** FILTER_BITS rows
    packed = np.packbits(bits).tobytes()
    source = docs.select(F.col(key).alias("key"), text_or_empty(F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool)
        for b in batches:
            yield from _rows(b.column("text"), b.column("key"), lengths, wanted, False)

    sent = source.mapInArrow(run, _schema(source.schema["key"].dataType.simpleString())).drop("mask").distinct()
    theirs = known.distinct().select("window", "size", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("n_words").alias("item_words"), F.col("slots").alias("item_slot"), "mask")
    hits = sent.select("window", "size", F.col("id").alias("key"), "at", F.col("slots").alias("text_slot"), "verbatim").join(theirs, ["window", "size"])
    # a window that matches as it is may be read otherwise at a sentence's begin: its values are the item's
    pairs = F.arrays_zip("item_slot", F.when(F.col("verbatim"), F.col("item_slot")).otherwise(F.col("text_slot")).alias("text_slot"))
    # a passage lies on diagonals within the length of its item: bands of twice that, half over each other
    hits = hits.select("key", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "size", F.col("item_words").alias("n_words"), "mask", pairs.alias("pairs"))
    low = F.floor(F.col("diagonal") / F.greatest("n_words", F.lit(MERGE)))
    same = F.forall("pairs", lambda p: p["item_slot"] == p["text_slot"])
    runs = hits.withColumn("same", same).groupBy("key", "item_id", "n_words", "diagonal").agg(F.collect_set(F.struct("item_at", "size", "mask", "same")).alias("seen"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    words = F.flatten(F.transform("seen", lambda w: F.transform(F.sequence(w["item_at"], w["item_at"] + w["size"] - 1), lambda i: F.struct(i.alias("at"), (F.getbit(w["mask"], (i - w["item_at"]).cast("int")) == 0).alias("plain"), w["same"].alias("same")))))
    runs = runs.select("key", "item_id", "n_words", "diagonal", low.alias("low"), "pairs", words.alias("words"))
    at = lambda test: F.array_distinct(F.transform(F.filter("words", test), lambda w: w["at"]))
    columns = {"places": at(lambda w: F.lit(True)), "plain": at(lambda w: w["plain"]), "kept": at(lambda w: w["same"]), "item_slot": F.col("pairs.item_slot"), "text_slot": F.col("pairs.text_slot")}
    runs = runs.withColumns(columns).select("key", "item_id", "n_words", F.explode(F.array("low", F.col("low") + 1)).alias("band"), F.struct("diagonal", *columns).alias("run"))
    bands = runs.groupBy("key", "item_id", "n_words", "band").agg(F.collect_list("run").alias("runs"))
    bands = bands.where(F.size(F.array_distinct(F.flatten("runs.places"))) / F.col("n_words") >= COVER)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):  # few rows as Python objects at once
            found = [_passage(runs, n) for runs, n in zip(b.column("runs").to_pylist(), b.column("n_words").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("item_id"), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.bool_())], ["key", "item_id", "cover", "exact"])

    kinds = {f.name: f.dataType.simpleString() for f in bands.schema.fields}
    judged = bands.select("key", "item_id", "n_words", "runs").mapInArrow(judge, f"key {kinds['key']}, item_id {kinds['item_id']}, cover double, exact boolean")
    return judged.where(F.col("cover") >= COVER).groupBy("key", "item_id").agg(F.max("cover").alias("cover"), F.max("exact").alias("exact"))


def _agree(known: dict, run: dict) -> dict | None:
    """``known`` values of slots with those of a diagonal; none if they contradict."""
    out = dict(known)
    for x, y in zip(run["item_slot"], run["text_slot"], strict=True):
        if out.setdefault(x, y) != y:
            return None
    return out


def _near(runs: list[dict]) -> Iterator[list[dict]]:
    """Runs in order of diagonals, parted where they lie more than ``MERGE`` apart."""
    group: list[dict] = []
    for r in runs:
        if group and r["diagonal"] - group[-1]["diagonal"] > MERGE:
            yield group
            group = []
        group.append(r)
    if group:
        yield group


def _passage(runs: list[dict], n_words: int) -> tuple[float, bool]:
    """Largest cover of neighbouring diagonals that agree, and whether one that covers enough is a copy.

    From every diagonal on, the nearest ones are added while their slots agree and
    they lie at most ``MERGE`` from one added before.
    """
    runs = sorted(runs, key=lambda r: r["diagonal"])
    best, exact = 0.0, False
    for group in _near([r for r in runs if r["kept"]]):  # what is verbatim agrees
        best = max(best, len({x for r in group for x in r["kept"]}) / n_words)
    for i, start in enumerate(runs):
        values = _agree({}, start)
        if values is None:
            continue
        places, plain = set(start["places"]), set(start["plain"])
        if len(places) / n_words >= COVER and all(x == y for x, y in values.items()):
            exact = True
        for side in (runs[i + 1 :], runs[:i][::-1]):
            at = start["diagonal"]
            for r in side:
                if abs(r["diagonal"] - at) > MERGE:
                    break
                if places.issuperset(r["places"]):
                    continue
                if (both := _agree(values, r)) is not None:
                    values, at = both, r["diagonal"]
                    places.update(r["places"])
                    plain.update(r["plain"])
        if all(x == y for x, y in values.items()) or (len(plain) >= LEAST_PLAIN and len(plain) >= PLAIN_SHARE * len(places)):
            best = max(best, len(places) / n_words)
        if best >= 1.0 and exact:
            break
    return best, exact


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, cover, exact of every contaminated document and item."""
    found = matches(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), "item_id", "cover", "exact")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark item is found; all columns and rows.

    A text decides for all rows that have it, whatever their ids (null ones too).  Null and empty texts
    stay, a text of any length is read whole, an empty table stays empty, and no column name is reserved.
    """
    key = "text_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("text"))
    bad = stored(matches(keyed, key, table(spark, sf_dir, "benchmark")).select(F.col("key").alias(key)).distinct(), "contaminated")
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
