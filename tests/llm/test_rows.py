"""Models, sharding, packing, wrappers, archives and the pipeline on small fixtures."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyloom.llm import crf, packing, quality, sharding, toxicity, warc, wrappers

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, shard string, y string"
ODD = [(1, None), (2, ""), (3, " \n\n"), (4, "é" * 50), (5, "x " * 40_000), (6, "same text"), (6, "same text"), (None, "no id"), (7, "A | B\n\nc!!")]


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def test_chain_equals_enumeration():
    rng = np.random.default_rng(0)
    score, start = rng.normal(size=9) * 2, np.array([1, 0, 0, 0, 1, 1, 0, 0, 0], bool)
    trans, init = rng.normal(size=(2, 2)), rng.normal(size=2)
    want, at = [], 0
    for n in (4, 1, 4):
        weight = {}
        for code in range(2**n):
            y = [code >> i & 1 for i in range(n)]
            s = init[y[0]] + sum(score[at + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n))
            weight[tuple(y)] = np.exp(s)
        total = sum(weight.values())
        want += [sum(w for y, w in weight.items() if y[i]) / total for i in range(n)]
        at += n
    assert np.allclose(crf.marginals(score, start, trans, init), want)


def test_chain_of_many_blocks_is_that_of_one():
    rng = np.random.default_rng(1)
    score, trans, init = rng.normal(size=700), rng.normal(size=(2, 2)), rng.normal(size=2)
    start = np.zeros(700, bool)
    start[[0, 130, 131]] = True
    p = crf.marginals(score, start, trans, init)
    parts = [crf.marginals(score[a:b], np.arange(b - a) == 0, trans, init) for a, b in ((0, 130), (130, 131), (131, 700))]
    assert np.allclose(p, np.concatenate(parts)) and not len(crf.marginals(score[:0], start[:0], trans, init))


def split(spark, label, module):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = module.fit(docs, labels, lambda k: ~module.held_out(k))
    return docs, labels, model


def auc(rows):
    good, bad = [r[0] for r in rows if r[1]], [r[0] for r in rows if not r[1]]
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_of_held_out_rows(spark):
    docs, labels, model = split(spark, "quality", quality)
    rows = quality.rate_quality(docs, model).withColumnRenamed("quality", "s").join(labels.withColumnRenamed("quality", "q"), "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    assert auc([(r.s, r.q) for r in rows]) > 0.97


def test_toxicity_of_held_out_rows(spark):
    docs, labels, model = split(spark, "toxic", toxicity)
    tagged = toxicity.tag_toxic(docs, model)
    rows = tagged.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("toxicity", "toxic").collect()
    assert auc([(r.toxicity, r.toxic) for r in rows]) > 0.75
    texts = {r.doc_id: r.text for r in docs.collect()}
    words = {texts[r.doc_id][s.start : s.end].lower() for r in tagged.where("size(spans) > 0").collect() for s in r.spans}
    assert {"idiot", "scum", "trash"} <= words and "the" not in words


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_recall_and_precision_of_held_out_rows(spark, module, label):
    """At the largest of the small scales; about one in twenty toxic labels there is of a text without any offending word."""
    query = {quality: quality.op1_quality, toxicity: toxicity.op10_toxicity}[module]
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").where(f"{label} is not null").select("doc_id", F.col(label).alias("y"))
    rows = query(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").select("predicted", "y").collect()
    hit = sum(r.predicted and r.y for r in rows)
    assert hit >= 0.9 * sum(r.y for r in rows) and hit >= 0.95 * sum(r.predicted for r in rows)


def plain_chain(score, trans, init):
    """P(state 1) of every step of one sequence by sums in plain floats."""
    e = [(1.0, float(np.exp(s))) for s in score]
    fore, back = [(np.exp(init[0]) * e[0][0], np.exp(init[1]) * e[0][1])], [(1.0, 1.0)]
    for x in e[1:]:
        v = [sum(fore[-1][i] * np.exp(trans[i][j]) for i in (0, 1)) * x[j] for j in (0, 1)]
        fore.append((v[0] / sum(v), v[1] / sum(v)))
    for x in e[:0:-1]:
        v = [sum(np.exp(trans[i][j]) * x[j] * back[-1][j] for j in (0, 1)) for i in (0, 1)]
        back.append((v[0] / sum(v), v[1] / sum(v)))
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(fore, back[::-1], strict=True)]


def test_toxicity_score_by_brute_force():
    """Words, beginnings, neighbours, marginals, summary and layer again, one token after the other."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["idiot", "scum", "fine", "day", "achlich" + rng.choice("abcd"), "gut", "x1", "été"]) for _ in range(40)) + " ".join(["", *["moron trash"] * (k % 2)]) for k in range(80)]
    model = toxicity.train(pa.array(texts), np.array([k % 2 for k in range(80)]))
    probe = [*texts[:6], "", "Scum of the IDIOT day", "achlichx achlichy", "9"]
    size, known = len(model.lookup.keys), dict(zip(model.lookup.keys.tolist(), model.lookup.ids.tolist(), strict=True))
    assert size
    for text, got in zip(probe, toxicity.score_texts(pa.array(probe), model)[0], strict=True):
        words = [w.encode() for w in re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))]
        own = []
        for w in words:
            flat = np.frombuffer(w, np.uint8)
            hashed = lambda n, flat=flat: toxicity.span_hashes(flat, np.array([0]), np.array([n]))
            keys = [(hashed(len(w)) ^ np.uint64(0))[0]]
            begins = [(hashed(p) ^ np.uint64(j + 1))[0] if len(w) >= p else np.uint64(0) for j, p in enumerate(toxicity.PREFIXES)]
            several = [p <= len(w) and len({v for v in words if v[:p] == w[:p] and len(v) >= p}) > 1 for p in toxicity.PREFIXES]
            keys += begins + [toxicity.mix(np.array([b]))[0] if s else np.uint64(0) for b, s in zip(begins, several, strict=True)]
            own.append([known.get(int(k), -1) if k else -1 for k in keys])
        weights = model.chain.weights
        score = []
        for k, ids in enumerate(own):
            x = model.chain.bias + sum(weights[i] for i in ids if i >= 0)
            if k and max(own[k - 1]) >= 0:
                x += weights[max(own[k - 1]) + size]
            if k + 1 < len(own) and max(own[k + 1]) >= 0:
                x += weights[max(own[k + 1]) + 2 * size]
            score.append(x)
        p = plain_chain(np.clip(score, -30, 30), model.chain.trans, model.chain.init) if score else []
        summary = [max(p), np.log1p(sum(p)), np.sqrt(sum(p) / len(p))] if p else [0, 0, 0]
        assert abs(1 / (1 + np.exp(-(np.dot(summary, model.layer[:3]) + model.layer[3]))) - got) < 1e-6


def test_quality_score_by_brute_force():
    """Neighbouring-line features, marginals, length weights and layer again, one line after the other."""
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["good words in a line.", "BAD!! BAD!!", "x | y | z", "", "1 2 3", "more good words here"]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    model = quality.train(pa.array(texts), np.array(["BAD" not in t for t in texts]).astype(int))
    width = quality.SLOTS * quality._BINS
    for text, got in zip(texts[:15], quality.score_texts(pa.array(texts[:15]), model)[0], strict=True):
        lines = text.split("\n")
        # the features of a line alone, but for earlier copies, which the text decides
        own = next(iter(quality.chunks(pa.array([text]))))
        mine = quality._lines(own).features[:, : quality.SLOTS]
        score = []
        for k in range(len(lines)):
            x = model.chain.bias + model.chain.weights[mine[k]].sum()
            if k:
                x += model.chain.weights[mine[k - 1] + width].sum()
            if k + 1 < len(lines):
                x += model.chain.weights[mine[k + 1] + 2 * width].sum()
            score.append(x)
        p = plain_chain(score, model.chain.trans, model.chain.init)
        size = [max(1, len(x.encode())) for x in lines]
        good = sum(a * b for a, b in zip(p, size, strict=True)) / sum(size)
        summary = [good, np.log((good + 0.01) / (1.01 - good)), max((1 - a) * b / sum(size) for a, b in zip(p, size, strict=True))]
        assert abs(1 / (1 + np.exp(-(np.dot(summary, model.layer[:3]) + model.layer[3]))) - got) < 1e-6


@pytest.mark.parametrize("module, n, rest", [(quality, 3, 1), (toxicity, 5, 0)])
def test_held_out_rows(spark, module, n, rest):
    ids = [*range(40), -7, 1 << 60, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", module.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r.doc_id: r.h for r in got} == {i: i is not None and zlib.crc32(str(i).encode()) % n == rest for i in ids}


def test_nothing_held_out_is_learnt_from(spark):
    """Labels of held-out rows change no score."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        turned = labels.withColumn(label, F.when(module.held_out(F.col("doc_id")), 1 - F.col(label)).otherwise(F.col(label)))
        texts = pa.array(["some words of a text.", "idiot scum trash", "AB!! CD!!"])
        one, two = (module.score_texts(texts, module.fit(docs, x, lambda k, module=module: ~module.held_out(k)))[0] for x in (labels, turned))
        assert np.array_equal(one, two)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_models_on_odd_rows(spark, module):
    docs = table(spark, ODD)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (4, 1, 0), (5, 0, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    run = {quality: quality.rate_quality, toxicity: toxicity.tag_toxic}[module]
    column = {quality: "quality", toxicity: "toxicity"}[module]
    for given in (labels, labels.limit(0)):
        model = module.fit(docs, given, lambda k: F.lit(True))
        got = run(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r[column] <= 1 for r in got)
        same = [r[column] for r in got if r.doc_id == 6]
        assert same[0] == same[1]
        assert run(docs.limit(0), model).count() == 0


def test_features_do_not_depend_on_neighbouring_texts():
    texts = pa.array(["A b.\nC!! | d", "", "x y z\n\nx y z", "idiot"])
    rng = np.random.default_rng(2)
    model = quality.train(pa.array(["good text here.\nand more", "BAD!! | x", "fine words", "###"] * 5), np.array([1, 0, 1, 0] * 5))
    whole = quality.score_texts(texts, model)[0]
    assert np.allclose(whole, [quality.score_texts(texts.slice(i, 1), model)[0][0] for i in range(4)])
    assert rng is not None


def check_shards(rows, got, shards):
    assert len(got) == len(rows)
    slots, bytes_in, of_text = collections.defaultdict(list), collections.Counter(), collections.defaultdict(set)
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(t or "")
    for r in got:
        t = next(t for t in texts[r.doc_id] if len(t.encode()) + 1 == r.size and zlib.crc32(t.encode()) == r.text_crc32)
        slots[r.shard].append(r.slot)
        bytes_in[r.shard] += r.size
        of_text[t].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in of_text.values())
    return bytes_in


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab é\n") for _ in range(rng.randrange(1, 300)))) for i in range(1500)]
    rows += [(2000 + i, "copy of one text") for i in range(100)]
    size = check_shards(rows, sharding.shard(table(spark, rows)).collect(), 16)
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(size.values()) < 1.03 * mean and min(size.values()) > 0.97 * mean


def test_odd_shards(spark):
    check_shards(ODD, sharding.shard(table(spark, ODD), 4).collect(), 4)
    assert sharding.shard(table(spark, [])).count() == 0
    same = [(i, "t") for i in range(50)]
    assert len({r.shard for r in sharding.shard(table(spark, same)).collect()}) == 1


def test_splits_by_brute_force(spark):
    """The shards of a plain recursion: widest dimension, exact weighted median, ties by hash."""
    rng = random.Random(9)
    rows = [(i, "\n".join(rng.choice(["ab", "é", "word ", "x" * 30]) * rng.randrange(1, 12) for _ in range(rng.randrange(1, 6)))) for i in range(300)]
    docs = table(spark, rows)
    points = sharding.points(docs).collect()
    whole = {d: max(p[d] for p in points) - min(p[d] for p in points) for d in sharding.DIMENSIONS}
    want = {}

    def split(members, first, k):
        if k == 1:
            want.update({p.doc_id: first for p in members})
            return
        spread = {d: max(p[d] for p in members) - min(p[d] for p in members) for d in sharding.DIMENSIONS}
        d = max(sharding.DIMENSIONS, key=lambda c: (spread[c] / whole[c], c))
        key = lambda p: (p[d], p.xh)
        weight = collections.Counter()
        for p in members:
            weight[key(p)] += p.size
        goal, before, left = sum(weight.values()) * (k // 2) / k, 0, set()
        for x in sorted(weight):
            if before + weight[x] >= goal:
                if goal - before >= before + weight[x] - goal:
                    left.add(x)
                break
            left.add(x)
            before += weight[x]
        split([p for p in members if key(p) in left], first, k // 2)
        split([p for p in members if key(p) not in left], first + k // 2, k - k // 2)

    split(points, 0, 8)
    assert {r.doc_id: r.shard for r in sharding.shard(docs, 8).collect()} == want


def test_slots_of_several_deals(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 7)
    rows = [(i % 90, "text " * (i % 13)) for i in range(200)] + [(None, "no id")] * 30
    got = sharding.shard(table(spark, rows), 4).collect()
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_rows(spark, at):
    """Nulls, empty and very long texts, ties, repeated rows, columns of clashing names, and no rows at all."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[at]
    schema = "doc_id long, text string, score string, text_key string, __text_key string, draw string, n int, component_id long"
    rows = [(*r, "a", "b", "c", "d", 1, 2) for r in [*ODD, (None, "no id"), (8, "A plain text of several words that nobody would object to, and one more sentence.")]]
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, DATA)
    got = out.collect()
    if name == "packing":
        total = {(r.doc_id, r.doc_tokens) for r in got}
        assert {i for i, _ in total} == {r[0] for r in rows} and (1, 1) in total and (2, 1) in total
    else:
        assert out.columns == docs.columns and {tuple(r) for r in got} <= {tuple(r) for r in docs.collect()}
        kept = collections.Counter((r.doc_id, r.text) for r in got)
        given = collections.Counter(r[:2] for r in rows)
        once = name == "near_duplicates"
        assert all(n == (1 if once and k[0] is not None else given[k]) for k, n in kept.items())
        if name in ("near_duplicates", "decontamination"):
            assert set(kept) == set(given)
    empty = stage(spark, docs.limit(0), DATA)
    assert empty.count() == 0


def test_first_fit_decreasing_by_brute_force():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for i in np.argsort(-sizes, kind="stable"):
            b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[int(i)] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert want == {i: (int(bins[i]), int(offsets[i])) for i in range(n)}


def test_packed_ids(spark):
    path = public_tokenizers.path(packing.TOKENIZER)
    tok = Tokenizer.from_file(path)
    rows = [*ODD, (10, "It's <|endoftext|> KELVIN K, naïve é... \x1c 5.!? 　")]
    got = packing.pack(table(spark, rows), tokenizer_path=path, sequence=64, group_docs=3).collect()
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4"))
    seen, where = collections.Counter(), collections.defaultdict(list)
    for r in got:
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes()) and 1 <= r.length <= 64
        seen[r.doc_id] += r.length
        where[r.sequence_id].append((r.offset, r.length))
    assert seen == {i: sum(map(len, x)) for i, x in ids.items()}
    for parts in where.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(table(spark, []), tokenizer_path=path).count() == 0


def test_encoder_in_blocks(monkeypatch):
    monkeypatch.setattr(packing, "_BLOCK", 50)
    monkeypatch.setattr(packing, "_CACHE_WORDS", 5)
    path = public_tokenizers.path(packing.TOKENIZER)
    encode, tok = packing.Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    for _ in range(100):
        text = "".join(rng.choice(["a", "Ré", "'s", " ", "\n", "12", "..", "x" * 70]) for _ in range(rng.randrange(60)))
        assert encode(text.encode()).tolist() == tok.encode(text, add_special_tokens=False).ids


PAGE = '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><div class="ad">buy</div><article><h1>{h}</h1>{body}</article><footer>f {h}</footer></body></html>'


def test_main_text(spark):
    rows, want = [], {}
    for i in range(60):
        nav = "".join(f"<li><a href='/{k}'>n{k}</a></li>" for k in range(i % 5))
        body = "".join(f"<p>para  {k} &amp; <b>bo</b>ld {i}</p>" if k % 2 else f"<p>open {k}.<br>" for k in range(i % 7))
        rows.append((i, f"http://h{i % 2}.example/x", PAGE.format(nav=nav, h=f"Head {i}", body=body)))
        want[i] = " ".join([f"Head {i}", *[f"para {k} & bold {i}" if k % 2 else f"open {k}." for k in range(i % 7)]])
    plain = "http://h9.example/"
    for i in range(60, 70):
        rows.append((i, plain, f'<body><div class="sidebar">s</div><div class="cookie-notice">c</div><div>Site name</div><div id="content"><p>Body {i}</p><form>q</form></div><div class="comments"><p>boo</p></div>'))
        want[i] = f"Body {i}"
    rows += [(70, None, None), (71, "", ""), (72, "x", "just &lt;text&gt;"), (72, "x", "just &lt;text&gt;")]
    want |= {70: "", 71: "", 72: "just <text>"}
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = wrappers.extract(pages, wrappers.infer_wrappers(pages)).collect()
    assert len(got) == len(rows)
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert wrappers.extract(pages.limit(0), wrappers.infer_wrappers(pages.limit(0))).count() == 0


def test_alignment():
    one, two = wrappers.collapse(list("abbbc")), wrappers.collapse(list("axbc"))
    assert wrappers.expression(one) == "(<a>#) (<b>#)+ (<c>#)"
    assert wrappers.expression(wrappers.align(one, two)) == "(<a>#) (<b>#)+ (<x>#)? (<b>#)? (<c>#)" or "(<x>#)?" in wrappers.expression(wrappers.align(one, two))
    assert wrappers.expression(wrappers.collapse(list("abab"))) == "(<a># <b>#)+"


def test_pages_are_matched_against_the_wrapper(spark):
    rows = [(i, "http://a.example/", f"<body><div>Motto</div><article><div>Share it</div><h2>Summary</h2><h1>Head {i}</h1>{f'<ul><li>x{i}</li></ul>' * (i % 2)}<p>Body {i}</p><p>more</p></article></body>") for i in range(8)]
    rows += [(i, "http://b.example/", f"<body><div>Motto</div><h1>Head {i}</h1><div>Body {i}</div></body>") for i in range(8, 16)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer_wrappers(pages)).collect()}
    assert got == {i: f"Head {i}{f' x{i}' * (i % 2)} Body {i} more" if i < 8 else f"Head {i} Body {i}" for i in range(16)}


@pytest.mark.parametrize("copies", [4, 5, 9])
def test_copies_of_a_page_are_one_page(spark, copies):
    one = "<body><nav>{}</nav><table><tr><td>Own text of this page</td></tr></table></body>"
    rows = [(i, f"http://c.example/{i}", one.format(i)) for i in range(copies)]
    rows += [(100 + i, f"http://c.example/p{i}", f"<body><div>Motto</div><p>Body {i}</p></body>") for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer_wrappers(pages)).collect()}
    assert got == {i: "Own text of this page" for i in range(copies)} | {100 + i: f"Body {i}" for i in range(6)}


def main_texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in wrappers.extract(pages, wrappers.infer_wrappers(pages)).collect()}


def test_the_wrapper_of_the_host_decides(spark):
    """One page on two hosts: where the others of a host have the same note it is template."""
    page = "<body><div>Free delivery this week</div><p>The heron stood in the shallow water and waited for the morning to begin</p></body>"
    rows = [(0, "http://one.example/", page), (1, "http://two.example/", page)]
    bodies = ["A ship came into the harbour with grain from the south coast", "Nobody had seen the old miller since the first snow of that winter", "Seven bridges cross the river between the castle and the sea"]
    rows += [(10 + i, "http://one.example/", f"<body><div>Free delivery this week</div><p>{b}</p></body>") for i, b in enumerate(bodies)]
    rows += [(20 + i, "http://two.example/", f"<body><div>{b.upper()}</div><p>{b}</p></body>") for i, b in enumerate(bodies)]
    got = main_texts(spark, rows)
    story = "The heron stood in the shallow water and waited for the morning to begin"
    assert got[0] == story and got[1] == f"Free delivery this week {story}"


def test_a_repeated_group_of_links_is_a_menu(spark):
    """No names of classes or telling elements: the wrapper's repeated group of links is no text, other groups are."""
    rows, want = [], {}
    for i in range(6):
        menu = "".join(f"<div><a href='/{k}'>Place {i} {k}</a></div>" for k in range(3 + i % 3))
        body = "".join(f"<section>Part {k} of the story {i} has <a href='/x'>a link</a> inside</section>" for k in range(2 + i % 2))
        rows.append((i, "http://plain.example/", f"<body><table><tr><td>{menu}</td><td>{body}</td></tr></table></body>"))
        want[i] = " ".join(f"Part {k} of the story {i} has a link inside" for k in range(2 + i % 2))
    assert main_texts(spark, rows) == want


def test_near_copies_are_no_evidence(spark):
    """A heading that only copies and near copies of one page share stays."""
    words = [f"word{k}" for k in range(120)]
    rows = [(i, "http://c.example/", f"<body><h1>One heading here</h1><p>{' '.join([*words[:20 * i], f'changed{i}', *words[20 * i + 1 :]])}</p></body>") for i in range(5)]
    assert all(text.startswith("One heading here word" if i else "One heading here changed0") for i, text in main_texts(spark, rows).items())


def test_attributes_and_nesting():
    assert wrappers.page_text("<article><p title=it's>one</p><p>two</p><p>it's three</p></article>", None, frozenset()) == "one two it's three"
    assert wrappers.page_text("<article><div class=site-ad-free>a</div><div class=alert-level>b</div><p data-class=ad>c</p><div class='ad-slot'>no</div><div id='x menu'>no</div></article>", None, frozenset()) == "a b c"
    assert wrappers.page_text("<p title='a > b' x=\"<i>\">one</p>two", None, frozenset()) == "one two"
    deep = wrappers.slots("<div>x" * 3000 + "</b></p></section>" * 3000 + "y")
    assert len(deep) == 3001 and len({s[0] for s in deep}) == 3000


def test_repetitions_of_any_length():
    assert wrappers.expression(wrappers.collapse(list("x" + "abcdefghijklm" * 3 + "y"))) == "(<x>#) (" + " ".join(f"<{c}>#" for c in "abcdefghijklm") + ")+ (<y>#)"
    for seed in range(30):  # every slot keeps its place
        rng = random.Random(seed)
        stream = [rng.choice("ab") for _ in range(rng.randrange(1, 40))]
        seen = [(at, name) for unit, _, _, where in wrappers.placed(stream) for name, places in zip(unit, where, strict=True) for at in places]
        assert sorted(seen) == list(enumerate(stream))


def test_places_in_a_wrapper():
    match = wrappers.Matcher(wrappers.merge_streams([wrappers.json.dumps(wrappers.collapse(list(s))) for s in ("abbc", "axbc", "abxyxyc")]))
    for s in ("abbc", "axbc", "abxyxyc"):
        at = match(tuple(s))
        assert all(match.wrapper[int(p.split(":")[0])][0][int(p.split(":")[1])] == c for p, c in zip(at, s, strict=True))
        assert at[0] == "0:0" and at[-1] == f"{len(match.wrapper) - 1}:0"
    assert match(tuple("zz")) == [None, None]


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    rng = random.Random(6)
    rows = [(i, f"http://x/{i}", rng.choice(["same", "", "é" * 900, None, f"own {i}"])) for i in range(80)] + [(3, "http://x/3", "same"), (200, "a\r\nb", "last"), (None, None, "nobody")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    folder = f"file://{tmp_path}/w"
    index = warc.write_archives(warc.mark_revisits(pages), folder).cache()
    index.count()
    got = warc.read_archives(index, folder).collect()
    keeper = {}
    for i, _, h in rows:
        keeper[h or ""] = max(keeper.get(h or "", -1), -1 if i is None else i)
    texts = collections.defaultdict(set)
    for i, _, h in rows:
        texts[i].add(h or "")
    assert len(got) == len(rows)
    for r in got:
        match = [t for t in texts[r.page_id] if base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() == r.payload_digest]
        assert len(match) == 1 and r.payload_bytes == len(match[0].encode())
        k = keeper[match[0]]
        assert (r.record_type, r.refers_to) == (("response", None) if k in (r.page_id, -1) else ("revisit", k))
        if r.record_type == "response":
            assert bytes(r.payload).decode() == match[0]
    entry = index.where("record_id = 'urn:page:200'").first()
    fields, block = warc.read_record(entry, folder)
    assert fields["warc-target-uri"] == "a%0D%0Ab" and block.endswith(b"\r\n\r\nlast")
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.limit(0)), folder), folder).count() == 0


def test_pipeline_follows_its_stages(spark):
    import corpus_pipeline as p
    from skyloom.llm import decontamination, jaccard

    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    tox = toxicity.tag_toxic(docs, toxicity.fit(docs, labels, lambda k: ~toxicity.held_out(k)))
    ids = {r.doc_id for r in tox.where("toxicity < 0.5").collect()}
    left = docs.where(F.col("doc_id").isin(*ids))
    good = quality.rate_quality(left, quality.fit(left, labels, lambda k: ~quality.held_out(k)))
    ids = {r.doc_id for r in good.where("quality >= 0.5").collect()}
    left = docs.where(F.col("doc_id").isin(*ids))
    ids = {r.component_id for r in jaccard.similar_components(left).collect()}
    left = docs.where(F.col("doc_id").isin(*ids))
    bad = {r.key for r in decontamination.matches(left, "doc_id", spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    got = p.run(spark, DATA)
    assert {r.doc_id for r in got.collect()} == ids - bad
    assert 4 <= len(p.STAGES) <= 5 and got.columns[:3] == ["doc_id", "start", "length"]


@pytest.mark.parametrize("model", [toxicity, quality])
def test_training_gives_the_drivers_memory_back(monkeypatch, model):
    done = []
    monkeypatch.setattr(model, "training_rows", lambda *a: pa.table({"t": ["a"], "y": [1]}))
    monkeypatch.setattr(model, "train", lambda *a: done.append("train"))
    monkeypatch.setattr(model, "release", lambda: done.append("release"))
    model.fit(None, None, None)
    assert done == ["train", "release"]
