"""Operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrata.llm import decontam, mixing, ngram_join, paragraph_dedup, pii, ppm, sharding, suffix_dedup, topk, toxicity

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, stratum string, start long, key long, hi long, rank int, grp long, score double, __spans string, __items string, __score double, __reject boolean, row int, words long, part int, n int"


def frame(spark, rows, parts=3):
    """Documents with further columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), 1, 2, "x", 3, 4, 5, 6, 7, 0.5, "y", "z", 0.1, True, 8, 9, 10, 11) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def odd():
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "é"]
    base = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (3, 8, 12, 25, 60, 200)]
    rows = []
    for i in range(150):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice((0, 0, 1, 2, 6))):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        rows.append((i, " ".join(w), rnd.choice(("a", "a", "b", None))))
    rows += [(900, None, "a"), (901, "", "b"), (902, " \n\t", None), (903, "one", "a"), (904, "one two", "a"), (905, "ONE two", "b"), (906, "long " * 30_000, "a"), (907, "x" * 100_000, "b"), (908, None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, odd):
    return frame(spark, odd)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "a", "b")]).where("false")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_sharding(spark, docs, odd, empty):
    out = sharding.interleave(docs.unionByName(frame(spark, odd[:3])), 7).collect()
    again = sharding.interleave(docs.unionByName(frame(spark, odd[:3], 1)).repartition(2), 7).collect()
    assert sorted(out) == sorted(again)
    by = {s: sorted(r.slot for r in out if r.shard == s) for s in range(7)}
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(v == list(range(len(v))) for v in by.values()) and len(out) == len(odd) + 3
    text = {i: (t or "").encode() for i, t, _ in odd}
    assert all(r["size"] == len(text[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in out)
    source = {i: s for i, _, s in odd}
    for name in ("a", "b", None):
        n = [sum(source[r.doc_id] == name for r in out if r.shard == s) for s in range(7)]
        assert max(n) - min(n) <= 2
    assert sharding.interleave(empty, 7).collect() == []


def test_mixing(spark, docs, odd, empty):
    rows = docs.unionByName(frame(spark, odd[:2]))
    out = mixing.taken_words(rows).collect()
    assert sorted(out) == sorted(mixing.taken_words(rows.repartition(5)).collect()) and len(out) == len(odd) + 2
    every = odd + odd[:2]
    sizes = Counter()
    for _, t, s in every:
        sizes[s] += len(brute.words(t))
    target = brute.water_fill(dict(sizes))
    source = {i: s for i, _, s in odd}
    taken = Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK * 2 for s in sizes)
    mixed = mixing.mixed_documents(rows)
    assert mixed.columns == rows.columns
    got = Counter()
    for i, t in pairs(mixed):
        got[i] += len(brute.words(t))
    want = Counter()
    for r in out:
        want[r.doc_id] += r.taken
    assert +got == +want
    assert mixing.taken_words(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []


@pytest.mark.parametrize("shards", [1, 5])
def test_mixing_by_brute_force(spark, docs, odd, monkeypatch, shards):
    """Order, blocks, draws, slots and shards of the mix, one slot at a time."""
    monkeypatch.setattr(mixing, "BUCKET_BLOCKS", 3)
    out = {r.doc_id: r for r in mixing.taken_words(docs, seed=4, shards=shards).collect()}
    by_source = {}
    for i, t, s in odd:
        h = int(hashlib.md5(f"4:{i}:{zlib.crc32((t or '').encode())}".encode()).hexdigest()[:15], 16)
        by_source.setdefault("n" if s is None else "s" + s, []).append((h, i, len(brute.words(t))))
    sequence = {s: [i for _, i, n in sorted(rows) for _ in range(n)] for s, rows in by_source.items()}
    target = brute.water_fill({None if s == "n" else s[1:]: len(w) for s, w in sequence.items()})
    names = sorted(sequence)
    blocks = {s: -(-len(sequence[s]) // mixing.BLOCK) for s in names}
    quotas = np.array([min(3 * blocks[s], round(target[None if s == "n" else s[1:]] * blocks[s] / len(sequence[s]))) for s in names])
    counts = list(mixing.shard_counts(quotas, shards, 4))
    assert sum(counts).tolist() == quotas.tolist() and len({int(c.sum()) // 2 for c in counts}) <= 2
    want, at = {i: Counter() for i, _, _ in odd}, dict.fromkeys(names, 0)
    for shard, c in enumerate(counts):
        for s, n in zip(names, c.tolist(), strict=True):
            for k in range(at[s], at[s] + n):
                block = int(mixing.permuted(np.array([k % blocks[s]]), blocks[s], zlib.crc32(s.encode()) ^ 4)[0])
                for i in sequence[s][block * mixing.BLOCK : (block + 1) * mixing.BLOCK]:
                    want[i][shard] += 1
            at[s] += n
    assert {i: dict(r.by_shard) for i, r in out.items()} == {i: dict(w) for i, w in want.items()}
    assert all(r.taken == sum(want[i].values()) for i, r in out.items())


def test_targets_reshare_until_none_is_above(spark):
    for sizes in ({"a": 10, "b": 10, "c": 1000}, {"a": 1, "b": 1, "c": 1, None: 5}, {"a": 7}, {"a": 0, "b": 9, "é": 100, "z": 3, None: 50}):
        rows = spark.createDataFrame([("n" if s is None else "s" + s, n) for s, n in sizes.items()], "stratum string, source_size long")
        got = {None if r.stratum == "n" else r.stratum[1:]: r.target for r in mixing.targets(rows).collect()}
        assert got == pytest.approx(brute.water_fill(sizes))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (2, 60)])
def test_ngram_join(docs, odd, empty, k, num):
    out = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.linked_components(docs, k, num, 100).collect()}
    assert out == brute.components([(i, t) for i, t, _ in odd], k, num, 100)
    assert ngram_join.linked_components(empty, k, num, 100).collect() == []


def test_one_of_each_keeps_columns_and_clean_rows(spark, docs, odd, empty):
    rows = docs.unionByName(frame(spark, [odd[0], odd[0], (None, "no id here", "a")]))
    kept = ngram_join.one_of_each(rows)
    want = {i for i, (_, c, _) in brute.components([(i, t) for i, t, _ in odd], 5, 80, 100).items() if c == i}
    assert kept.columns == rows.columns and Counter(r.doc_id for r in kept.collect()) == Counter([*want, None])
    assert ngram_join.one_of_each(empty).collect() == []


def test_large_groups_are_compared_in_blocks(spark, monkeypatch, odd):
    from kestrata.llm import _verify

    monkeypatch.setattr(_verify, "MEMBERS", 5)
    rows = [(i, t) for i, t, _ in odd if len(t or "") < 5000]
    out = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.linked_components(frame(spark, [(i, t, "a") for i, t in rows]), 2, 60, 100).collect()}
    assert out == brute.components(rows, 2, 60, 100)


def test_light_boundary_follows_cost():
    assert ngram_join.boundary({}, 90, 100) == 0
    assert ngram_join.boundary({9: 1000}, 90, 100) >= 9  # one subset against several lists
    for s in range(1, 60):
        for t in ngram_join.partner_sizes(s, 90, 100):
            c = ngram_join.overlap(s, t, 90, 100)
            assert c * 100 >= 90 * (s + t - c) and (c - 1) * 100 < 90 * (s + t - c + 1)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 40)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(9).astype(np.float32)]) for i in range(150)]
    rows += [(i + 200, rows[i][1]) for i in range(30)]  # ties
    rows += [(500, None), (520, [1.0, None]), (540, [float("nan")] * 9), (560, [float("inf")] * 9), (None, rows[0][1]), (580, []), (600, [1.0, 2.0]), (20, rows[20][1])]
    frame_ = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, score int, node int").repartition(4)
    usable = [(i, x) for i, x in rows if i is not None and x is not None and all(v is not None and np.isfinite(v) for v in x)]
    want = best_products([(i, np.pad(np.floor(64 * np.array(x, np.float32).astype(float)), (0, 9 - len(x)))) for i, x in usable], 7)
    for nodes in (1, 2, 3):
        assert sorted(tuple(r) for r in topk.top_k(frame_, 7, 20, nodes).collect()) == want
    assert topk.top_k(frame_.where("false")).collect() == []


def best_products(rows, k):
    """query_id, rank, vec_id, score in Python's integers; each row with an id divisible by 20 asks all other rows."""
    ints = [(i, [int(v) for v in x]) for i, x in rows]
    want = []
    for a, (q, x) in enumerate(ints):
        if q % 20 == 0:
            best = sorted((-sum(u * v for u, v in zip(x, y, strict=True)), i) for b, (i, y) in enumerate(ints) if a != b)[:k]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(want)


@pytest.mark.parametrize(("scale", "shift"), [(1e6, 0.0), (3e6, 0.0), (1e6, -3.0), (4.0, 5.0)])
def test_top_k_is_exact_beyond_doubles_and_below_zero(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(topk, "ROWS", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "RANGE_BYTES", 6 * 8 * 6)
    rng = np.random.default_rng(8)
    # queries lie opposite the rest where there is a shift, so that all scores and cutoffs are negative
    m = (rng.standard_normal((150, 6)) + np.where(np.arange(150)[:, None] % 20 == 0, -shift, shift)) * scale
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(m)]
    want = best_products([(i, np.floor(64 * np.array(x))) for i, x in rows], 5)
    assert sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), 5).collect()) == want


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 60])
def test_decontamination(spark, docs, odd, empty, block, monkeypatch):
    rnd = random.Random(2)
    texts = [t for _, t, _ in odd if t and len(t.split()) > 20]
    items = [(i, " ".join(rnd.choice(texts).split()[j : j + n])) for i, (j, n) in enumerate([(0, 20), (3, 9), (5, 3), (2, 1), (0, 8)])] + [(0, "é w1 w2"), (None, "w3 w4"), (7, None), (8, " . ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam.located, "__defaults__", (iter, None, decontam.WINDOW, block))
    assert Counter(tuple(r) for r in decontam.digest(docs, bench).collect()) == brute.contamination([(i, t) for i, t, _ in odd], items)
    assert decontam.digest(empty, bench).collect() == []
    assert all(not r.n_items for r in decontam.digest(docs, bench.where("false")).collect())
    clean = decontam.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    hit = {k[0]: k[3] for k in brute.contamination([(i, t) for i, t, _ in odd], items)}
    kept = dict(pairs(clean))
    assert set(kept) == {i for i, n in hit.items() if n < 2}
    assert all(kept[i] == t for i, t, _ in odd if hit[i] == 0)


def test_pii_base_spans_and_digest(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("0123456789..@@+- ()ab%é") for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    assert all(pii.base_spans(t) == brute.personal(t) for t in texts)
    parts = ["mail bob.x@site.org", "call +49 (30) 123-4567", "host 10.0.0.7", "card 4111 1111 1111 1111", "order 4111111111111112", "v 1.2.3.999", "née à 12"]
    rows = [(i, " ".join(rnd.choice(parts) for _ in range(4)), "a") for i in range(200)] + [(900, None, "a"), (901, "", "a"), (902, "1" * 50_000, "a"), (903, "a" * 50_000 + "@", "a"), (3, texts[0], "b")]
    out = pii.digest(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        found = brute.personal(t)
        want[i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest(), *[sum(f[0] == k for f in found) for k in pii.KINDS]] += 1
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in out) == want
    by_text = {i: t for i, t, _ in rows if i != 3}
    for r in out:
        if r.doc_id != 3:
            assert {f"{k}:{a}:{b}" for k, a, b in brute.personal(by_text[r.doc_id])} <= set(r.spans.split(","))
    clean = dict(pairs(pii.redacted(frame(spark, rows[:50]), pii.Model())))
    assert all("@" not in t and "10.0.0.7" not in t for t in clean.values())
    assert pii.digest(frame(spark, rows).where("false")).collect() == []


def test_pii_adds_spans_that_the_base_misses(spark):
    """Precision and recall of each kind on plants in documents that training never saw."""
    rnd = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "s", "")]
    body = lambda: " ".join(rnd.choice(words) for _ in range(30))
    extra = ["mail bob.x@site.org", "call +49 (30) 123-4567", "host 10.0.0.7", "card 4111 1111 1111 1111", "order 4111111111111112", "v 1.2.3.999", "on 2024-05-17", "meet at dusk"]
    model = pii.train(frame(spark, [(i, f"{body()} {rnd.choice(extra)} {body()}", "a") for i in range(600)]))
    found, true, hit = Counter(), Counter(), Counter()
    for _ in range(1500):
        kind, hint, span, truth = pii.plant(rnd, words)
        left = body() + " " + hint
        base, every = pii.spans(f"{left}{span} {body()}", model)
        near = [s for s in every if s not in base and s[1] < len(left) + len(span) and s[2] > len(left)]
        if not base:
            true[kind] += truth
            hit[kind] += truth and bool(near)
        found[kind] += len(near)
        hit[kind, "wrong"] += bool(near) and not truth
    for kind in pii.EVERY:
        assert hit[kind] >= 0.6 * true[kind] > 20, (kind, hit, true)
        assert hit[kind, "wrong"] <= 0.1 * found[kind], (kind, hit, found)


def test_pii_prefilter_passes_every_candidate():
    rnd = random.Random(12)
    texts = ["reach me: john.doe at example.com today", "a[at]b(dot)cd", "x (at) y.zz"] + [pii.plant(rnd, ["word", "other"])[2] for _ in range(400)]
    may = pii._maybe(pa.array(texts))
    assert all(m for t, m in zip(texts, may, strict=True) if pii.candidates(t))


def test_paragraph_dedup(spark, empty):
    a, b = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet black white grey"
    near = a.replace("ten", "eleven") + " twelve"
    rows = [(1, a + "\n" + b, "x"), (2, b + "\nshort line", "x"), (3, "new " * 3 + "\n\n" + a, "x"), (4, None, "x"), (5, "", "x"), (6, near, "x"), (7, b, "x"), (7, b, "x"), (None, "alone here with eight words or even more", "x")]
    out = Counter((r.doc_id, r.n_paragraphs, r.n_removed, r.removed) for r in paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect())
    at = len("new new new \n\n")
    assert out == Counter({(1, 2, 0, ""): 1, (2, 2, 1, f"0:{len(b)}"): 1, (3, 2, 1, f"{at}:{at + len(a)}"): 1, (4, 0, 0, ""): 1, (5, 0, 0, ""): 1, (6, 1, 0, ""): 1, (7, 1, 1, f"0:{len(b)}"): 2, (None, 1, 0, ""): 1})
    assert paragraph_dedup.repeated_paragraphs(empty).collect() == []
    assert 1 - (1 - 0.8**2) ** paragraph_dedup.bands(0.8) >= paragraph_dedup.RECALL


def test_inner_passages_are_cut_alike(spark):
    rnd = random.Random(4)
    some = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    shared = some(200)
    out = {r.doc_id: r.removed_bytes for r in paragraph_dedup.repeated_paragraphs(frame(spark, [(1, f"{some(40)} {shared} {some(30)}", "x"), (2, f"{some(33)} {shared} {some(51)}", "x"), (3, some(300), "x")])).collect()}
    assert out[1] == out[3] == 0 and out[2] > len(shared) / 2


@pytest.mark.parametrize(("length", "group"), [(400, 8 << 20), (400, 2000), (100, 8 << 20)])
def test_suffix_dedup(spark, empty, length, group, monkeypatch):
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcdeé ") for _ in range(900)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = ""
        for _ in range(rnd.randint(0, 4)):
            b, x = rnd.choice(base), rnd.randint(0, 800)
            t += b[x : x + rnd.randint(1, 700)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 30)))
        rows.append((i, t, "s"))
    rows += [(i, t, "s") for i, t in [(500, None), (501, ""), (502, "a" * 399), (503, "a" * 400), (504, "a" * 401), (505, "b" * 3000), (506, "c" * 400), (None, base[0]), (None, None), (7, rows[7][1]), (508, "abcdefg" * 300)]]
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (400, 1 << 20, group))
    assert Counter(tuple(r) for r in suffix_dedup.dedup_digest(frame(spark, rows, 5), length).collect()) == brute.repeated_bytes([(i, t) for i, t, _ in rows], length)
    assert suffix_dedup.dedup_digest(empty).collect() == []


def _ppm_probability(counts, context, symbol):
    seen, p = set(), 1.0
    for k in range(ppm.ORDER, -1, -1):
        c = counts.get(tuple(context[len(context) - k :]) if k else (), {})
        if not c:
            continue
        left = {s: n for s, n in c.items() if s not in seen}
        if left:
            n, d = sum(left.values()), len(left)
            if symbol in left:
                return p * left[symbol] / (n + d)
            p *= d / (n + d)
        seen |= set(c)
    return p / (ppm.SYMBOLS - len(seen))


@pytest.mark.parametrize("sizes", [(ppm.PART_BYTES, ppm.SLICE_BYTES), (20, 9)])
def test_ppm(spark, sizes):
    texts = [(1, "abracadabra abra"), (2, "the cat é sat"), (3, "the the cat"), (16, "zqz the cat x"), (5, None), (6, ""), (1, "abracadabra abra"), (None, "the cat")]
    rows = frame(spark, [(i, t, "s") for i, t in texts])
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    symbols = lambda t: [0] * ppm.ORDER + [b + 1 for b in (t or "").encode()] + [ppm.END]
    counts, vocabulary = {}, Counter()
    for i, t in texts:
        if not held(i):
            s = symbols(t)
            for p in range(ppm.ORDER, len(s)):
                for k in range(ppm.ORDER + 1):
                    counts.setdefault(tuple(s[p - k : p]), Counter())[s[p]] += 1
            vocabulary.update([*brute.words(t), None])
    n, v = sum(vocabulary.values()), len(vocabulary)
    for context in ([1, 2, 117, 105, 102], symbols("the")[3:8]):
        assert sum(_ppm_probability(counts, context, s) for s in range(1, 258)) == pytest.approx(1)
    want = []
    for i, t in texts:
        w, s = [*brute.words(t), None], symbols(t)
        want.append((i, len(w), sum(x in vocabulary for x in w), n, sum(np.log10((vocabulary[x] + 1) / (n + v + 1)) for x in w), sum(np.log10(_ppm_probability(counts, s[p - ppm.ORDER : p], s[p])) for p in range(ppm.ORDER, len(s)))))
    out = [tuple(r) for r in ppm.scores(rows, ~ppm.held_out(F.col("doc_id")), *sizes).collect()]
    by = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(out, key=by), sorted(want, key=by), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4]) and a[5] == pytest.approx(b[5], rel=1e-5)
    assert ppm.scores(rows.where("false"), F.lit(True)).collect() == []
    assert all(np.isfinite(r.score) for r in ppm.scores(rows, F.lit(False)).collect())


def test_toxicity_finds_held_out_stems(spark):
    rnd = random.Random(9)
    some = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    rows, labels = [], []
    for i in range(900):
        bad = rnd.random() < 0.3
        t = some(rnd.randint(5, 120))
        if bad:
            w = t.split()
            for _ in range(3):
                w.insert(rnd.randrange(len(w)), rnd.choice(["Zorp!", "qux" + some(1), "klimt" + some(1)]))
            t = " ".join(w)
        rows.append((i, t, "s"))
        labels.append((i, int(bad), 1))
    rows += [(5000, None, "s"), (5001, "", "s"), (5002, "a " * 50_000 + "zorp", "s"), (7, rows[7][1], "s")]
    labels += [(5003, 1, 1), (None, 1, 1), (8, None, 1)]
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
    out = toxicity.toxicity_scores(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    truth = {i: y for i, y, _ in labels}
    test = [r for r in out if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in test) / len(test)
    assert right > 0.93
    kept = toxicity.without_toxic(docs, known)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    clean = [i for i, y, _ in labels[:900] if not y]
    assert sum(i in ids for i in clean) > 0.97 * len(clean) and {5000, 5001} <= ids
    assert all(r.score == 0 for r in toxicity.toxicity_scores(docs, known.where("false")).collect())
    assert toxicity.toxicity_scores(docs.where("false"), known).collect() == []
