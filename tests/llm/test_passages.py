"""Passages inside longer lines and edited lines, against their plain definition."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa

from kestrata.llm import paragraph_dedup
from kestrata.llm.paragraph_dedup import _not_first

from . import brute
from .test_operators import frame


def removed_words(rows, run):
    """(doc_id, word) of lines that near-copy an earlier one, and of runs of words that stand earlier in lines that stay."""
    lines = [(i, n, line.split()) for i, t in rows for n, line in enumerate(t.split("\n"))]
    long = [x for x in lines if len(x[2]) >= paragraph_dedup.MIN_WORDS]
    sets = [brute.shingles(w, 5) for _, _, w in long]
    u = brute.Union(range(len(long)))
    for x in range(len(long)):
        for y in range(x):
            if len(sets[x] & sets[y]) * 100 >= 80 * len(sets[x] | sets[y]):
                u.join(x, y)
    gone = {long[x][:2] for x in range(len(long)) if u.find(x) != x}
    out, seen, at = set(), set(), defaultdict(int)
    for i, n, w in lines:
        words = [(i, at[i] + j) for j in range(len(w))]
        at[i] += len(w)
        if (i, n) in gone:
            out.update(words)
            continue
        for j in range(len(w) - run + 1):
            g = tuple(w[j : j + run])
            if g in seen:
                out.update(words[j : j + run])
            seen.add(g)
    return out


def test_inline_passages_and_edited_lines_go_whole(spark):
    rnd = random.Random(6)
    some = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    passages = [some(n) for n in (24, 30, 40, 51, 51, 51, 60, 60, 100, 300)]
    edited = [some(n) for n in (30, 45, 60, 80, 120)]
    rows = []
    for i in range(120):
        lines = [some(rnd.randint(20, 60)) + rnd.choice(passages) + some(rnd.randint(0, 60))]
        if i % 3 == 0:
            line = list(rnd.choice(edited))
            line[rnd.randrange(len(line)) if len(line) > 50 else 1] = "edit"
            lines.append(line)
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    inner = some(40)
    rows.append((500, " ".join([*some(9), *inner, *some(9), *inner, *some(5)])))  # twice in one line
    rows.append((501, " ".join(["la"] * 3000)))
    want = removed_words(rows, paragraph_dedup.PASSAGE)
    out = {r.doc_id: r for r in paragraph_dedup.repeated_paragraphs(frame(spark, [(i, t, "x") for i, t in rows])).collect()}
    got = set()
    for i, t in rows:
        spans = [tuple(map(int, x.split(":"))) for x in out[i].removed.split(",") if x]
        assert out[i].n_removed == len(spans) and out[i].removed_bytes == sum(b - a for a, b in spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        pos = 0
        for j, w in enumerate(t.split()):
            pos = t.index(w, pos)
            if any(a <= pos and pos + len(w) <= b for a, b in spans):
                got.add((i, j))
            pos += len(w)
    assert want <= got
    assert len(got - want) < 0.03 * len(want)  # pieces that match at 0.8 hold some words of their own


def test_what_only_a_line_that_goes_holds_stays_elsewhere(spark):
    rnd = random.Random(7)
    some = lambda n: " ".join(f"v{rnd.randrange(10**6)}" for _ in range(n))
    head, tail, extra = some(150), some(150), some(40)
    rows = [(1, f"{head} {tail}", "x"), (2, f"{head} {extra} {tail}", "x"), (3, f"{some(30)} {extra} {some(30)}", "x")]
    out = {r.doc_id: (r.n_removed, r.removed_bytes) for r in paragraph_dedup.repeated_paragraphs(frame(spark, rows)).collect()}
    assert out == {1: (0, 0), 2: (1, len(rows[1][1])), 3: (0, 0)}


def test_first_places_of_a_chunk():
    rng = np.random.default_rng(1)
    for n in [0, 1, *range(2, 40)]:
        g, has = rng.integers(0, 5, n).astype(np.uint64), rng.integers(0, 2, n).astype(bool)
        place = has, np.where(has, rng.integers(0, 3, n), 0), rng.integers(-2, 2, n), rng.integers(0, 3, n)
        rows = list(zip(*(x.tolist() for x in place), strict=True))
        assert _not_first(g, *place).tolist() == [rows[i] != min(rows[j] for j in range(n) if g[j] == g[i]) for i in range(n)]


def test_overlapping_runs_known_to_go_are_one_row():
    import pyarrow as pa

    words = " ".join(f"p{n}" for n in range(60))
    texts = [words, "x " + words + " y", words + " " + words]
    wanted = pa.array([[{"b0": 0, "a": a} for a in _anchors_of(t)] for t in texts])
    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([11, 12, 13]), pa.array(texts), wanted], names=["doc_id", "th", "text", "wanted"])
    rows = [r for b in paragraph_dedup._wanted_runs(iter([batch])) for r in b.to_pylist()]
    gone = [(r["doc_id"], r["b0"], r["b1"]) for r in rows if r["later"]]
    # joints of the repeated words are no repeats
    assert sorted(gone) == [(2, 2, 2 + len(words)), (3, 0, len(words)), (3, len(words) + 1, 2 * len(words) + 1)]
    assert sum(r["doc_id"] == 1 for r in rows) == 60 - paragraph_dedup.PASSAGE + 1


def _anchors_of(text):
    import pyarrow as pa

    from kestrata.llm._text import chunks

    (c,) = chunks(pa.array([text]))
    return np.unique(paragraph_dedup._runs(c)[8]).view(np.int64).tolist()


def test_band_entries_meet_packed(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(paragraph_dedup, "BUCKET_ENTRIES", 50)  # several parts a bucket
    sig = rng.integers(0, 1 << 64, 300, np.uint64)[rng.integers(0, 300, 900)]
    hi = rng.integers(0, 400, 900).astype(np.uint64)
    rows = pa.Table.from_batches([paragraph_dedup._dealt(sig[lo : lo + 90], hi[lo : lo + 90], 3) for lo in range(0, 900, 90)])
    assert rows.num_rows == 80  # a row for each part and bucket
    rows = rows.sort_by([("bucket", "ascending")]).combine_chunks()
    u, want = brute.Union(range(400)), brute.Union(range(400))
    for b in paragraph_dedup._bucket_stars(rows.to_batches(max_chunksize=7)):
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            u.join(x, y)
    first = {}
    for s, h in zip(sig.tolist(), hi.tolist(), strict=True):
        want.join(first.setdefault(s, h), h)
    assert [u.find(x) for x in range(400)] == [want.find(x) for x in range(400)]


def test_sets_whose_sizes_forbid_a_link_are_not_compared(spark, monkeypatch):
    rnd = random.Random(8)
    some = lambda n: [f"v{rnd.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(60):
        words = some(22)  # lines of so many are not cut
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words[:14]))]  # 10 of 18 shingles: most meet in bands
        near = [*words[:14], "other"] if i % 3 == 0 else some(15)
        rows.append((3 * i + 2, " ".join(near)))
    compared = []
    links = paragraph_dedup.links

    def spied(sets, groups, *threshold):
        compared.extend(r.id for r in sets.collect())
        return links(sets, groups, *threshold)

    monkeypatch.setattr(paragraph_dedup, "links", spied)
    out = {r.doc_id: r for r in paragraph_dedup.repeated_paragraphs(frame(spark, [(i, t, "x") for i, t in rows])).collect()}
    assert 40 <= len(compared) <= 60  # of 20 texts, those of 14 and 15 words, and with them their group's of 22
    text = dict(rows)
    for i in range(60):
        assert (out[3 * i + 2].removed == f"0:{len(text[3 * i + 2])}") == (i % 3 == 0)


def test_large_groups_are_parted_by_tokens_that_links_share(spark, monkeypatch):
    from kestrata.llm import _verify

    monkeypatch.setattr(_verify, "MEMBERS", 8)
    rng = np.random.default_rng(4)

    def group(n):
        """Sets of one group that share five tokens, every fourth a near copy of the one before."""
        sets = []
        for i in range(n):
            own = rng.integers(100, 1 << 40, 15)
            if i % 4 == 3:
                own = np.append(sets[-1][5:-1], own[0])
            sets.append(np.concatenate([np.arange(5), own]))
        rows = [(7, i, 1, sorted({int(x) for x in s})) for i, s in enumerate(sets)] + [(8, n + i, 1, [1, 2, 3 + i // 2]) for i in range(4)]
        return spark.createDataFrame(rows, "grp long, id long, weight long, tokens array<long>")

    def linked(sets, groups):
        return {(min(r.a, r.b), max(r.a, r.b)) for r in _verify.links(sets, groups, 80, 100).collect() if r.a != r.b}

    made = []
    for n in (40, 400):
        sets = group(n).cache()
        groups = sets.select("grp")
        parts = _verify.narrowed(sets, groups, 80, 100)
        assert linked(*parts) == linked(sets, groups) == {(i - 1, i) for i in range(3, n, 4)} | {(n, n + 1), (n + 2, n + 3)}
        made.append(_verify.dealt(*parts).count())
    assert made[1] <= 12 * made[0]  # 20 000 rows of 400 sets without
