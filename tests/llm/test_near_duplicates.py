"""What the near-duplicate stage moves: no text that meets nothing, and of large groups no set to blocks without a partner."""

import random

from pyspark.sql import functions as F

from kestrata.llm import _verify, ngram_join

from . import brute
from .test_operators import frame


def moved(spark):
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_that_meet_nothing_are_not_shuffled(spark, monkeypatch, tmp_path):
    rnd = random.Random(3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)  # as with very many documents
    rows = [(i, " ".join(f"{rnd.getrandbits(1600):0400x}" for _ in range(30)), "a") for i in range(1200)]
    rows += [(2000 + i, rows[i][1], "a") for i in range(5)] + [(2100, rows[7][1] + " more", "a"), (7, rows[7][1], "b"), (3000, None, "a"), (3000, None, "a"), (None, rows[9][1], "a")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents")
    docs = spark.read.parquet(f"{tmp_path}/documents")
    before = moved(spark)
    out = [(r.doc_id, r.text) for r in ngram_join.one_of_each(docs).select("doc_id", "text").collect()]
    assert sorted(out, key=str) == sorted([(i, t) for i, t, s in rows if not (i or 0) in range(2000, 2101) and s != "b"], key=str)
    assert moved(spark) - before < sum(len(t or "") for _, t, _ in rows)


def test_chains_of_lists_go_only_to_blocks_with_a_partner(spark, monkeypatch):
    rnd = random.Random(4)
    monkeypatch.setattr(_verify, "MEMBERS", 4)
    word = lambda: f"c{rnd.randrange(10**7)}"
    chain, w = [], [word() for _ in range(60)]
    for _ in range(160):  # each text is the one before, moved on by a few words
        chain.append(" ".join(w))
        w = w[2:] + [word(), word()]
    rows = [(i, t, "a") for i, t in enumerate(chain)]
    went = []
    whole = _verify.dealt
    monkeypatch.setattr(_verify, "dealt", lambda sets, groups: went.append(whole(sets, groups).cache()) or went[-1])
    out = {r.doc_id: r for r in ngram_join.linked_components(frame(spark, rows), k=3, num=90, den=100).collect()}
    sets = [brute.shingles(t.split(), 3) for t in chain]
    for i in range(len(chain)):
        assert out[i].n_links == sum(i != j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) for j in range(len(chain)))
        assert out[i].component_id == 0
    n, groups = went[0].count(), went[0].select(F.max("j")).first()[0] + 1
    assert groups > 20 and n < len(chain) * groups / 2
