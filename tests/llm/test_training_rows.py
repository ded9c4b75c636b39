"""The classifier learns from every labelled row that is not held out, and from whole texts."""

import random
import zlib

from pyspark.sql import functions as F

from kestrata.llm import toxicity

from .test_operators import frame


def test_words_of_any_row_are_learnt(spark):
    rnd = random.Random(8)
    ids = [i for i in range(16_000) if zlib.crc32(str(i).encode()) % 4 != 2][:11_000]
    by_hash = [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64(F.lit(5), "i")).collect()]
    late, long = set(by_hash[9_000:][:150]), set(by_hash[:60])
    rows, labels = [], []
    for i in ids:
        words = [f"w{rnd.randrange(300)}" for _ in range(8)]
        bad = i in late or i in long or rnd.random() < 0.05
        if i in long:
            words = ["boomboom"] * 4000
        elif bad:
            words[rnd.randrange(len(words))] = "zapzap" if i in late else "badbad"
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(bad)))
    assert min(len(t) for i, t, _ in rows if i in long) > 32_000
    new = [(100_000 + n, " ".join(f"w{rnd.randrange(300)}" for _ in range(7)) + w, "a") for n, w in enumerate([" zapzap"] * 20 + [" boomboom"] * 20 + [" badbad"] * 20 + [""] * 60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").createOrReplaceTempView("training_labels")
    model = toxicity.train(frame(spark, rows), spark.table("training_labels"))
    again = toxicity.train(frame(spark, rows, 5), spark.table("training_labels"))
    out = {r.doc_id: r.score for r in toxicity.scored(frame(spark, new), model).select("row.doc_id", "score").collect()}
    hits = [sum(out[100_000 + n] >= 0.3 for n in range(lo, hi)) for lo, hi in ((0, 20), (20, 40), (40, 60), (60, 120))]
    assert min(hits[:3]) >= 16 and hits[3] <= 4, hits
    assert (model.table == again.table).all() and model.thresholds == again.thresholds
