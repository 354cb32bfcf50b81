"""The url models count every labelled url, not a sample of them."""

import math
import random
from collections import Counter

from barloom.llm import urls
from pyspark.sql import functions as F


def test_op10_fits_on_all_labelled_urls(spark):
    r = random.Random(8)
    rows = [(f"{r.choice(x)}{r.choice('xyz')}{i:05d}", label) for label, x in (("allow", "aab"), ("block", "abb")) for i in range(7_000)]
    df = spark.createDataFrame(rows, "text string, label string")
    held = {x.text for x in df.where(F.pmod(F.xxhash64("text", F.lit(12)), F.lit(5)) == 0).collect()}
    counts = {label: Counter(c for t, k in rows if k == label and t not in held for c in t + "\x03") for label in ("allow", "block")}

    def p(c, label):
        n, kinds = sum(counts[label].values()), len(counts[label])
        return (counts[label][c] + kinds / 65536) / (n + kinds)

    score = lambda t: sum(math.log(p(c, "allow") / p(c, "block")) for c in t + "\x03") / (len(t) + 1)
    model = urls.fit(df, order=0)
    asked = ["ax00001", "bz31337", "?"]
    got = urls.judge(spark.createDataFrame([(t,) for t in asked], "text string"), model, "text").collect()
    assert all(math.isclose(x.score, score(x.text), rel_tol=1e-9, abs_tol=1e-12) for x in got)
    marks = sorted((score(t), k == "allow") for t, k in set(rows) if t in held)
    allow, block = sum(ok for _, ok in marks), sum(not ok for _, ok in marks)
    worth = lambda cut: sum(ok and s >= cut for s, ok in marks) / allow + sum(not ok and s < cut for s, ok in marks) / block
    assert math.isclose(worth(model.threshold), max(worth((a + b) / 2) for a, b in {(x[0], y[0]) for x, y in zip(marks, marks[1:], strict=False) if y[0] - x[0] > 1e-9}), rel_tol=1e-9)
