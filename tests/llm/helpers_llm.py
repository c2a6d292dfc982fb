"""Small tables for the tests."""

import random

from pyspark.sql import functions as F

#: Columns whose names the operators use inside.
CLASHING = "word key n part label size id host own foreign rep seq role nth start shard slot target taken toxicity base cell upto".split()


def text(seed, n, pool=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(pool)}" for _ in range(n))


def make(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(1) for c in CLASHING})
