"""Only the words of a line's prefix are put in words again, not all that were sorted."""

import random

from pyspark.sql import functions as F

from quarry.llm import linededup


def test_rarest_words_first(spark):
    rng = random.Random(2)
    rare = [rng.randrange(16) for _ in range(linededup.COUNTERS)]
    rows = [(rng.sample(range(-(1 << 31), 1 << 31), n), rng.randint(1, n)) for n in range(1, 60)]
    frame = spark.createDataFrame(rows, "shorts array<int>, most int")
    got = frame.select(linededup.by_rarity(F.col("shorts"), rare, F.col("most")).alias("p")).collect()
    for (words, most), r in zip(rows, got):
        assert r.p == sorted(words, key=lambda w: (rare[w % linededup.COUNTERS], w % (1 << 32)))[:most]
