"""A new batch is judged by the index alone: nothing of earlier batches is read again."""

import random

import pytest
from conftest import words

from quoin.llm import op1_substring


@pytest.mark.parametrize("n", [36, 60, 300])
def test_passage_of_an_earlier_batch(spark, n):
    rng = random.Random(n)
    passage = words(rng, n)
    old = [f"{words(rng, 50)} {passage} {words(rng, 50)}", words(rng, 90)]
    new = [f"{words(rng, 45)} {passage} {words(rng, 45)}", words(rng, 80)]
    index = op1_substring.FingerprintIndex(spark)
    for texts in (old[:1], old[1:], new):
        index.ingest(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = {r.n_words: r.n_removed for r in index.repeats(spark.createDataFrame([(t,) for t in new], "text string")).collect()}
    assert got == {90 + n: n, 80: 0}
