import random

import pytest

from scholarlake.llm import blocks
from scholarlake.llm.lm import lm_scores
from scholarlake.llm.substring_dedup import substring_dedup
from scholarlake.llm.suffix_dedup import suffix_dedup


def copies():
    rng = random.Random(9)
    passages = [" ".join("".join(rng.choices("abcdef", k=4)) for _ in range(70)) for _ in range(4)]
    return [(i, " ".join(rng.sample(passages, rng.randint(0, 2))) + f" own{i} " + " ".join(rng.choices(["x", "y", "z"], k=10))) for i in range(30)]


@pytest.mark.parametrize("operator", [substring_dedup, suffix_dedup, lm_scores])
def test_plain_block_numbers_change_nothing(spark, monkeypatch, operator):
    docs = spark.createDataFrame(copies(), "doc_id long, text string")
    rows = lambda: sorted(str(r) for r in operator(docs).collect())
    even = rows()
    monkeypatch.setattr(blocks, "LITERAL_IDS", 2)
    assert rows() == even
