"""What the driver of the pipeline keeps and does."""

import pytest

from lodestone.llm import common, quality, toxicity
from lodestone.llm.components import components

from .conftest import prose


def test_stars_settle_in_one_round(spark):
    before = len(common._MADE)
    got = {x.id: x.label for x in components(spark.createDataFrame([(0, k) for k in range(1, 50)] + [(100, 101)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(50)} | {100: 100, 101: 100}
    assert len(common._MADE) - before == 2  # the edges, and those of one round


@pytest.mark.parametrize("module", [quality, toxicity])
def test_training_gives_the_drivers_memory_back(spark, module, monkeypatch):
    called = []
    monkeypatch.setattr(module, "give_back", lambda: called.append(1), raising=False)
    docs = spark.createDataFrame([(k, prose(k, 20), "en", "s", 100) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(20)], "doc_id long, quality int, toxic int")
    module.train(docs, labels)
    assert called
