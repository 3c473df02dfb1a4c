"""Copies of benchmark items that whole-alignment templates alone do not find."""

import pytest

from keepset.llm import templates
from tests.llm.test_operators import ITEM

APPLES = "Tom has 5 apples. He gives Anna 3 pears and keeps the rest of them."
SUGAR = "Add 5 kg, 7 kg and 9 kg of sugar"


@pytest.mark.parametrize(
    ("item", "text"),
    [
        (ITEM, ITEM.replace("14 kg", "25 kg")),  # thirteen tokens stand word for word
        (ITEM, ITEM.replace("3 dollars", "4 dollars").replace("14 more", "4 more")),
        (APPLES, APPLES.replace("Tom", "Maria").replace("5", "7")),  # a name that starts the only windows
        (APPLES, APPLES.lower()),
        (APPLES, APPLES.replace(".", "")),
        (SUGAR, f"First this: {SUGAR}, then stir."),
        ("one two three", "he said one two three four"),
    ],
)
def test_copies_are_found(spark, scratch, item, text):
    docs = spark.createDataFrame([(1, text), (2, "nothing of it stands in here at all, of no item and in no way")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = templates.matches(docs, items, scratch, whole=False).collect()
    assert [(r["doc_id"], r["item_id"]) for r in got] == [(1, 5)]
    assert templates.decontaminated(docs, items, scratch).select("doc_id").collect() == [(2,)]
