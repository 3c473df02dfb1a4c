"""Items in documents against a plain search."""

from keepset.plans.documents import contained


def test_items_are_found_wherever_they_start(spark):
    texts = ['say ("alpha beta gamma delta, end', "x [one] two", "é naïve. tab\tcafé au lait!", "é naïve. tab\tcafé au lait!", None, "", "Why  two  blanks here, in this longer text of words?", "a.b.c-d_e"]
    items = ["alpha beta gamma delta", "one", "café au lait", "é", None, "", " two  blanks", "here, in this longer text of wor", "b.c-", "in this longer", "not there at all", "a.b.c-d_e"]
    docs = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, passage string")
    want = sorted((i % 7, k, t.index(p) + 1) for i, t in enumerate(texts) for k, p in enumerate(items) if t and p and p in t)
    assert sorted((r["doc_id"], r["item_id"], r["at"]) for r in contained(docs, table).collect()) == want
    assert contained(docs, table.where("passage is null")).isEmpty() and contained(docs.limit(0), table).isEmpty()
