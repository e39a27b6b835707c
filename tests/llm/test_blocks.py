"""Decontamination gives the same with one block of windows and with several, also for null and repeated ids."""

from quillspark.llm import decontamination
from tests.llm.test_edges import ITEMS, PASSAGE, ROWS, plain, table

MORE = [(9, PASSAGE, "de", "web", 9), (6, "clean words", "en", "web", 9), (None, "clean words", "en", "web", 9)]


def test_blocks_do_not_matter(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = table(spark, ROWS + MORE)
    cols = ("doc_id", "n_words", "n_hit", "items", "spans", "contaminated")
    one, many = (plain(decontamination.decontaminate(docs, items, max_windows=n), *cols) for n in (200_000, 3))
    assert len(one) == len(ROWS + MORE) and any(r[0] is None and r[-1] for r in one)
    assert many == one
    one, many = (plain(decontamination.uncontaminated(docs, items, max_windows=n), "doc_id", "text") for n in (200_000, 3))
    assert many == one and (None, "clean words") in one and (6, "clean words") in one
