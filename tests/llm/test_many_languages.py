"""More labels than 64: all are learned."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language_id


def test_every_label_is_learned(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(90):
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)]
        rows += [(10 * k + j, " ".join(rng.choice(words, 40)), f"l{k:02}") for j in range(2 + k % 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = language_id.fit(docs, F.lit(True))
    assert len(model["langs"]) == 90
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()}
    assert all(got[d] == lang for d, _, lang in rows)


def test_loss_by_products():
    rng = np.random.default_rng(4)
    code = language_id.codewords(9)
    x, w = rng.normal(size=(20, 5)), rng.normal(size=(6, code.shape[1]))
    z = x @ w[:-1] + w[-1]
    loss = np.logaddexp(0.0, -z[:, None, :] * code[None]).sum(2)
    assert (language_id.decode(x, w, code)[0] == loss.argmin(1)).all()
