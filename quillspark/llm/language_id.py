"""Language identification by error-correcting output codes.

Each language has a codeword of bits.  For each bit one binary classifier over
hashed byte n-grams predicts whether the text's language has that bit; decoding
adds up the logistic loss of every bit against each codeword and takes the
nearest word.  The gap to the runner-up flags ambiguity.

Fitting learns every label, from at most about `per_language` labelled texts of
each, chosen by a hash of doc_id; with more than 64 labels there are fewer of each,
but LEAST of each that has them.  What the driver receives grows with the number of
labels at most, never with the input.  Prediction reads whole
texts and nothing but the text.

Defined cases: a null text or one without a letter gets `und`, score 0 and is
ambiguous; with one learned language every other text gets it with score 1; with
none, `und`; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from quillspark.llm.common import rng_table, text_chunks

WIDTH = 2048
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = range(97, 123)
_FOLD[65:91] = range(97, 123)
_FOLD[128:] = range(128, 256)
_SALT = rng_table(11, 3) | np.uint64(1)
UNDETERMINED = "und"
#: A smaller gap in loss between the two nearest codewords is ambiguous.
DOUBT = 1.0
#: Texts of each language at least, however many languages there are.
LEAST = 20


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1; all splits for few languages, far-apart random words for many."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        rest = [set(c) for k in range(n) for c in combinations(range(1, n), k) if len(c) < n - 1]
        return np.array([[1.0 if i == 0 or i in s else -1.0 for s in rest] for i in range(n)])
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, gap = np.random.default_rng(seed), None, -1.0
    for _ in range(max(1, 200 * 64 // max(n, 64))):
        m = rng.choice([-1.0, 1.0], size=(n, bits))
        far = (bits - (m @ m.T) + 2 * bits * np.eye(n)).min() / 2
        if far > gap and np.all(np.abs(m.sum(0)) < n):
            best, gap = m, far
    return best


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square-rooted n-gram shares (2 and 3 bytes, folded) of each text, of unit length."""
    n = len(offsets) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if len(data):
        b = _FOLD[data].astype(np.uint32)
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
        pairs = b[:-1] * np.uint32(256) + b[1:]
        for k, grams in ((2, pairs), (3, pairs[:-1] * np.uint32(256) + b[2:] if len(b) > 2 else pairs[:0])):
            if not len(grams):
                continue
            bucket = (grams.astype(np.uint64) * _SALT[k - 1] >> np.uint64(53)).astype(np.int32)
            same = doc[: len(grams)] == doc[k - 1 :]
            at = doc[: len(grams)] * WIDTH + bucket
            out += np.bincount(at[same], minlength=n * WIDTH).reshape(n, WIDTH)
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def fit_bits(x: np.ndarray, code: np.ndarray, steps: int = 120, l2: float = 1e-5) -> np.ndarray:
    """Weights (and bias) of one logistic classifier per bit, fitted together."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((x1.shape[1], code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    target = code.astype(np.float32)
    for t in range(1, steps + 1):
        z = np.clip(target * (x1 @ w), -30, 30)
        g = x1.T @ (-target / (1 + np.exp(z))) / len(x1) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def decode(x: np.ndarray, w: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest codeword, its share of the belief, gap in loss to the next) of each row."""
    if len(code) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x)), np.full(len(x), np.inf)
    z = np.clip(x @ w[:-1] + w[-1], -15, 15).astype(np.float64)
    loss = np.logaddexp(0.0, -z) @ (code > 0).T + np.logaddexp(0.0, z) @ (code < 0).T
    belief = np.exp(-(loss - loss.min(1, keepdims=True)))
    belief /= belief.sum(1, keepdims=True)
    two = np.sort(loss, axis=1)[:, :2]
    return loss.argmin(1), belief.max(1), two[:, 1] - two[:, 0]


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(2)
        for chunk in text_chunks(batch):
            rows = features(chunk.data, chunk.offsets)
            names = lang.slice(chunk.rows[0], len(chunk))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array([r.astype(np.float16).tobytes() for r in rows], pa.binary())], ["lang", "x"]
            )


def fit(docs: DataFrame, train: Column, per_language: int = 400) -> dict:
    """A model from the rows where `train` holds and text and lang are known."""
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    counts = rows.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if len(langs) < 2:
        return {"langs": langs, "w": np.zeros((WIDTH + 1, 1), np.float32), "code": codewords(len(langs))}
    per = min(per_language, max(LEAST, 64 * per_language // len(langs)))
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per / r["count"])) for r in counts], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    got = rows.join(F.broadcast(shares), "lang").where(draw < F.col("share")).select(*rows.columns).mapInArrow(_featured, "lang string, x binary").collect()
    if not got:
        return {"langs": langs[:1], "w": np.zeros((WIDTH + 1, 1), np.float32), "code": codewords(1)}
    x = np.stack([np.frombuffer(r["x"], np.float16).astype(np.float32) for r in got])
    code = codewords(len(langs))
    at = {name: i for i, name in enumerate(langs)}
    return {"langs": langs, "w": fit_bits(x, code[[at[r["lang"]] for r in got]]), "code": code}


def identify(docs: DataFrame, model: dict, min_gap: float = DOUBT) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of `docs`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for chunk in text_chunks(batch):
                n = len(chunk)
                known = np.array([bool(_LETTER.search(chunk.raw(i).decode())) for i in range(n)], bool)
                known &= bool(m["langs"])
                if m["langs"]:
                    best, belief, gap = decode(features(chunk.data, chunk.offsets), m["w"], m["code"])
                else:
                    best, belief, gap = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.ids,
                        pa.array([m["langs"][b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], pa.string()),
                        pa.array(np.where(known, belief, 0.0), pa.float64()),
                        pa.array(~known | (gap < min_gap), pa.bool_()),
                    ],
                    ["doc_id", "lang_pred", "score", "ambiguous"],
                )

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, ambiguous boolean"
    )


def accepted(docs: DataFrame, model: dict, least_score: float = 0.5) -> DataFrame:
    """The rows of `docs` whose language the model can tell; those of no language or a doubtful one go.

    A row goes if it is `und`, or if it is ambiguous and scores below `least_score`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    # Only texts go to Python and only verdicts come back, so that a worker holds a batch of texts once.
    @F.arrow_udf(BooleanType())
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for text in texts:
            batch = pa.RecordBatch.from_arrays([text, text], ["doc_id", "text"])
            keep = [np.zeros(0, bool)]
            for chunk in text_chunks(batch):
                known = np.array([bool(_LETTER.search(chunk.raw(i).decode())) for i in range(len(chunk))], bool)
                if m["langs"]:
                    _, belief, gap = decode(features(chunk.data, chunk.offsets), m["w"], m["code"])
                    known &= (gap >= DOUBT) | (belief >= least_score)
                keep.append(known & bool(m["langs"]))
            yield pa.array(np.concatenate(keep), pa.bool_())

    plain = docs.withColumn("text", F.col("text").cast("string"))
    return plain.where(told("text"))
