"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import give_back, mapped, table

#: Features: n-grams of one to three characters, hashed to 2**BITS columns; one more is the constant.
BITS = 15
SIZE = 1 << BITS
UNKNOWN = "und"
_BLOCK = 1 << 20
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_SEED = (np.uint32(0x27D4EB2F), np.uint32(0x165667B1), np.uint32(0x2545F491))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a whole text's n-grams, lower-cased and padded with a blank, in blocks of bounded size."""
    total = np.zeros(SIZE, dtype=np.int64)
    text = f" {text.lower()} "
    for k in range(0, len(text), _BLOCK):
        c = np.frombuffer(text[k : k + _BLOCK + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        inner = min(_BLOCK, len(text) - k)
        code = np.zeros(len(c), dtype=np.uint32)
        for n in range(3):
            stop = len(c) - n
            if stop <= 0:
                break
            code = (code[:stop] * _MIX[1] + c[n:]) * _MIX[0]
            h = (code ^ code >> np.uint32(15)) * _MIX[2] + _SEED[n]
            total += np.bincount((h >> np.uint32(32 - BITS))[:inner], minlength=SIZE)
    on = np.flatnonzero(total)
    return on, total[on]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def vector(on: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length values (1 + ln tf) * idf of one text's columns."""
    x = (1 + np.log(count)) * idf[on]
    return x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    """Languages, document-frequency weights, sparse class weights (columns x languages) and temperature."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, on: np.ndarray, count: np.ndarray) -> np.ndarray:
        return vector(on, count, self.idf) @ self.weights[on] + self.weights[SIZE]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Most probable language and its calibrated probability; ('und', 0.0) without a letter or a model."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(*grams(text)) / self.temperature
        p = np.exp(z - z.max())
        k = int(np.argmax(z))
        return self.langs[k], float(p[k] / p.sum())


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, idf: np.ndarray, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 3) -> np.ndarray:
    """Follow-the-regularised-leader (proximal) with elastic-net penalties, for the softmax loss.

    Each column and class keeps a sum of adjusted gradients z and of squared
    gradients n; the weight is 0 while |z| is within l1. Rows come in a fixed
    shuffled order, so training is repeatable.
    """
    z, sq = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def weight(z: np.ndarray, sq: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(sq)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            on, count, y = rows[k]
            at, x = np.append(on, SIZE), np.append(vector(on, count, idf), 1.0)
            w = weight(z[at], sq[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(sq[at] + g * g) - np.sqrt(sq[at])) / alpha * w
            sq[at] += g * g
    return weight(z, sq)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on rows that training hasn't seen, by golden-section search."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        m = z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z - m).sum(axis=1)) + m[:, 0] - z[np.arange(len(y)), y])) + 1e-4 * t * t

    lo, hi, r = -4.0, 3.0, (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


_DF = pa.schema([("col", pa.int32()), ("n", pa.int64())])
_ROW = pa.schema([("id", pa.int64()), ("lang", pa.string()), ("tie", pa.int64()), ("on", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])
_PRED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64())])


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(SIZE + 1, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0):
            df[grams(text.as_py() or "")[0]] += 1
        df[SIZE] += batch.num_rows
    on = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(df[on])], schema=_DF)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [grams(t.as_py() or "") for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[k].astype(np.int32) for x in got], type=pa.list_(pa.int32())) for k in (0, 1))], schema=_ROW)


def fit(train: DataFrame, max_rows: int = 3000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", max_langs: int = 200) -> Model:
    """Learn from labelled rows (null labels and ids are left out).

    Document frequencies cover all of ``train``. The classifier itself is
    fitted on about ``max_rows`` rows, as many of each language as there are
    up to an equal share, chosen by hash of the id; a fifth of them sets the
    temperature. The driver holds those sparse rows, as flat arrays, and one
    number a column. Where the label column has more than ``max_langs``
    values, the most frequent ones (ties: the lesser name) are the languages,
    and rows with other labels teach nothing.
    """
    rows = train.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    langs = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    if not langs:
        return Model([], np.zeros(SIZE), np.zeros((SIZE + 1, 0)))
    df = np.zeros(SIZE + 1, dtype=np.int64)
    counted = rows.select("text").transform(mapped, _count_documents, "col int, n long").groupBy("col").agg(F.sum("n").alias("n")).toArrow()
    df[counted["col"].to_numpy()] = counted["n"].to_numpy()
    idf = np.log((1 + df[SIZE]) / (1 + df[:SIZE])) + 1
    share = max(1, max_rows // len(langs))
    chance = F.create_map(*[x for k, n in langs.items() for x in (F.lit(k), F.lit(min(1.0, share / n)))])[F.col("lang")]
    luck = F.pmod(F.xxhash64(F.col("id"), F.lit("language")), F.lit(1_000_000)) / 1e6
    names = sorted(langs)
    model = Model(names, idf, np.zeros((SIZE + 1, len(names))))
    _train(model, rows.where(luck < chance).select("id", "lang", F.xxhash64("text").alias("tie"), "text").transform(mapped, _vectors, "id long, lang string, tie long, on array<int>, n array<int>").toArrow())
    give_back()
    return model


def _train(model: Model, got: pa.Table) -> None:
    """Sets weights and temperature from the sampled rows, in order of id, label and text hash."""
    if not got.num_rows:
        return
    got = got.combine_chunks()
    on, n = (got[c].chunk(0) for c in ("on", "n"))
    at, on, n = on.offsets.to_numpy(), on.values.to_numpy(), n.values.to_numpy()
    y = np.searchsorted(np.array(model.langs, dtype=object), got["lang"].to_pylist())
    order = np.lexsort((got["tie"].to_numpy(), y, got["id"].to_numpy()))
    data = [(on[at[i] : at[i + 1]], n[at[i] : at[i + 1]], int(y[i])) for i in order.tolist() if at[i + 1] > at[i]]
    held = data[::5] if len(data) >= 10 else []
    model.weights = train_ftrl([r for i, r in enumerate(data) if not held or i % 5], len(model.langs), model.idf)
    model.temperature = calibrate(np.array([model.logits(o, c) for o, c, _ in held]), np.array([k for _, _, k in held]))


def _predictor(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            extra = [pa.array([x for x, _ in got], type=pa.string()), pa.array([x for _, x in got], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the text (last), ``lang_pred`` and ``score`` of every row of ``docs``; only the text decides."""
    d = docs.select(*keep, F.col(text_col))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields)
    return d.transform(mapped, _predictor(model), f"{schema}, lang_pred string, score double")


def held_out(id_col: Column) -> Column:
    """Whether the remainder of the id's CRC-32 by 4 is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[Column], max_rows: int = 3000) -> DataFrame:
    """Learn from the rows of ``docs`` that aren't held out, then predict all rows.

    Null texts and texts without a letter give 'und' with score 0, very long
    texts go in blocks, repeated rows are rows like any other; without a
    labelled row everything is 'und', and an empty table stays empty. Of equal
    scores the label first in code point order counts. The columns of
    ``keep`` come first and may have any names but lang_pred and score; other
    columns are not read.
    """
    return predict(docs, fit(docs.where(~held_out(F.col("doc_id"))), max_rows), keep)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
    return found.select("doc_id", "held_out", "lang_pred", "score")
