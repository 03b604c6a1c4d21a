"""Batch predictors: a model that is loaded once a worker scores or encodes columns of text.

The model is injected: ``make`` is called on a worker and returns a function from
a list of texts to one row of numbers each. Nothing here needs a network.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Predictor = Callable[[list[str]], np.ndarray]


def predicted(df: DataFrame, key: str, text: str, make: Callable[[], Predictor], name: str = "scores", batch: int = 32) -> DataFrame:
    """(key, ``name`` array<double>): the predictor's row of each text, asked for ``batch`` texts at a time.

    Null texts give null and are not shown to the model; a result of another
    length than its batch is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = None
        for b in batches:
            texts = b.column(text).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            if at and predict is None:
                predict = make()
            out: list[np.ndarray | None] = [None] * len(texts)
            for lo in range(0, len(at), batch):
                rows = np.asarray(predict([texts[i] for i in at[lo : lo + batch]]), np.float64)
                if len(rows) != len(at[lo : lo + batch]):
                    raise ValueError("the predictor must give one row a text")
                for i, r in zip(at[lo : lo + batch], rows, strict=True):
                    out[i] = r
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(out, pa.list_(pa.float64()))], [key, name])

    d = df.select(key, text)
    return d.mapInArrow(run, f"{key} {dict(d.dtypes)[key]}, {name} array<double>")


def best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class and confidence of rows of scores, by softmax."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p.argmax(1), p.max(1)
