"""Plug-in point for a sentence encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from talentloom.functions import text as T
from pyspark.sql import functions as F


def encode_texts(docs: DataFrame, doc_id: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(doc, embedding): unit-length vectors of non-blank texts.

    ``load`` runs once per Python worker and returns the encoder, a function from a list of texts to
    a matrix; texts reach it in Arrow batches.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = load()
        for batch in batches:
            vectors = np.asarray(encoder(batch[text].tolist()), dtype=np.float64)
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = vectors / np.where(norms == 0, 1.0, norms)
            yield pd.DataFrame({doc_id: batch[doc_id], "embedding": list(unit.astype(np.float32))})

    spoken = docs.filter(~T.is_blank(F.col(text))).select(doc_id, text)
    return spoken.mapInPandas(run, f"{doc_id} {id_type}, embedding array<float>")
