"""Fits as pyspark.ml estimators, a weighting transformer, and functions of whole groups of a checked size."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tokens import class_tfidf
from .counts import fit_poisson
from .joint import fit_joint, fit_two_stage
from .packed import Packed
from .stance import fit_stance, fit_stance_ridge

FITS: dict[str, Callable[[Packed], Packed]] = {
    "stance": lambda p: fit_stance(p).packed,
    "ridge": lambda p: fit_stance_ridge(p).packed,
    "joint": lambda p: fit_joint(p).packed,
    "two_stage": lambda p: fit_two_stage(p).packed,
    "poisson": lambda p: fit_poisson(p).packed,
}


class _Columns(Params):
    kind = Param(Params._dummy(), "kind", "which fit: " + ", ".join(FITS), TypeConverters.toString)
    docCol = Param(Params._dummy(), "docCol", "column of documents", TypeConverters.toString)
    topicCol = Param(Params._dummy(), "topicCol", "column of topics", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column of positions", TypeConverters.toString)

    def _put(self, **values) -> None:
        self._setDefault(kind="joint", docCol="doc_id", topicCol="topic", outputCol="theta")
        self._set(**{k: v for k, v in values.items() if v is not None})


class PositionEstimator(Estimator, _Columns):
    """Fits positions to a table of cells: document, topic, y and s."""

    @keyword_only
    def __init__(self, *, kind: str | None = None, docCol: str | None = None, topicCol: str | None = None, outputCol: str | None = None) -> None:
        super().__init__()
        self._put(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PositionModel:
        kind = self.getOrDefault(self.kind)
        if kind not in FITS:
            raise ValueError(f"unknown fit {kind}; there are {', '.join(FITS)}")
        packed = FITS[kind](Packed.of(dataset, self.getOrDefault(self.docCol), self.getOrDefault(self.topicCol)))
        return self._copyValues(PositionModel(packed))


class PositionModel(Model, _Columns):
    """Positions of the documents of a fit; transform adds them to any table that names documents, null where there is none."""

    def __init__(self, packed: Packed) -> None:
        super().__init__()
        self._put()
        self.packed = packed

    @property
    def positions(self) -> DataFrame:
        return self.packed.table.select(F.col("doc").alias(self.getOrDefault(self.docCol)), F.col("theta").alias(self.getOrDefault(self.outputCol)))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.join(self.positions, self.getOrDefault(self.docCol), "left")


class ClassWeighting(Transformer):
    """Top terms of classes by class-based tf-idf, from a table of topic, token and n."""

    k = Param(Params._dummy(), "k", "terms per class", TypeConverters.toInt)
    topicCol = Param(Params._dummy(), "topicCol", "column of classes", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, k: int | None = None, topicCol: str | None = None) -> None:
        super().__init__()
        self._setDefault(k=10, topicCol="topic")
        self._set(**{name: v for name, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return class_tfidf(dataset, self.getOrDefault(self.topicCol), self.getOrDefault(self.k))


def by_group(df: DataFrame, group: str, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 1_000_000) -> DataFrame:
    """f of each group's rows as one pandas frame. A group comes to one task as a whole, so one of more than `most` rows is an
    error before anything is done; null groups make one group."""
    large = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).collect()
    if large:
        raise ValueError(f"group {large[0][group]} has {large[0].n} rows, more than {most}")
    return df.groupBy(group).applyInPandas(f, schema)
