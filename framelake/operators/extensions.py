"""Where users plug in their own models: analyzers, shape models and instance models."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREDICTION_SCHEMA = "label string, confidence double, accepted boolean, reason string, candidates array<struct<label:string,probability:double>>"

_EXTENSIONS: dict[str, Callable[[dict], dict]] = {}


def register_extension(name: str, analyze: Callable[[dict], dict]) -> None:
    """Registers a per-object analyzer that returns text values and may return a confidence."""
    if name in _EXTENSIONS:
        raise ValueError(f"extension registered twice: {name}")
    _EXTENSIONS[name] = analyze


def apply_extensions(df: DataFrame, inputs: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Adds ``extensions`` (name to map of values); a failing analyzer yields its error and confidence 0."""
    chosen = {n: _EXTENSIONS[n] for n in (names if names is not None else sorted(_EXTENSIONS))}

    @F.pandas_udf("map<string,map<string,string>>")
    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for values in zip(*columns):
            row, found = dict(zip(inputs, values)), {}
            for name, analyze in chosen.items():
                try:
                    found[name] = {k: str(v) for k, v in analyze(row).items()}
                except Exception as error:  # an optional analyzer must not stop the job
                    found[name] = {"error": f"{type(error).__name__}: {error}", "confidence": "0.0"}
            out.append(found)
        return pd.Series(out)

    return df.withColumn("extensions", run(*[F.col(c) for c in inputs]))


def shape_model(load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], inputs: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Batch scoring with a model loaded once per task; it must return one row per input row.

    Adds ``prediction`` (label, confidence, accepted, reason, candidates).
    """

    @F.pandas_udf(PREDICTION_SCHEMA)
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for given in batches:
            result = model(given)
            if len(result) != len(given):
                raise ValueError(f"model returned {len(result)} predictions for {len(given)} objects")
            yield result[["label", "confidence", "accepted", "reason", "candidates"]]

    return lambda df: df.withColumn("prediction", run(F.struct(*inputs)))


def instance_model(df: DataFrame, segment: Callable[[pd.DataFrame], pd.DataFrame], schema: str, *, batch_rows: int = 128) -> DataFrame:
    """Frames to any number of objects each; the model sees up to ``batch_rows`` frames at once, as a frame may hold many objects."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first in range(0, max(len(pdf), 1), batch_rows):
                yield segment(pdf.iloc[first : first + batch_rows].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def circular_mean(angle: Column) -> Column:
    """Mean direction of angles in degrees as a partial aggregate, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle))))), F.lit(360.0))
