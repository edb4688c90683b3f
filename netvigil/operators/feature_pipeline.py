"""One fitted feature pipeline for training and scoring.

The steps are Spark ML stages with writers, so a ``PipelineModel`` holds all of them and
``write().save`` / ``load`` bring it back with equal features (no pickles):

    RollingFeatures -> FillZero -> SelectFeatures (X5, X6) -> ScaleFeatures (P12, P13)
    [-> EncodeValues (P10, P11)]

What a fit learns from the rows is one aggregation a step.  Of it a selector keeps a list
of names and a scaler two numbers a column, as params; an encoder keeps a table of (value,
code) of any size, which is joined and never collected.

Defined results: NULL features count as 0; a pipeline fitted on an empty table scales every
value to the lower end of the range; a value the encoder has not seen, and NULL, get NULL; columns that are no
features pass through.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter,
                             MLReadable, MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CORRELATION_THRESHOLD, MAX_FEATURES, WINDOW_SIZE
from . import features as rolling
from .prep import (ScalerModel, drop_correlated, feature_scores, fit_minmax, fit_standard, ordinal_codes,
                   select_k_best)

SUFFIX = "_s"


def _names(name: str, doc: str) -> Param:
    return Param(Params._dummy(), name, doc, TypeConverters.toListString)


class _Stage(Params):
    """Params given by keyword, as Spark ML's own stages take them."""

    def _given(self, **defaults):
        self._setDefault(**defaults)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def get(self, name: str):
        return self.getOrDefault(self.getParam(name))


class RollingFeatures(_Stage, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the rolling features (W1-W14) of the last ``rows`` rows; windows do not cross the columns of
    ``within`` that the frame has."""

    features = _names("features", "rolling features to add")
    within = _names("within", "columns whose values part the windows, where the frame has them")
    rows = Param(Params._dummy(), "rows", "rows of a window", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, features=None, within=None, rows=None):
        super().__init__()
        self._given(features=list(rolling.BASIC + rolling.ADVANCED), within=[], rows=WINDOW_SIZE)

    def _transform(self, df: DataFrame) -> DataFrame:
        keys = tuple(c for c in self.get("within") if c in df.columns)
        return rolling.rolling_features(df, tuple(self.get("features")), self.get("rows"), keys, keep=tuple(df.columns))


class FillZero(_Stage, Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """P5 for the named columns, all as doubles."""

    columns = _names("columns", "columns to fill")

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._given(columns=[])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.get("columns")})


class SelectFeatures(_Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """X5, then X6: correlated columns go, of the others the ``k`` best by ``score`` against ``label`` stay."""

    columns = _names("columns", "candidate columns, in order")
    label = Param(Params._dummy(), "label", "class column", TypeConverters.toString)
    score = Param(Params._dummy(), "score", "anova_f, chi2 or mutual_info", TypeConverters.toString)
    k = Param(Params._dummy(), "k", "columns to keep at most", TypeConverters.toInt)
    threshold = Param(Params._dummy(), "threshold", "|r| above which a column goes", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, columns=None, label=None, score=None, k=None, threshold=None):
        super().__init__()
        self._given(columns=[], label="label", score="anova_f", k=MAX_FEATURES, threshold=CORRELATION_THRESHOLD)

    def _fit(self, df: DataFrame) -> SelectFeaturesModel:
        kept, dropped = drop_correlated(df, self.get("columns"), self.get("threshold"))
        if len(kept) > self.get("k"):  # scores decide only where there are columns too many
            scores = feature_scores(df, kept, self.get("score"), self.get("label"))
            best = {r["feature"] for r in select_k_best(scores, self.get("k")).where("selected").collect()}  # a row a column
            kept = [c for c in kept if c in best]
        return SelectFeaturesModel(kept=kept, gone=[c for c in self.get("columns") if c not in kept])


class SelectFeaturesModel(_Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    kept = _names("kept", "columns that stay, in order")
    gone = _names("gone", "candidates that go")

    @keyword_only
    def __init__(self, *, kept=None, gone=None):
        super().__init__()
        self._given(kept=[], gone=[])

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.get("gone"))


class ScaleFeatures(_Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """P12 / P13 over those of ``columns`` that the steps before have left, as ``<column>_s``."""

    columns = _names("columns", "columns to scale, where the frame has them")
    kind = Param(Params._dummy(), "kind", "minmax or standard", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, kind=None):
        super().__init__()
        self._given(columns=[], kind="minmax")

    def _fit(self, df: DataFrame) -> ScaleFeaturesModel:
        cols = [c for c in self.get("columns") if c in df.columns]
        fitted = {"minmax": fit_minmax, "standard": fit_standard}[self.get("kind")](df, cols)
        return ScaleFeaturesModel(columns=cols, kind=fitted.kind, low=[fitted.params[c][0] for c in cols],
                                  high=[fitted.params[c][1] for c in cols], span=[fitted.lo, fitted.hi])


class ScaleFeaturesModel(_Stage, Model, DefaultParamsReadable, DefaultParamsWritable):
    columns = _names("columns", "scaled columns, in order")
    kind = Param(Params._dummy(), "kind", "minmax or standard", TypeConverters.toString)
    low = Param(Params._dummy(), "low", "minimum or mean of each column (null without rows)")
    high = Param(Params._dummy(), "high", "maximum or deviation of each column (null without rows)")
    span = Param(Params._dummy(), "span", "range of min-max scaling")

    @keyword_only
    def __init__(self, *, columns=None, kind=None, low=None, high=None, span=None):
        super().__init__()
        self._given(columns=[], kind="minmax", low=[], high=[], span=[0.0, 1.0])

    def scaler(self) -> ScalerModel:
        return ScalerModel(self.get("kind"), dict(zip(self.get("columns"), zip(self.get("low"), self.get("high")))), *self.get("span"))

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.scaler().transform(df, suffix=SUFFIX).drop(*self.get("columns"))


class EncodeValues(_Stage, Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """The codes of ``column``'s values in their order, as ``<column>_code``."""

    column = Param(Params._dummy(), "column", "column to encode", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, column=None):
        super().__init__()
        self._given(column="label")

    def _fit(self, df: DataFrame) -> EncodeValuesModel:
        c = self.get("column")
        model = EncodeValuesModel(column=c)
        model.codes = ordinal_codes(df.select(c).distinct(), c).where(F.col(c).isNotNull()).select(c, f"{c}_code")
        return model


class EncodeValuesModel(_Stage, Model, MLReadable, MLWritable):
    """``codes``: the fitted table (value, code), saved beside the params."""

    column = Param(Params._dummy(), "column", "encoded column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, column=None):
        super().__init__()
        self.codes: DataFrame | None = None
        self._given(column="label")

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.join(self.codes, self.get("column"), "left").select(*df.columns, f"{self.get('column')}_code")

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader()


class _EncoderWriter(MLWriter):
    def __init__(self, model: EncodeValuesModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.codes.write.parquet(f"{path}/codes")


class _EncoderReader(MLReader):
    def load(self, path: str) -> EncodeValuesModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = EncodeValuesModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.codes = self.sparkSession.read.parquet(f"{path}/codes")
        return model


def flow_stages(features=rolling.BASIC + rolling.ADVANCED, raw=(), label: str = "label", score: str = "anova_f",
                k: int = MAX_FEATURES, kind: str = "minmax", within=("split",)) -> list:
    """The stages for flows: rolling features and the ``raw`` columns, filled, selected and scaled."""
    columns = [*features, *raw]
    return [RollingFeatures(features=list(features), within=list(within)), FillZero(columns=columns),
            SelectFeatures(columns=columns, label=label, score=score, k=k), ScaleFeatures(columns=columns, kind=kind)]


def fit_pipeline(df: DataFrame, stages: list) -> PipelineModel:
    """Fit the stages in order.  The rows behind the last window step are held while the later steps
    aggregate them, so the windows run once and not once a step."""
    fitted, held = [], None
    try:
        for stage in stages:
            model = stage.fit(df) if isinstance(stage, Estimator) else stage
            df = model.transform(df)
            if isinstance(stage, RollingFeatures):
                if held is not None:
                    held.unpersist()
                df = held = df.persist()
            fitted.append(model)
    finally:
        if held is not None:
            held.unpersist()
    return PipelineModel(fitted)


def scaling_of(pipeline: PipelineModel) -> ScaleFeaturesModel:
    """The scaling step of a fitted pipeline; its columns are the pipeline's features, in order."""
    return next(s for s in reversed(pipeline.stages) if isinstance(s, ScaleFeaturesModel))
