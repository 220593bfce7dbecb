"""The convolution network as an estimator and a transformer, for pipelines."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.sql import DataFrame

from brindle.operators.learning import normalise, predict_cnn, train_cnn


class Normaliser(Transformer):
    """Adds the z-scores of a vector column, from the mean and deviation of the table it is given."""

    def __init__(self, column: str):
        super().__init__()
        self.column = column

    def _transform(self, df: DataFrame) -> DataFrame:
        return normalise(df, self.column)


class ConvolutionModel(Transformer):
    def __init__(self, parameters: dict, losses: list[float], pixels: str, side: int):
        super().__init__()
        self.parameters, self.losses, self.pixels, self.side = parameters, losses, pixels, side

    def _transform(self, df: DataFrame) -> DataFrame:
        return predict_cnn(df, self.pixels, self.side, self.parameters)


class ConvolutionNetwork(Estimator):
    def __init__(self, pixels: str, label: str, side: int, classes: int, **options):
        super().__init__()
        self.pixels, self.label, self.side, self.classes, self.options = pixels, label, side, classes, options

    def _fit(self, df: DataFrame) -> ConvolutionModel:
        parameters, losses = train_cnn(df, self.pixels, self.label, self.side, self.classes, **self.options)
        return ConvolutionModel(parameters, losses, self.pixels, self.side)


def image_pipeline(pixels: str, label: str, side: int, classes: int, **options) -> Pipeline:
    """Normalisation, then the network."""
    return Pipeline(stages=[Normaliser(pixels), ConvolutionNetwork("z", label, side, classes, **options)])
