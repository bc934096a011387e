"""Search-visibility measurement as Spark DataFrame operators."""

from liftlens.params import Hypothesis, Params

__all__ = ["Hypothesis", "Params"]
