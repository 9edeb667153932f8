"""A confidence made of the scores of several layers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
WEIGHTS = {"regex": 0.30, "ner": 0.25, "context": 0.20, "validator": 0.15, "structure": 0.10}


def composite(scores: dict[str, Column | str | float], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted sum of the layers' scores, held within 0 and 1; layers without a score, or with null, count 0."""
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights must sum to 1, not {sum(weights.values()):.3f}")
    if unknown := set(scores) - set(weights):
        raise ValueError(f"no weight for {sorted(unknown)}")
    total = F.lit(0.0)
    for layer, weight in weights.items():
        if layer in scores:
            score = scores[layer]
            score = F.col(score) if isinstance(score, str) else score if isinstance(score, Column) else F.lit(float(score))
            total = total + weight * F.coalesce(score, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
