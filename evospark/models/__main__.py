"""``python -m evospark.models PATH [MODEL]``: loads records, splits them, fits and prints metrics."""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import SparkSession

from ..sources.files import CONFIG, load_dataset
from .surrogates import MODELS, metrics, split


def run(spark: SparkSession, path: str, model: str = "gp", most: int = 1000) -> dict[str, dict[str, float]]:
    """Validation and test metrics of a model on a 60/20/20 split of at most ``most`` records, the
    size of the training window."""
    rows = load_dataset(spark, path).limit(most).select(*(f"config.{c}" for c in CONFIG), "fitness").collect()
    table = np.array([[v or 0.0 for v in r] for r in rows], float)
    x, y = table[:, :-1], table[:, -1]
    a, b, c = split(len(y))
    fitted = MODELS[model]().fit(x[a], y[a])
    return {"validation": metrics(y[b], fitted.predict(x[b])[0]), "test": metrics(y[c], fitted.predict(x[c])[0])}


if __name__ == "__main__":
    from ..session import local_session

    print(json.dumps(run(local_session(), sys.argv[1], *sys.argv[2:3])))
