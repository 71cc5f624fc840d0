"""A small forest with given nodes, so that scoring and Shapley values can be checked by SQL.

Three trees over the flow features (destination port, bytes in, bytes out), as rows of
``forest.NODE_SCHEMA``; a leaf has feature -1. The cut score is given as well.
"""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd

from palisade import constants as C

SUBSAMPLE = 256
CUT = 0.55
NODES = [
    # tree, node, feature, threshold, left, right, size, depth
    (0, 0, 1, 300_000.0, 1, 2, 256, 0),
    (0, 1, 2, 1_480.0, 3, 4, 250, 1),
    (0, 2, -1, 0.0, -1, -1, 6, 1),
    (0, 3, -1, 0.0, -1, -1, 248, 2),
    (0, 4, -1, 0.0, -1, -1, 2, 2),
    (1, 0, 0, 20.0, 1, 2, 256, 0),
    (1, 1, -1, 0.0, -1, -1, 1, 1),
    (1, 2, 1, 250_000.0, 3, 4, 255, 1),
    (1, 3, -1, 0.0, -1, -1, 200, 2),
    (1, 4, 0, 900.0, 5, 6, 55, 2),
    (1, 5, -1, 0.0, -1, -1, 50, 3),
    (1, 6, -1, 0.0, -1, -1, 5, 3),
    (2, 0, 2, 40.0, 1, 2, 256, 0),
    (2, 1, -1, 0.0, -1, -1, 3, 1),
    (2, 2, -1, 0.0, -1, -1, 253, 1),
]


def nodes() -> pd.DataFrame:
    return pd.DataFrame(NODES, columns=["tree", "node", "feature", "threshold", "left", "right",
                                        "size", "depth"])


def _average_path(n: int) -> float:
    if n <= 2:
        return float(n == 2)
    return 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _length_sql(tree: int, node: int, known: tuple[int, ...]) -> str:
    """Path length below a node; a split on an unknown feature follows both children."""
    _, _, feature, threshold, left, right, size, depth = next(
        n for n in NODES if n[:2] == (tree, node))
    if feature < 0:
        return f"{depth + _average_path(size)!r}::double"
    below = [_length_sql(tree, n, known) for n in (left, right)]
    if feature in known:
        return (f"CASE WHEN {C.FLOW_FEATURES[feature]} <= {threshold} THEN {below[0]}"
                f" ELSE {below[1]} END")
    share = next(n[6] for n in NODES if n[:2] == (tree, left)) / size
    return f"({share!r}::double * {below[0]} + {1 - share!r}::double * {below[1]})"


def sql(flows: str) -> str:
    """``scored`` and ``explained`` as common table expressions after ``flows``."""
    trees = sorted({n[0] for n in NODES})
    teams = [t for k in range(4) for t in combinations(range(3), k)]

    def name(team: tuple[int, ...]) -> str:
        return "v" + "".join(map(str, team))

    values = ",\n    ".join(
        "(" + " + ".join(_length_sql(t, 0, team) for t in trees) + f") / {len(trees)} AS {name(team)}"
        for team in teams)
    weight = {0: "1.0 / 3", 1: "1.0 / 6", 2: "1.0 / 3"}
    shap = ", ".join(
        " + ".join(f"{weight[len(t)]} * ({name(tuple(sorted((*t, i))))} - {name(t)})"
                   for t in teams if i not in t) + f" AS shap{i}" for i in range(3))
    return f"""WITH {flows},
valued AS (SELECT *, {values} FROM flows),
scored AS (SELECT *, power(2.0, -v012 / {_average_path(SUBSAMPLE)!r}::double) AS score FROM valued),
explained AS (SELECT *, CASE WHEN score > {CUT} THEN -1 ELSE 1 END AS prediction,
    v AS expected, {shap} FROM scored)
"""
