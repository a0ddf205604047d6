"""Extension points: detectors and classifiers by name, from inside or outside the package.

A detector is a fit function and the offset of its scores (higher scores are more normal):

    fit(train, features, key_cols, *, seed, n_rows, **params) -> model
    model.score(df, keep) -> DataFrame with the ``keep`` columns and ``score``

A model may also have ``train_scores()`` when scores of its own training rows differ from
scoring them as new rows.  ``search(prepared, cfg, grid)`` replaces the general grid search where
configurations can share work; ``grid`` is the default grid.  ``supervised_cut`` says whether the
``contamination`` parameter sets the threshold (otherwise it is ignored with a warning).

A classifier is a fit function:

    fit(train, features, label, params, *, seed, n_rows) -> model
    model.predict(df, keep) -> DataFrame with the ``keep`` columns and ``y_pred`` (0 or 1)

A model with ``first(n)`` (its first n rounds) lets a grid search share one fit between
configurations that differ in ``n_estimators`` only.

Groups of engineered features are registered by ``functions.features.register_group``.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Callable


@dataclass(frozen=True)
class Detector:
    fit: Callable[..., Any]
    offset: float
    search: Callable[..., dict] | None = None
    grid: dict | None = None
    supervised_cut: bool = True


@dataclass(frozen=True)
class Classifier:
    fit: Callable[..., Any]
    grid: dict | None = None


DETECTORS: dict[str, Detector] = {}
CLASSIFIERS: dict[str, Classifier] = {}


def _add(table: dict, name: str, entry, replace: bool) -> None:
    if name in table and not replace:
        raise ValueError(f"{name} is registered already")
    table[name] = entry


def register_detector(name: str, entry: Detector, replace: bool = False) -> None:
    _add(DETECTORS, name, entry, replace)


def register_classifier(name: str, entry: Classifier, replace: bool = False) -> None:
    _add(CLASSIFIERS, name, entry, replace)


def _known(kind: str, table: dict, name: str):
    from .operators import detect  # noqa: F401  (registers the package's own)
    if name not in table:
        raise ValueError(f"no {kind} is called {name!r}; there are {sorted(table)}")
    return table[name]


def detector(name: str) -> Detector:
    return _known("detector", DETECTORS, name)


def classifier(name: str) -> Classifier:
    return _known("classifier", CLASSIFIERS, name)
