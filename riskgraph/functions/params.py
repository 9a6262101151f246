"""Detector constants; one frozen class each, so that tests can override them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CardTesting:
    window_minutes: int = 60
    max_auth: float = 5.0
    large: float = 50.0
    cleared: float = 100.0
    confirmed: float = 0.94
    uncleared: float = 0.86
    probes_only: float = 0.55
    none: float = 0.05


@dataclass(frozen=True)
class Burst:
    window_hours: int = 48
    anomalous: float = 0.84
    usual: float = 0.70
    single: float = 0.45
    many: float = 0.60


@dataclass(frozen=True)
class NewDevice:
    new: float = 0.78
    proxy: float = 0.85
    found: float = 0.30
    other: float = 0.50


@dataclass(frozen=True)
class Region:
    window_hours: int = 48
    established: int = 10
    concurrent: float = 0.88
    travel: float = 0.38
    home: float = 0.10
    visited: float = 0.25


@dataclass(frozen=True)
class Takeover:
    online_at_most: int = 1
    in_person_at_least: int = 15
    sudden: float = 0.88
    mismatched: float = 0.78
    none: float = 0.20


@dataclass(frozen=True)
class Ring:
    three: float = 0.95
    two: float = 0.82
    one: float = 0.20


@dataclass(frozen=True)
class Model:
    """Boosted trees and their calibration."""

    depth: int = 4
    rounds: int = 150
    step: float = 0.08
    min_leaf: int = 20
    seed: int = 42
    folds: int = 5
    threshold: float = 0.70
    rows_per_task: int = 50_000
