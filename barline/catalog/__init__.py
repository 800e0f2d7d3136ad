"""Registered queries over the driver tables and their SQL twins."""

from __future__ import annotations

from . import base

FLAGSHIP = "momentum_backtest"


def _load() -> None:
    from . import core, modelled, regime, trading  # noqa: F401


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(base.ORACLES)
