"""The fit queries run the whole cascade at the default number of steps."""

from __future__ import annotations

import inspect
from unittest.mock import MagicMock

import pytest

from skyrill.plans import catalog


@pytest.mark.parametrize("name", ["svi_fit", "posterior_band"])
def test_fits_use_the_defaults(name, monkeypatch):
    signature = inspect.signature(catalog.fitters.fit_parametric)
    fit = MagicMock()
    monkeypatch.setattr(catalog.fitters, "fit_parametric", fit)
    monkeypatch.setattr(catalog.fitters, "posterior_curves", MagicMock())
    monkeypatch.setattr(catalog.v, "events_relative", MagicMock())
    monkeypatch.setattr(catalog, "F", MagicMock())
    catalog.queries()[name](None, "")
    call = signature.bind(*fit.call_args.args, **fit.call_args.kwargs)
    call.apply_defaults()
    assert call.arguments["steps"] == 1000 and call.arguments["only"] is None
