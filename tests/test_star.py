"""The star tables reach the fact views whole."""

from __future__ import annotations

import pytest

from callweave.plans.star import Facts

from .conftest import SMALL


@pytest.mark.parametrize(("view", "table"), [("raw_edges", "lineitem"), ("bindings", "events"), ("unresolved", "events")])
def test_no_row_is_left_out(spark, view, table):
    facts = Facts(spark, SMALL)
    assert getattr(facts, view).count() == facts.star(table).count()
