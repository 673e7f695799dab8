"""Registered products computed from monthly partial states.

Each query brings the state up to the request table (the first one computes
every month, later ones the changed months) and derives its product from it.
The oracles are those of the products computed from all rows.
"""

from __future__ import annotations

import os
import threading

from civiclens.operators import incremental as N
from civiclens.plans import analytics  # noqa: F401 - the oracles
from civiclens.plans.registry import ORACLES, register
from civiclens.session import checkpoint_dir, configure
from civiclens.sources.monthly import MonthlyState
from civiclens.sources.requests import fact_path, fact_requests

_LOCK = threading.Lock()
CELLS_VERSION = 1  # bump when ``cells`` changes


def state(spark, sf_dir):
    configure(spark)
    fact_requests(spark, sf_dir)
    source = fact_path(spark, sf_dir)
    root = os.path.join(checkpoint_dir(spark), "civiclens", "states", f"cells-{CELLS_VERSION}-{os.path.basename(source)}")
    cells = MonthlyState(spark, root, N.cells)
    with _LOCK:
        cells.refresh(source)
    return cells.read()


@register("inc_close_percentiles", ORACLES["agg_close_percentiles"])
def q_percentiles(spark, sf_dir):
    return N.close_percentiles(state(spark, sf_dir))


@register("inc_close_hist", ORACLES["agg_close_hist"])
def q_hist(spark, sf_dir):
    return N.close_hist(state(spark, sf_dir))


@register("inc_close_overall", ORACLES["agg_close_overall"])
def q_overall(spark, sf_dir):
    return N.close_overall(state(spark, sf_dir))


@register("inc_frequency_long", ORACLES["agg_frequency_long"])
def q_frequency(spark, sf_dir):
    return N.frequency_long(state(spark, sf_dir))


@register("inc_fcr", ORACLES["agg_fcr"])
def q_fcr(spark, sf_dir):
    return N.fcr_rate(state(spark, sf_dir))


@register("inc_geo_metrics", ORACLES["agg_geo_metrics"])
def q_geo(spark, sf_dir):
    return N.geo_metrics(state(spark, sf_dir))
