"""Import every query module so its queries register; re-export the registry."""

from dpframe.plans import (q_dp, q_eval, q_experiments, q_flagship, q_prepare, q_runs, q_select, q_sources,  # noqa: F401
                           q_sample, q_train)
from dpframe.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
