"""Registered queries over the driver's tables."""

from __future__ import annotations


def load_all():
    """Import every query module and return the registry."""
    from pinchgraph.workload import registry
    from pinchgraph.workload import q_scoring, q_hypotheses, q_graph, q_resolution  # noqa: F401
    from pinchgraph.workload import q_sources, q_text, q_monitor, q_commodities, q_reports, q_streams, q_calibration  # noqa: F401

    return registry
