"""All registered queries."""

from importlib import import_module

SECTIONS = ["ingest", "projections", "filtering", "classification", "joins", "aggregates", "budgeting", "reporting", "ordering", "tenancy"]


def load():
    from spendframe.plans import registry

    for section in SECTIONS:
        import_module(f"spendframe.plans.{section}")
    return registry.QUERIES, registry.ORACLES
