"""Query plans over the driver tables: fixtures, the registry, and the query modules."""


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    from tunedata.plans import q_audit  # noqa: F401
    for mod in ("q_prep", "q_eval", "q_catalog", "q_tracking", "q_sources", "q_ingest"):
        try:
            __import__(f"tunedata.plans.{mod}")
        except ModuleNotFoundError as ex:
            if ex.name != f"tunedata.plans.{mod}":
                raise
