"""Queries over the standing views, grouped by subject."""

from importlib import import_module

SUBJECTS = ["features", "catalog", "evaluation", "routing", "search", "live"]


def load_all() -> None:
    """Import every subject module once; importing registers its queries."""
    for s in SUBJECTS:
        import_module(f"{__name__}.{s}")
