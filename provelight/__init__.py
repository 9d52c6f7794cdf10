"""provelight: Spark-native analytics for formal-proof evaluation records."""

from provelight.session import local_session

__version__ = "0.1.0"
__all__ = ["grade", "judges", "local_session", "problem_health", "read_jsonl", "read_manifest", "read_problems", "read_submissions", "run", "verifiers"]

_HOMES = {
    "provelight.plans.grade": ("grade", "judges", "problem_health", "run", "verifiers"),
    "provelight.sources.folders": ("read_manifest", "read_problems", "read_submissions"),
    "provelight.sources.records": ("read_jsonl",),
}


def __getattr__(name: str):
    """The public names, imported when they are asked for."""
    import importlib

    for home, names in _HOMES.items():
        if name in names:
            return getattr(importlib.import_module(home), name)
    raise AttributeError(f"module 'provelight' has no attribute {name!r}")
