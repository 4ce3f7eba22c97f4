"""All mesh queries and the SQL that checks them, by name."""

from __future__ import annotations

from importlib import import_module

FLAGSHIP = "p20_contact_pairs"
MODULES = ("mesh", "patches", "loops", "regions", "stores", "materials")


def _of(attribute: str) -> dict:
    """Where a module has NAME_whole beside NAME, the latter is a small case for tests: NAME means the whole tables here, too."""
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"meshlake.queries.{name}"), attribute)
    return found | {name.removesuffix("_whole"): made for name, made in found.items() if name.endswith("_whole")}


def small_cases() -> dict[str, tuple]:
    """Query and SQL of the small cases, which see some rows of their tables alone."""
    modules = [import_module(f"meshlake.queries.{name}") for name in MODULES]
    return {name: (m.QUERIES[name], m.ORACLES[name]) for m in modules for name in m.ORACLES if f"{name}_whole" in m.ORACLES}


def queries() -> dict:
    return _of("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _of("ORACLES")
