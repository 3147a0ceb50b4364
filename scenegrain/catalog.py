"""Every query of the reference's operators, with the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

from scenegrain.queries._sql import Query

MODULES = ["scene", "evaluation", "sequence", "text", "files", "masks"]


def queries() -> dict[str, Query]:
    return {k: v for m in MODULES for k, v in import_module(f"scenegrain.queries.{m}").registry.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"scenegrain.queries.{m}").registry.sql.items()}
