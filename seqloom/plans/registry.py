"""All registered queries over the given tables and the SQL that checks them."""

from __future__ import annotations

import importlib

from .base import QUERIES, SQL  # noqa: F401

for _name in ("projections", "fusion", "series", "curation"):
    importlib.import_module(f"{__package__}.{_name}")
