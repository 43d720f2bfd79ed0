"""Importing this module registers every key (see registry.py)."""

from kestrel.plans import cat_analytics  # noqa: F401
from kestrel.plans import cat_features  # noqa: F401
from kestrel.plans import cat_scoring  # noqa: F401
from kestrel.plans import cat_pipeline  # noqa: F401
