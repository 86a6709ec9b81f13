"""Query catalogue."""

from brindle.plans import deals, features, history, models, pages, relational, similar, streams, texts, training  # noqa: F401
from brindle.plans.base import ORACLE, QUERIES  # noqa: F401
