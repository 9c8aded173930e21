"""All registered queries: importing this module fills the registry."""

from driftloom.plans import learning, sources_and_text, streams, tables_and_topics  # noqa: F401
from driftloom.plans.registry import ORACLES, QUERIES  # noqa: F401
