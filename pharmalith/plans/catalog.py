"""All registered queries in one place."""

from pharmalith.plans import (  # noqa: F401
    queries_drugs,
    queries_files,
    queries_packs,
    queries_quality,
    queries_trials,
    queries_tools,
)
from pharmalith.plans.registry import ORACLES, QUERIES  # noqa: F401
