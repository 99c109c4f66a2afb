"""All registered queries; importing this fills the catalogue."""

from quotelake.plans import (  # noqa: F401
    history_queries,
    market_queries,
    signal_queries,
    source_queries,
    stream_queries,
    user_queries,
)
from quotelake.plans.catalog import ORACLES, QUERIES  # noqa: F401
