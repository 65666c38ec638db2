"""The registered queries; importing this package fills the registry."""

from threadloom.queries import (  # noqa: F401
    annotation, learning, measuring, profile, sampling, scoring, sinks, sources, texts, threads,
)
from threadloom.queries.registry import RUNS, SQL  # noqa: F401
