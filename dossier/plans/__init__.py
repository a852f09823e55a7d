"""Runnable queries over the driver tables, each with its SQL twin."""
from dossier.plans.base import ORACLES, QUERIES  # noqa: F401
from dossier.plans import (  # noqa: F401
    chunks, classify, curation, evaluation, extraction, joins, ranking, sources, streams, text, windows,
)
