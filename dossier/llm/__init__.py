"""Operators of a training-data pipeline; nothing else in the package imports this folder."""
from dossier.llm.queries import ORACLES, QUERIES  # noqa: F401
