"""Registered queries of the operators, with SQL twins where SQL can say them."""

from parlance.catalogue import audio_text, folds, intervals, joins, pieces, vectors
from parlance.catalogue.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audio_text", "folds", "intervals", "joins", "pieces", "vectors"]
