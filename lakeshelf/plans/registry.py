"""All queries of the catalogue with their SQL."""

from lakeshelf.plans import artists, auditing, cleaning, cues, exports, labels, parsing, reconciling, reviewing, series, whole
from lakeshelf.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "artists", "auditing", "cleaning", "cues", "exports", "labels", "parsing", "reconciling", "reviewing", "series", "whole"]
