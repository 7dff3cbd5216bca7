"""All queries over the supplied tables and the SQL that must give the same rows."""

from .plans import aggregates, assessment, calibration, candidates, features, feeds, folds, joins, models, pages, policy, quotes, rules, scalars, sets, strengths, windows  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
