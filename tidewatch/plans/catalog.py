"""All registered queries."""

from tidewatch.plans import cleaning, evaluating, modelling, neighborhood, preparing  # noqa: F401
from tidewatch.plans.registry import QUERIES, SQL  # noqa: F401
