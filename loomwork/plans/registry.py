"""All registered queries: importing the modules of queries fills the catalogue."""

from loomwork.plans import bernoulli, models, readouts
from loomwork.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "bernoulli", "models", "readouts"]
