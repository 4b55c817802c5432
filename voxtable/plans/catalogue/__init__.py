"""The query catalogue: each entry pairs a DataFrame query with an independent SQL text."""

from voxtable.plans.catalogue.base import QUERIES, SQL  # noqa: F401
from voxtable.plans.catalogue import (  # noqa: F401
    sources, cleaning, exploring, searching, topics, probabilities, sequences, composed)
