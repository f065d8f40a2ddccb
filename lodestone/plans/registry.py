"""All registered queries: importing the catalogues registers them."""

from lodestone.plans import citation_catalogue, gates_catalogue, pages_catalogue, relational_catalogue, text_catalogue  # noqa: F401
from lodestone.plans.catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
