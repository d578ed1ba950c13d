"""All registered timetable queries: importing the modules registers them."""

from . import catalog, documents, feeds, journeys, reaching, surface  # noqa: F401

QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES
