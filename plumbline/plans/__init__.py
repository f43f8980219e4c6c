"""Queries over the driver's tables, one module a family; importing this registers them all."""

from . import features, graph, manifests, quality, records, relational, series, shapes, statistics, streams, text, vectors  # noqa: F401
