"""Registered queries; importing the package registers them."""

from . import anchors, detection, lineage, logs, ordering, quality, review, spans, text  # noqa: F401
