"""Importing this registers every query of the library's own operators."""

from gridloom.plans import flagship, on_catalog, on_corpus, on_events, on_files, on_graph, on_media, on_native, on_roundtrip, on_streams, on_text, on_vectors  # noqa: F401
from gridloom.plans.registry import ORACLES, QUERIES  # noqa: F401
