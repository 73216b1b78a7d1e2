"""Registered queries over the shared tables, each with SQL that gives the same rows."""

from . import code, context, corpus, graph, sections, stores, texts

REGISTRIES = (corpus, texts, sections, code, graph, context, stores)

QUERIES = {name: q for module in REGISTRIES for name, q in module.QUERIES.items()}
