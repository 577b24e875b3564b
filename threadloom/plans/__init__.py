"""Build plan of an archive and the named queries."""


def load_catalog():
    from . import archive_queries, catalog, search_queries, text_queries, topic_queries  # noqa: F401

    return catalog.QUERIES, catalog.ORACLES
