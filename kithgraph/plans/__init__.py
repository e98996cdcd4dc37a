"""Named queries that bind the operators to the test tables."""


def load_all() -> None:
    """Imports every module of queries, which registers them."""
    from kithgraph.plans import accounts, alignment, batches, crawl, entities, further, graph, more, relational, resolution, sampling, settled, text, venues, views

    _ = (accounts, alignment, batches, crawl, entities, further, graph, more, relational, resolution, sampling, settled, text, venues, views)
