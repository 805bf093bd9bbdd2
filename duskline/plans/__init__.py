"""Registered queries and their SQL equivalents."""


def load():
    from duskline.plans import (  # noqa: F401
        cleaning_queries,
        clustered_queries,
        company_queries,
        evaluation_queries,
        model_queries,
        sampling_queries,
        timeline_queries,
    )
    from duskline.plans.catalog import ORACLES, QUERIES

    return QUERIES, ORACLES
