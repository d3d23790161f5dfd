"""Registered queries over the standard tables, each with its SQL counterpart."""

import importlib

from seqspark.plans import base

FAMILIES = ["sources", "texts", "vocabs", "examples", "batches", "metrics", "rankings", "streams"]


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"seqspark.plans.{family}")


def queries() -> dict:
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(base.ORACLES)
