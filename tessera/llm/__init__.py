"""Training-data operators: language id, deduplication, packing, stores.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` below
are picked up by the repository's entry module when the subpackage is present.
"""

from __future__ import annotations


def queries():
    from tessera.llm.registry import QUERIES

    return dict(QUERIES)


def oracle_sql():
    from tessera.llm.registry import ORACLES

    return dict(ORACLES)
