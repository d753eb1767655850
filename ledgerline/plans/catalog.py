"""All registered queries and their SQL oracles, gathered from the plan modules."""

from ledgerline.plans import queries as _q  # noqa: F401  (reconciliation of flat invoices)
from ledgerline.plans import queries_x12 as _x  # noqa: F401  (X12 interchanges)
from ledgerline.plans import queries_ingest as _i  # noqa: F401  (inbound mailbox)
from ledgerline.plans import queries_flat as _f  # noqa: F401  (flat files)
from ledgerline.plans import queries_xml as _m  # noqa: F401  (XML, cXML)
from ledgerline.plans import queries_json as _j  # noqa: F401  (JSON documents)
from ledgerline.plans import queries_rules as _r  # noqa: F401  (rules, keys, listings)
from ledgerline.plans import queries_quality as _q2  # noqa: F401  (transforms, quality)
from ledgerline.plans import queries_stream as _s  # noqa: F401  (Structured Streaming)
from ledgerline.plans.queries import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
