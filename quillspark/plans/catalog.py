"""All queries of the core by name, with the SQL each is compared with."""

from __future__ import annotations

from quillspark.plans import chunks, cleaning, evaluation, retrieval, streams, structure  # noqa: F401
from quillspark.plans.registry import QUERIES, SQL  # noqa: F401
