"""All queries of this subpackage. Importing the modules registers them."""

from __future__ import annotations

import importlib

import corpus_pipeline
from tidewell.llm.registry import QUERIES, SQL, Query

MODULES = ("syncmers", "toxicity", "setjoin", "prefixtree", "pii", "nbsvm", "mixing", "linededup", "warc", "decontaminate", "infill", "wordruns", "langid")
for _module in MODULES:
    importlib.import_module(f"tidewell.llm.{_module}")
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
