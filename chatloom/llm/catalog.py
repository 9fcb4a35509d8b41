"""The registered queries of this package."""

from __future__ import annotations

from chatloom.llm import align, bpe, chat, classifier, codes, decontaminate, frames, langid, licenses, lm, near, quality, urls

_ALL = {}
for _module in (quality, langid, decontaminate, licenses, bpe, chat, urls, frames, near, lm, classifier, align, codes):
    _ALL |= _module.QUERIES

QUERIES = {name: q.build for name, q in _ALL.items()}
ORACLE_SQL = {name: q.sql for name, q in _ALL.items() if q.sql}
