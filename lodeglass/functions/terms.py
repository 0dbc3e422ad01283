"""How often texts hold the terms of a stated query, a batch of texts at a time.

The same terms as `lodeglass.functions.text.document_terms`. A text's names
are counted first and each distinct name is split once, so that a long text
costs little more than finding its names.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodeglass import config
from lodeglass.functions.text import identifier_tokens_of

_NAMES = re.compile(r"[A-Za-z_]\w+", re.ASCII)
#: Distinct names remembered at a time.
ROOM = 200_000
_STOP = frozenset(config.STOP_WORDS)


class TermCounter:
    """Counts of the query's terms in texts, and the texts' lengths in terms."""

    def __init__(self, terms: list[str]):
        self.places, self._known = {t: k for k, t in enumerate(terms)}, {}

    def _look(self, name: str) -> tuple[int, tuple[int, ...]]:
        found = self._known.get(name)
        if found is None:
            if len(self._known) >= ROOM:
                self._known.clear()
            tokens = [t for t in identifier_tokens_of(name) if len(t) >= 2 and t not in _STOP]
            found = self._known[name] = len(tokens), tuple(self.places[t] for t in tokens if t in self.places)
        return found

    def count(self, text: str | None) -> tuple[int, list[int]]:
        """(terms of the text, how often each of the query's terms is among them)"""
        length, counts = 0, [0] * len(self.places)
        for name, n in Counter(_NAMES.findall(text or "")).items():
            size, hits = self._look(name)
            length += n * size
            for k in hits:
                counts[k] += n
        return length, counts


def term_counts(text: Column, terms: list[str]) -> Column:
    """STRUCT(dl, f): a text's length in terms and the counts of `terms`; 0 for null."""

    @F.pandas_udf("dl int, f array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        counter = TermCounter(terms)
        return pd.DataFrame([counter.count(t) for t in texts], columns=["dl", "f"])

    return count(text)
