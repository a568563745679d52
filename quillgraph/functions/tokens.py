"""Tokens of the keyword index and of queries."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERY_WORD = r"(?U)\w+"
INDEX_TOKEN = r"[\p{L}\p{N}]+"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters whose canonical decomposition is a letter and marks, and that letter."""
    pairs = []
    for code in range(0xC0, 0x2000):
        whole = unicodedata.normalize("NFD", chr(code))
        if len(whole) > 1 and all(unicodedata.combining(c) for c in whole[1:]):
            pairs.append((chr(code), whole[0]))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def folded(text: Column) -> Column:
    """Lower case without accents."""
    marked, bare = _accents()
    return F.regexp_replace(F.translate(F.lower(text), marked, bare), r"\p{Mn}", "")


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(INDEX_TOKEN), F.lit(0))


def query_words(text: Column) -> Column:
    """Runs of word characters; operators and quotes of a query are no syntax."""
    return F.regexp_extract_all(text, F.lit(QUERY_WORD), F.lit(0))
