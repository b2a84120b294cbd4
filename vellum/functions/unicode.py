"""Forms of Unicode that no column expression gives: composed text, and words folded to their letters without marks."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


#: Characters that are Python strings at once.
HELD = 1 << 20


def _ruled(rule: Callable[[str], str], texts: pa.Array) -> pa.Array:
    """The rule for each text of a batch; a null stays one. Only some texts at a time are Python's, the rest is Arrow's."""
    made, start, held = [], 0, 0
    lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
    for i, n in enumerate(lengths):
        held += n
        if held >= HELD or i + 1 == len(lengths):
            some = texts.slice(start, i + 1 - start)
            old = some.to_pylist()
            new = [None if t is None else rule(t) for t in old]
            made.append(some if new == old else pa.array(new, texts.type))
            start, held = i + 1, 0
    return made[0] if len(made) == 1 else pa.concat_arrays(made) if made else texts


def _batched(rule: Callable[[str], str], column: Column | str) -> Column:
    """The rule for each text. Made when it is used: a session must be there by then."""

    def each(texts: pa.Array) -> pa.Array:
        return _ruled(rule, texts)

    each.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return arrow_udf(each, T.StringType())(column)


def compose(text: str) -> str:
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def fold(word: str) -> str:
    """Lower case without the marks on letters; letters that are no letter with a mark, such as `ł`, stay."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def composed(column: Column | str) -> Column:
    """Texts in their composed form; most are already, which costs a look."""
    return _batched(compose, column)


def folded(column: Column | str) -> Column:
    return _batched(fold, column)
