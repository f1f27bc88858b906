"""Fill-in-the-middle: a text's middle is moved behind its prefix and suffix.

A text is cut into units by a pattern of the ``regex`` library; a draw from the document's id
picks where the prefix and the middle end and which form the text takes:

* ``plain``: the text as it is;
* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle;
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle.

A text that holds one of the three marks stays plain, so the marks of an output are the only
ones in it and :func:`restore` gives the exact text back.  The work is a pandas UDF over Arrow
batches: the ends of the units lie in an array of 32-bit numbers, two lookups in it give the cuts.

Null texts count as empty and stay plain.  A null id draws as the empty text.  Repeated rows draw
alike; an empty table gives no rows.  Texts of any length are cut whole, 4 bytes for each unit.
"""

import hashlib
import struct
from array import array
from operator import methodcaller

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import free_name

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: One code point; other units are, for example, ``\X`` (graphemes) or ``\w+|\W``.
CODE_POINT = "(?s)."
_end = methodcaller("end")


def unit_ends(text: str, unit: "regex.Pattern") -> array:
    """Where each unit of the text ends."""
    return array("I", map(_end, unit.finditer(text)))


def draws(key: str, seed: str) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the seed and the id."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{key}".encode()).digest()[:16])


def rearrange(text: str, key: str, unit: "regex.Pattern", seed: str, whole: int, swapped: int) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, prefix_chars, middle_chars, output)`` of one text."""
    ends = unit_ends(text, unit)
    n = len(ends)
    h1, h2, h3, h4 = draws(key, seed)
    if not n or h3 % 100 >= whole or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[low - 1] if low else 0), (ends[high - 1] if high else 0)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = MARKS
    if h4 % 100 < swapped:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output of :func:`rearrange` was made from."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = "1", whole: int = 90, swapped: int = 20, name: str = "fim") -> DataFrame:
    """``docs`` with a struct ``name`` of ``n, form, prefix_chars, middle_chars, output``.

    Of 100 texts about ``whole`` are rearranged, of 100 such ``swapped`` with the suffix first.
    Where ``docs`` has a column of that name, underscores are put before it.
    """

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string")
    def rearranged(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        pattern = regex.compile(unit)
        rows = [rearrange(t or "", k or "", pattern, seed, whole, swapped) for t, k in zip(texts, keys, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64", "form": object, "output": object})

    return docs.withColumn(free_name(docs.columns, name), rearranged(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("string")))


def digests(output: Column, form: Column) -> Column:
    """A struct of the sha256 of an output and of the text restored from it, in hexadecimal."""

    @F.pandas_udf("output_sha256 string, restored_sha256 string")
    def hashed(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        sha = lambda text: hashlib.sha256(text.encode("utf-8")).hexdigest()
        rows = [(sha(o), sha(restore(o, f))) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame(rows, columns=["output_sha256", "restored_sha256"], dtype=object)

    return hashed(output, form)
