"""The working copy of a text: composed characters, folded digits, dashes and currency signs, no stray joiners."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and what they are folded to; all others stay.
FOLDED = {**{chr(0xFF10 + i): str(i) for i in range(10)}, **dict.fromkeys("‐‑‒–—―−﹘﹣－", "-"), "₨": "₹", "﹩": "$", "＄": "$", "￠": "¢", "￡": "£", "￥": "¥", "￦": "₩"}
_VIRAMAS = "्্੍્୍்్್്"
_NUKTA_BASES = "ਫਜਗਖਸ"


def composed(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; texts of ASCII only never reach Python."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([None if t is None else unicodedata.normalize(form, t) for t in column.to_pylist()], pa.string())

    return F.coalesce(F.arrow_udf(run, "string")(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


def working_copy(text: Column) -> Column:
    folded = F.translate(composed(text), "".join(FOLDED), "".join(FOLDED.values()))
    plain = F.regexp_replace(folded, f"(?<=[{_NUKTA_BASES}])਼", "")
    return F.regexp_replace(plain, f"(?<![{_VIRAMAS}])[‌‍]", "")
