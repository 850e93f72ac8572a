"""Characters by their compatibility decomposition, as expressions: what of a text is ASCII once accents, ligatures and forms are taken apart.

The table is built from the decompositions of Unicode itself, as Python's `unicodedata` has them; it is made once on the driver and is part of the plan.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _table() -> tuple[tuple[str, str], dict[str, str]]:
    """Characters that have one ASCII character and what it is, in two texts; and those that have several."""
    single, several = {}, {}
    for n in range(128, sys.maxunicode + 1):
        c = chr(n)
        if unicodedata.decomposition(c):
            plain = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
            (single if len(plain) == 1 else several)[c] = plain
    return ("".join(single), "".join(single.values())), {c: p for c, p in several.items() if p}


def ascii_folded(c: Column) -> Column:
    """The ASCII characters of a text's compatibility decomposition (NFKD), in order; what has none goes. Null stays null.

    Texts of ASCII alone stay as they are; characters that become one are exchanged at once. Of those that become several, each that a text holds is exchanged throughout it; what is left then goes.
    """
    (of, to), several = _table()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))

    def folded(text: Column) -> Column:
        left = F.regexp_replace(text, r"[\x00-\x7F]+", "")
        return once(left, lambda odd: F.when(odd == "", text).otherwise(F.regexp_replace(F.when(F.translate(odd, "".join(several), "") == odd, text).otherwise(spread(text, odd)), r"[^\x00-\x7F]+", "")))

    def spread(text: Column, odd: Column) -> Column:
        return F.aggregate(F.array_distinct(F.split(odd, "")), text, lambda done, x: once(F.try_element_at(table, x), lambda plain: F.when(plain.isNull(), done).otherwise(F.replace(done, x, plain))))

    return F.when(F.regexp_like(c, F.lit(r"[^\x00-\x7F]")), once(F.translate(c, of, to), folded)).otherwise(c)
