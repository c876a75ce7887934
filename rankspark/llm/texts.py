"""Words of a text, alike in every operator: ASCII capitals are lowered, other letters are left as they are."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

#: Rows of an Arrow batch that are turned into Python values at a time.
SLICE = 1000

#: Digits, small letters and everything outside ASCII; applied to lower-cased UTF-8.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else; null is empty."""
    return text.encode("utf-8").lower() if text else b""


def words(text: str | None) -> list[bytes]:
    return WORD.findall(lowered(text))


def tokens(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return lowered(text).split()


#: Spark type -> Arrow type of the columns that ``add_columns`` can make.
_ARROW = {"long": "int64", "int": "int32", "double": "float64", "string": "string", "binary": "binary", "boolean": "bool"}
_ARRAYS = {"array<string>": ("string", StringType()), "array<long>": ("int64", LongType())}


def _arrow_type(name: str):
    import pyarrow as pa
    return pa.list_(pa.type_for_alias(_ARRAYS[name][0])) if name in _ARRAYS else pa.type_for_alias(_ARROW[name])


def add_columns(df: DataFrame, new: dict[str, str], read: list[str], make: Callable[[], Callable]) -> DataFrame:
    """``df`` with the ``new`` columns (name -> type; one of the same name is replaced), made from the columns ``read``.

    ``make`` is called once a task and returns a function from lists of values, one per column read, to a tuple of lists,
    one per new column.  The other columns pass through as Arrow arrays, so their values are not touched.
    """
    kept = [c for c in df.columns if c not in new]
    types = [_arrow_type(t) for t in new.values()]

    def run(batches):
        import pyarrow as pa
        values = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = values(*[part.column(c).to_pylist() for c in read])
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [pa.array(v, t) for v, t in zip(made, types, strict=True)],
                                                 [*kept, *new])
    out = StructType([df.schema[c] for c in kept])
    for name, kind in new.items():
        out = out.add(name, ArrayType(_ARRAYS[kind][1]) if kind in _ARRAYS else kind)
    return df.mapInArrow(run, out)
