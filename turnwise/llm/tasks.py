"""Running a function over the texts of a table, inside Spark tasks, chunk by chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from turnwise.llm.words import chunks

Step = Callable[[pa.Array], Sequence[pa.Array]]


def annotate(docs: DataFrame, text: str, begin: Callable[[], Step], fields: str, keep: Iterable[str] | None = None) -> DataFrame:
    """Columns made from each text, beside a struct ``row`` of the input's own columns (``keep``: all by default).

    ``begin`` is called once in a task and returns a function from a text array to one array for each of ``fields``
    (a DDL string). The input's columns stay inside ``row``, so names never clash; the order of rows stays."""
    keep = list(docs.columns if keep is None else keep)
    quoted = [f"`{c}`" for c in keep]
    source = docs.select(F.struct(*[docs[c] for c in quoted]).alias("row"), docs[f"`{text}`"].alias("text"))
    added = StructType.fromDDL(fields)
    schema = StructType([StructField("row", source.schema["row"].dataType), *added.fields])
    names = ["row", *added.names]

    def run(batches):
        step = begin()
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("row"), *step(part.column("text"))], names)

    return source.mapInArrow(run, schema)
