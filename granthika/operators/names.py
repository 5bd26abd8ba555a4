"""Which of many names a text holds, found in one pass over the text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names that one automaton may hold; more are refused, never cut.
MOST_NAMES = 100_000


def holding(rows: DataFrame, texts: list[str], names: DataFrame, id_: str, name: str) -> DataFrame:
    """The rows with `held`, the ids of the names that one of the columns `texts` contains, as they are written.

    The number of names is checked before they reach the driver and the tasks; ValueError beyond MOST_NAMES.
    Null and empty names are in no text. The result has no order inside `held`.
    """
    known = names.where(F.length(name) > 0).select(F.col(id_).alias("id"), F.col(name).alias("name"))
    listed = known.limit(MOST_NAMES + 1).collect()
    if len(listed) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    by_name: dict[str, list[int]] = {}
    for r in listed:
        by_name.setdefault(r.name, []).append(r.id)
    shared = rows.sparkSession.sparkContext.broadcast(by_name)
    width = len(rows.columns)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for k, ids in shared.value.items():
            automaton.add_word(k, ids)
        automaton.make_automaton()
        for batch in batches:
            held = []
            for each in zip(*(batch.column(width + i).to_pylist() for i in range(len(texts))), strict=True):
                held.append(sorted({i for t in each if t and shared.value for _, ids in automaton.iter(t) for i in ids}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(held, pa.list_(pa.int64()))], [*batch.schema.names[:width], "held"])

    searched = rows.select("*", *[F.expr(t).alias(f"_searched{i}") for i, t in enumerate(texts)])
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return searched.mapInArrow(find, f"{kept}, held array<bigint>")
