"""Documents packed into containers of fixed token capacity (problem 8).

The cost of a sequence is linear plus quadratic in its documents' tokens, as attention is. Documents are
taken in descending order of size and given to the sequence of lowest cost that has room; where none has,
a sequence is opened. A document larger than the capacity fills whole containers and its rest is packed.

Documents are packed in shards of about `SHARD_ITEMS` items, each by one task for each window, so that the
work spreads over any cluster. Only the last containers of a shard are less full, which costs at most
about one container in a shard.

Defined results: null and empty texts take no room and are placed like others; equal sizes are taken in
the order of doc_id; a repeated document is packed as often as it occurs; windows without a positive
capacity get no containers; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents of one shard, about.
SHARD_ITEMS = 20_000
#: Cost of a document of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Most rows of the table of windows.
MAX_WINDOWS = 1_000

OUT = "window_name string, shard int, container int, doc_id bigint, part int, first_token bigint, n_tokens bigint"
_ARROW = pa.schema([("window_name", pa.string()), ("shard", pa.int32()), ("container", pa.int32()), ("doc_id", pa.int64()), ("part", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64())])


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, for items in descending order of size, none above the capacity.

    A sequence is opened only where none has room: many open ones would share out small items evenly and
    leave a little room in each, too little for any.
    """
    room, cost, n = np.full(16, -1, dtype=np.int64), np.full(16, np.inf), 0
    out = np.empty(len(sizes), dtype=np.int32)
    for k, size in enumerate(sizes.tolist()):
        best = int(np.argmin(np.where(room[:n] >= size, cost[:n], np.inf))) if n else 0
        if not n or room[best] < size:
            if n == len(room):
                room, cost = np.concatenate([room, np.full(n, -1)]), np.concatenate([cost, np.full(n, np.inf)])
            best, room[n], cost[n] = n, capacity, 0.0
            n += 1
        room[best] -= size
        cost[best] += LINEAR * size + QUADRATIC * size * size
        out[k] = best
    return out


def _pack() -> Callable[[pa.Table], pa.Table]:
    def run(part: pa.Table) -> pa.Table:
        name, shard, capacity = (part.column(c)[0].as_py() for c in ("window_name", "shard", "capacity"))
        ids, n = part.column("doc_id"), part.column("n_tokens").to_numpy()
        order = np.lexsort((ids.fill_null(-(2**63)).to_numpy(), -n))
        ids, n = ids.take(pa.array(order)), n[order]
        doc = np.arange(len(n))  # places in the sorted table; ids may be null
        whole = np.where(n > capacity, n // capacity, 0)  # containers that a large document fills alone
        rest = n - whole * capacity
        # Full containers come first, then the packed rests; a document that fills its containers exactly has no rest.
        full_doc, full_part = np.repeat(doc, whole), np.concatenate([np.arange(w) for w in whole[whole > 0]]) if whole.any() else np.empty(0, np.int64)
        keep = (rest > 0) | (whole == 0)
        again = np.lexsort((doc[keep], -rest[keep]))
        r_doc, r_size, r_whole = doc[keep][again], rest[keep][again], whole[keep][again]
        where = assign(r_size, capacity) + len(full_doc)
        m = len(full_doc) + len(r_doc)
        columns = [
            pa.array([name] * m), pa.array([shard] * m, pa.int32()), pa.array(np.concatenate([np.arange(len(full_doc)), where]).astype(np.int32)),
            ids.take(pa.array(np.concatenate([full_doc, r_doc]).astype(np.int64))).combine_chunks(), pa.array(np.concatenate([full_part, r_whole]).astype(np.int32)),
            pa.array(np.concatenate([full_part * capacity, r_whole * capacity]).astype(np.int64)), pa.array(np.concatenate([np.full(len(full_doc), capacity), r_size]).astype(np.int64)),
        ]
        return pa.Table.from_arrays(columns, schema=_ARROW)

    return run


def pack(sizes: DataFrame, windows: DataFrame, n_items: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Every part of every document with its container, for each window.

    `windows` is a small fixed table of capacities; more than MAX_WINDOWS rows are refused. `n_items` is the
    number of documents, which parquet footers give without reading texts; the number of shards follows it.
    """
    fixed = windows.where(F.col("capacity") > 0).select("window_name", F.col("capacity").cast("bigint").alias("capacity")).distinct().limit(MAX_WINDOWS + 1).collect()
    if len(fixed) > MAX_WINDOWS:
        raise ValueError(f"more than {MAX_WINDOWS} windows")
    shards = max(1, -(-n_items // shard_items))
    shard = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("n_tokens"))), F.lit(shards)).cast("int").alias("shard")
    each = F.array(*[F.struct(F.lit(w.window_name).alias("window_name"), F.lit(w.capacity).alias("capacity")) for w in fixed])
    if not fixed:
        return sizes.sparkSession.createDataFrame([], OUT)
    items = sizes.select("doc_id", "n_tokens", shard, F.explode(each).alias("w")).select("w.window_name", "w.capacity", "shard", "doc_id", "n_tokens")
    return items.groupBy("window_name", "shard").applyInArrow(_pack(), OUT)


def utilisation(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers, documents, tokens and the share of room in use, by window."""
    per = packed.groupBy("window_name", "shard", "container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("parts"))
    total = per.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("parts").alias("parts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    joined = total.join(F.broadcast(windows.select("window_name", "capacity")), "window_name")
    return joined.withColumn("share_used", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 4))
