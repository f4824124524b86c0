"""Filling fixed-capacity windows with documents (problem 8): vector bin packing."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import cut, one_row
from lodestone.llm.tokens import token_counts

GROUP = 4096  #: items that are packed together
PER_SEGMENT = 16  #: a window has room for one segment per so many tokens of capacity
LEAST_SEGMENTS = 8  #: but for at least so many


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Window number of every item (rows of ``sizes``: tokens, segments, loss tokens).

    One window is open at a time. Of the items that fit under all limits the one with the
    largest dot product of its sizes and the window's free room, each in parts of the
    limit, goes in: items long in the dimension that is still free come first, and the
    last gaps get the largest item that they can hold. An item that exceeds a limit by
    itself gets a window of its own.
    """
    sizes = sizes / limits
    order = np.argsort(-sizes[:, 0], kind="stable")
    left = sizes[order]
    names, window = order.copy(), np.full(len(sizes), -1)
    current, room = 0, np.ones(sizes.shape[1])
    fresh, eps = True, 1e-9
    whole = int(np.searchsorted(-left[:, 0], -(1 - eps), "right"))  # these fill a window each
    window[names[:whole]], current, left, names = np.arange(whole), whole, left[whole:], names[whole:]
    while len(left):
        # items are in descending token size: all that can fit lie behind the first that does
        first = int(np.searchsorted(-left[:, 0], -(room[0] + eps)))
        tail = left[first:]
        fits = (tail <= room + eps).all(1)
        if fits.any():
            score = np.where(fits, tail @ room, -1.0)
            pick = first + int(score.argmax())
        elif fresh:
            pick = 0
        else:
            current, room, fresh = current + 1, np.ones(sizes.shape[1]), True
            continue
        window[names[pick]] = current
        room, fresh = np.maximum(room - left[pick], 0), False
        left, names = np.delete(left, pick, 0), np.delete(names, pick)
    return window


def limits_of(capacity: int, loss_part: float, per_segment: int, least_segments: int) -> list[float]:
    """A window's limits: tokens, segments, loss-bearing tokens."""
    return [capacity, max(least_segments, capacity // per_segment), max(1.0, capacity * loss_part)]


def pack(documents: DataFrame, limits: DataFrame, key: str = "doc_id", text: str = "text", loss_part: float = 1.0, per_segment: int = PER_SEGMENT, least_segments: int = LEAST_SEGMENTS, group: int = GROUP, **tokenizer: str) -> DataFrame:
    """A row per placed piece: pack_id, window, key, piece, pieces, start_token, tokens, loss_tokens.

    ``limits`` has pack_id and capacity_tokens (a small table that doesn't grow). Windows
    hold at most capacity_tokens tokens, one segment per ``per_segment`` tokens of capacity
    (at least ``least_segments``), and ``loss_part`` of the capacity in loss-bearing tokens,
    all tokens but those of a document's first line. A document larger than the capacity is
    cut into pieces of the capacity and a rest; no other document is split. A piece that
    exceeds another limit by itself gets a window of its own. Null and empty texts are not
    placed. Documents given twice are placed twice.

    Pieces are spread over groups of about 4,096 by a hash and packed group by group, each
    wasting at most its last window, so the space left doesn't grow with the input.
    """
    sizes = cut(token_counts(documents.filter(F.octet_length(text) > 0), [key], text, head=True, **tokenizer))
    capacity = F.col("capacity_tokens")
    asked = one_row(limits.agg(F.collect_list(F.struct("pack_id", "capacity_tokens")).alias("all")))["all"]  # a few capacities
    rows = sizes.filter("tokens > 0").withColumn("_asked", asked).select(key, "tokens", "head_tokens", F.inline("_asked"))
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    counts = rows.groupBy("pack_id").agg(F.greatest(F.round(F.sum(n) / group), F.lit(1)).cast("int").alias("groups"))  # a row a capacity
    rows = rows.join(F.broadcast(counts), "pack_id")
    rows = rows.select("pack_id", "groups", "capacity_tokens", key, "tokens", "head_tokens", n.alias("pieces"), F.posexplode(F.sequence(F.lit(1), n)).alias("piece", "_")).drop("_")
    start = F.col("piece") * capacity
    rows = rows.select("*", start.alias("start_token"), F.least(capacity, F.col("tokens") - start).alias("size")).withColumn("loss", F.greatest(F.col("size") - F.greatest(F.col("head_tokens") - F.col("start_token"), F.lit(0)), F.lit(0)))
    kept = rows.select("pack_id", F.pmod(F.xxhash64(key, "piece"), F.col("groups")).cast("int").alias("grp"), "capacity_tokens", key, "piece", "pieces", "start_token", "size", "loss")
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def place(keys: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([(key, "ascending"), ("piece", "ascending")])
        size, loss = t.column("size").to_numpy(), t.column("loss").to_numpy()
        most = limits_of(t.column("capacity_tokens")[0].as_py(), loss_part, per_segment, least_segments)
        window = fill(np.stack([size, np.ones(len(size)), loss], 1).astype(float), np.array(most, float))
        names = pa.array([f"{keys[1].as_py()}-{w}" for w in window])
        return pa.table([t.column("pack_id"), names, *[t.column(c) for c in (key, "piece", "pieces", "start_token", "size", "loss")]], names=["pack_id", "window", key, "piece", "pieces", "start_token", "tokens", "loss_tokens"])

    schema = f"pack_id string, window string, `{key}` {types[key]}, piece int, pieces int, start_token long, tokens long, loss_tokens long"
    return kept.groupBy("pack_id", "grp").applyInArrow(place, schema)


def binding(packed: DataFrame, limits: DataFrame, loss_part: float, per_segment: int = PER_SEGMENT, least_segments: int = LEAST_SEGMENTS) -> DataFrame:
    """pack_id, windows, by_tokens, by_segments, by_loss: windows that use 99 % of a limit or more,
    and over: windows of several pieces that exceed one, of which there are none."""
    capacity = F.col("capacity_tokens")
    windows = packed.groupBy("pack_id", "window").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("segments"), F.sum("loss_tokens").alias("loss")).join(limits.select("pack_id", "capacity_tokens"), "pack_id")
    most = {"tokens": capacity, "segments": F.greatest(F.lit(least_segments), F.floor(capacity / per_segment)), "loss": F.greatest(F.lit(1.0), capacity * loss_part)}
    over = F.lit(False)
    for c, limit in most.items():
        over = over | (F.col(c) > limit + 1e-6)
    return windows.groupBy("pack_id").agg(F.count("*").alias("windows"), *[F.count_if(F.col(c) >= 0.99 * limit).alias(f"by_{c}") for c, limit in most.items()], F.count_if(over & (F.col("segments") > 1)).alias("over"))


def usage(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """pack_id, windows, pieces, tokens, filled: the part of all windows' space in use."""
    windows = packed.groupBy("pack_id", "window").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    totals = windows.groupBy("pack_id").agg(F.count("*").alias("windows"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"))
    share = F.col("tokens") / (F.col("windows") * F.col("capacity_tokens"))
    return totals.join(limits, "pack_id").select("pack_id", "capacity_tokens", "windows", "pieces", "tokens", F.round(share, 6).alias("filled"))


