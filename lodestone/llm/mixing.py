"""Mixing sources to target weights (problem 9): cube-method balanced sampling."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.common import blank_trim, cut, one_row
from lodestone.llm.tokens import token_counts

BLOCK = 4096  #: documents of one source that go through a flight together
ROUNDS = 3  #: flights; the last has one block a source, of at most BLOCK documents for sources of up to 17 billion
SPREAD = 512  #: undecided documents among which a step looks for its direction, at most


def flight(probabilities: np.ndarray, sizes: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move inclusion probabilities until at most two are neither 0 nor 1.

    A step moves along the null space of the two constraints, the number and the size of
    what is chosen, so both totals stand still. It goes as far as one unit reaches 0 or 1,
    to the side that a fair draw picks, so that expected values don't change. The
    direction is the one that moves the largest undecided unit most in proportion to all
    others: its unit vector without its part outside the null space, over the largest and
    the smallest undecided units. Large units are thus decided first, while there are
    smaller ones to make up for them, and what is left are small ones.
    """
    p, eps = np.array(probabilities, float), 1e-9
    p[p < eps], p[p > 1 - eps] = 0, 1
    open_ = np.flatnonzero((p > 0) & (p < 1))
    open_ = open_[np.argsort(-sizes[open_], kind="stable")]
    while len(open_) > 2:
        half = SPREAD // 2
        some = open_ if len(open_) <= SPREAD else np.concatenate([open_[:half], open_[-half:]])
        s = sizes[some].astype(float)
        s = s / max(np.abs(s).max(), 1e-9)
        bounds = np.stack([np.ones(len(some)), s - s.mean()])
        if (bounds[1] == 0).all():
            bounds = bounds[:1]
        for at in range(len(some)):  # the largest unit that can move at all
            u = -(bounds.T @ (bounds[:, at] / (bounds**2).sum(1)))
            u[at] += 1
            if abs(u[at]) > 1e-9:
                break
        moves = np.abs(u) > 1e-12
        units, u = some[moves], u[moves]
        up = np.where(u > 0, (1 - p[units]) / np.abs(u), p[units] / np.abs(u)).min()
        down = np.where(u > 0, p[units] / np.abs(u), (1 - p[units]) / np.abs(u)).min()
        p[units] = np.clip(p[units] + (up if rng.random() * (up + down) < down else -down) * u, 0, 1)
        p[p < eps], p[p > 1 - eps] = 0, 1
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def land(probabilities: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Decide the last two undecided units: of all draws that keep both probabilities the one in
    which their number, and with it their size, varies least."""
    p = np.array(probabilities, float)
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_) == 2:
        a, b = open_
        both, draw = max(0.0, p[a] + p[b] - 1), rng.random()
        pa_, pb = p[a], p[b]
        p[a] = float(draw < pa_)
        p[b] = float(draw < both or pa_ <= draw < pa_ + pb - both)
    elif len(open_) == 1:
        p[open_] = float(rng.random() < p[open_[0]])
    return p


class Mix:
    """A mixture of ``documents`` by ``targets`` (source, target_share, max_repeats).

    Sources compare trimmed and in lower case. T is the tokens of all documents of a
    target source, each once; a source is to give share * T tokens, its documents at most
    max_repeats times. With r = min(share * T / own tokens, max_repeats) every document
    is taken floor(r) times, and once more with probability r - floor(r), by the cube
    method balanced on the number and the tokens of documents. Null and empty texts have
    no tokens and are never taken; documents of other or null sources are left out; a
    target without documents reaches a share of 0. Shares are reported against all tokens
    chosen and against T: where some sources are too small for their share, the others
    keep theirs of T and make up more of what is chosen.

    Documents of a source are cut into blocks of about 4,096 by a hash; each block ends
    with at most two undecided documents. These go through further flights, again in blocks,
    until one block a source is left, whose last two land: one landing a source, of two
    small documents. No probability is changed but by flights and that landing.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 1, **tokenizer: str):
        source = F.lower(blank_trim(F.col("source")))
        self.key, self.seed = key, seed
        self.targets = targets.select(F.lower(blank_trim(F.col("source"))).alias("source"), "target_share", "max_repeats")
        named = documents.filter(F.octet_length("text") > 0).select(key, source.alias("source"), "text").join(self.targets.select("source"), "source", "left_semi")
        self.sizes = cut(token_counts(named, [key, "source"], "text", **tokenizer).filter("tokens > 0"))
        own = self.sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("own_tokens"))
        everything = own.agg(F.sum("own_tokens").alias("all_tokens"))
        plan = self.targets.join(own, "source", "left").withColumn("all_tokens", one_row(everything)["all_tokens"]).na.fill(0, ["documents", "own_tokens", "all_tokens"])
        wanted, most = F.col("target_share") * F.col("all_tokens"), F.col("max_repeats") * F.col("own_tokens")
        rate = F.when(F.col("own_tokens") > 0, F.least(wanted, most.cast("double")) / F.col("own_tokens")).otherwise(F.lit(0.0))
        self.plan = cut(plan.select("*", wanted.alias("wanted_tokens"), (wanted > most).alias("capped"), rate.alias("rate")))  # a row a target

    def chosen(self) -> DataFrame:
        """key, source, tokens, copies: the documents taken at least once."""
        key, seed = self.key, self.seed
        plan = F.broadcast(self.plan.select("source", "documents", "rate"))
        rows = self.sizes.join(plan, "source").withColumn("base", F.floor("rate").cast("int"))
        rows = rows.withColumn("p", F.col("rate") - F.col("base"))
        undecided = rows.select(key, "source", "tokens", "documents", "base", "p")
        fields = undecided.schema
        decided = None
        for n in range(ROUNDS):
            # a block leaves at most two of its documents to the next round; the last has one block
            left = F.col("documents") * (2.0 / BLOCK) ** n
            blocks = F.greatest(F.ceil(left / BLOCK), F.lit(1)).cast("long") if n < ROUNDS - 1 else F.lit(1).cast("long")

            flown = cut(undecided.withColumn("block", F.pmod(F.xxhash64(key, F.lit(seed + n)), blocks)).groupBy("source", "block").applyInArrow(self._flight(n), fields))
            done = flown.filter("p = 0 or p = 1")
            decided = done if decided is None else decided.unionByName(done)
            undecided = flown.filter("p > 0 and p < 1")
        return decided.select(key, "source", "tokens", (F.col("base") + F.col("p").cast("int")).alias("copies")).filter("copies > 0")

    def _flight(self, n: int) -> Callable[[tuple, pa.Table], pa.Table]:
        """The n-th flight of a block, the last one with its landing."""
        key, seed = self.key, self.seed

        def work(keys: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by([("tokens", "descending"), (key, "ascending")])
            rng = np.random.default_rng([seed, n, *"/".join(str(k.as_py()) for k in keys).encode()])
            p = flight(t.column("p").to_numpy(), t.column("tokens").to_numpy(), rng)
            p = land(p, rng) if n == ROUNDS - 1 else p
            return t.drop_columns("block").set_column(t.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))

        return work

    def report(self) -> DataFrame:
        """source, target_share, documents, own_tokens, wanted_tokens, capped, chosen_documents, max_copies,
        chosen_tokens, actual_share, share_of_budget, deviation: chosen tokens over what the rates
        promise, in parts of the wanted ones."""
        mine = self.chosen().groupBy("source").agg(F.count("*").alias("chosen_documents"), F.max("copies").alias("max_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("chosen_tokens"))
        rows = self.plan.join(mine, "source", "left").na.fill(0, ["chosen_documents", "max_copies", "chosen_tokens"])
        total = mine.agg(F.sum("chosen_tokens").alias("total"))
        share = F.coalesce(F.col("chosen_tokens") / F.col("total"), F.lit(0.0))
        of_budget = F.coalesce(F.col("chosen_tokens") / F.nullif("all_tokens", F.lit(0)), F.lit(0.0))
        off = F.coalesce((F.col("chosen_tokens") - F.col("rate") * F.col("own_tokens")) / F.nullif("wanted_tokens", F.lit(0.0)), F.lit(0.0))
        rows = rows.withColumn("total", one_row(total)["total"])
        return rows.select("source", "target_share", "max_repeats", "documents", "own_tokens", "wanted_tokens", "capped", "chosen_documents", "max_copies", "chosen_tokens", F.round(share, 6).alias("actual_share"), F.round(of_budget, 6).alias("share_of_budget"), F.round(off, 6).alias("deviation"))
