"""How many links each set of a class has: T-occurrence search of every set against the inverted lists of its class.

All links of a set lie in its class, so this finds every link of the corpus. A class is cut into blocks of bounded
size, every pair of blocks is searched in one task, and only counts come out, so a large group of near copies is
neither held by one task nor expanded into pairs.

The lists of a block are its shingles' members. Shingles with the same members are one list. A search of a set counts
how often each member occurs in the lists of the set's shingles. The short lists are merged; members that can't reach
the required overlap even with all long lists are dropped; the others are looked up in the long lists (DivideSkip).
A list with more than half of the block is long and is stored as the members that it lacks: either these are probed
by binary search for each member left, or, where that is more work than reading them, merged with a minus sign.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import frugal_group, mix64, ragged

#: Most sets and bytes of a block; a single set may be larger.
BLOCK_SETS, BLOCK_BYTES = 2048, 1 << 24
#: Sets of small classes that are searched in one group of rows, about.
GROUP_SETS = 1024


class Lists:
    """Inverted lists of some sets; sets are numbered in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(tokens, kind="stable")  # members ascend within a list
        tokens, owner = tokens[order], owner[order]
        heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        self.tokens = tokens[heads]
        lengths = np.diff(np.append(heads, len(tokens)))
        marks = mix64(owner.astype(np.uint64) + np.uint64(1))
        name = np.stack((np.add.reduceat(marks, heads), np.add.reduceat(mix64(marks), heads)), axis=1)
        _, first, self.pattern = np.unique(name, axis=0, return_index=True, return_inverse=True)  # equal members, equal sums
        self.pattern = self.pattern.ravel()
        starts, lengths = heads[first], lengths[first]
        self.long = lengths * 2 > self.n
        kept = [owner[ragged(starts[~self.long], lengths[~self.long])]]
        held = np.where(self.long, self.n - lengths, lengths)
        for k in np.flatnonzero(self.long).tolist():
            lacks = np.ones(self.n, bool)
            lacks[owner[starts[k] : starts[k] + lengths[k]]] = False
            kept.append(np.flatnonzero(lacks))
        place = np.concatenate((np.flatnonzero(~self.long), np.flatnonzero(self.long)))
        self.members, self.lengths = np.concatenate(kept), held
        self.starts = np.empty(len(held), np.int64)
        self.starts[place] = np.cumsum(held[place]) - held[place]

    def search(self, probe: np.ndarray, required) -> np.ndarray:
        """Numbers of the sets whose overlap with the probe reaches ``required(their sizes, its size)``."""
        at = np.minimum(np.searchsorted(self.tokens, probe), len(self.tokens) - 1)
        patterns, weights = np.unique(self.pattern[at[self.tokens[at] == probe]], return_counts=True)
        needed = required(self.sizes, len(probe))
        long = self.long[patterns]
        counts = self._merged(patterns[~long], weights[~long])
        rest = int(weights[long].sum())
        alive = np.flatnonzero(counts + rest >= needed)
        patterns, weights = patterns[long], weights[long]
        if not len(alive) or not len(patterns):
            return alive
        held = int(self.lengths[patterns].sum())
        if len(alive) * len(patterns) * np.log2(self.n + 2) < held:
            lacking = sum(w * self._among(p, alive) for p, w in zip(patterns.tolist(), weights.tolist()))
        else:
            lacking = self._merged(patterns, weights)[alive]
        return alive[counts[alive] + rest - lacking >= needed[alive]]

    def _merged(self, patterns: np.ndarray, weights: np.ndarray) -> np.ndarray:
        lengths = self.lengths[patterns]
        found = self.members[ragged(self.starts[patterns], lengths)]
        return np.bincount(found, np.repeat(weights, lengths), self.n).astype(np.int64)

    def _among(self, pattern: int, alive: np.ndarray) -> np.ndarray:
        own = self.members[self.starts[pattern] : self.starts[pattern] + self.lengths[pattern]]
        if not len(own):
            return np.zeros(len(alive), bool)
        at = np.searchsorted(own, alive)
        return own[np.minimum(at, len(own) - 1)] == alive


def _searched(required):
    """Link counts of the sets in one group of rows: whole small classes, or two blocks of a large one."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("class", "ascending"), ("block", "ascending"), ("key", "ascending")])
        classes, blocks = group["class"].to_numpy(), group["block"].to_numpy()
        keys, copies, bodies = group["key"].to_numpy(), group["copies"].to_numpy(), group["body"].combine_chunks()
        counts = np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], (classes[1:] != classes[:-1]) | (blocks[1:] != blocks[:-1]), [True]))).tolist()
        parts = list(zip(cuts[:-1], cuts[1:]))
        body = lambda i: np.frombuffer(bodies[i].as_buffer(), np.uint64)
        if group["other"][0].as_py() >= 0 and len(parts) == 2:  # two blocks: links across only, of both sides
            (a, b), (c, d) = parts
            lists = Lists([body(i) for i in range(c, d)])
            for i in range(a, b):
                found = c + lists.search(body(i), required)
                counts[i] += copies[found].sum()
                counts[found] += copies[i]
        elif group["other"][0].as_py() < 0:
            for a, b in parts:
                lists = Lists([body(i) for i in range(a, b)])
                for i in range(a, b):
                    counts[i] = copies[a + lists.search(body(i), required)].sum() - copies[i]
        own = np.flatnonzero(counts)
        return pa.table([pa.array(keys[own]), pa.array(counts[own])], ["key", "links"])

    return run


def link_counts(members: DataFrame, required) -> DataFrame:
    """``(key, links)`` of ``members(class, key, copies, body)``: the copies of all other sets that overlap enough.

    ``body`` holds the ascending 64-bit shingles of a set, ``required(sizes, size)`` the least overlap. Sets without a
    link may be left out; a set whose links come from several pairs of blocks has several rows.
    """
    sizes = members.groupBy("class").agg(F.count("*").alias("sets"), F.sum(F.length("body")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    sized = members.join(sizes.where("sets > 1").select("class", blocks.alias("blocks")), "class")
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = sized.select("class", "key", "copies", "body", "blocks", block.alias("block"))
    # A block meets every other one of its class and, with ``other`` -1, itself; small classes share a group of rows.
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.when(o == F.col("block"), F.lit(-1)).otherwise(o))
    dealt = placed.select("class", "key", "copies", "body", "blocks", "block", F.explode(meets).alias("other"))
    small = F.col("blocks") == 1
    low = F.when(F.col("other") < 0, F.col("block")).otherwise(F.least("block", "other"))
    high = F.when(F.col("other") < 0, F.lit(-1)).otherwise(F.greatest("block", "other"))
    total = members.count()
    bucket = F.when(small, F.pmod(F.xxhash64("class"), F.lit(max(1, total // GROUP_SETS)))).otherwise(F.col("class"))
    dealt = dealt.select("class", "key", "copies", "body", "block", "other", small.alias("small"), bucket.alias("of"), low.alias("low"), high.alias("high"))
    return dealt.groupBy("small", "of", "low", "high").applyInArrow(frugal_group(_searched(required)), "key long, links long")
