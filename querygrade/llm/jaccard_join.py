"""N-gram Jaccard join: documents whose word-shingle sets are similar, by T-occurrence search with DivideSkip.

Steps, each over all documents:

1. Document frequencies of all shingles, counted in packed, bucketed blocks. Only the order of shingles
   depends on them (frequent ones last), never a result.
2. Inverted lists of each set's rarest quarter plus one: two sets of the wanted similarity share a shingle
   there. Lists of one set go; sets with the same elements have one key, so copies count once.
3. T-occurrence search: in every list all sets are paired with one hub, with another hub for the sets still
   in different classes, and so on; then all pairs that still lie in different classes are searched. Pairs pass the bounds on size and on position in the list first. A probe
   merges its short lists, keeps the sets that occur often enough without the long ones, and looks those up
   in the long lists by binary search.
4. Connected classes of the links.
5. T-occurrence search of every set against all lists of its class (:mod:`querygrade.llm.jaccard_links`), which counts
   all links: both ends of a link lie in one class.

No list is cut. Up to step 4 a large group of near copies costs few searches for each member, as pairs inside a class
are not searched again. Only frequencies of at most ``HOT_SHINGLES`` shingles and a filter of ``FILTER_BITS`` bits
are sent to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querygrade.llm.common import connected_classes, frugal, frugal_group, partitions_of, ragged, stored, text_slices, utf8_of
from querygrade.llm.jaccard_links import link_counts
from querygrade.llm.shingles import set_key, shingle_sets

#: Similarity of a link, as a fraction.
SHARE = (75, 100)
#: Most shingles whose frequency is sent to the executors (4 bytes each); the most frequent ones are taken.
HOT_SHINGLES = 1 << 21
#: Documents that must hold a shingle before it can count as frequent.
HOT_FROM = 16
#: Bits of the filter that names the sets with a possible partner.
FILTER_BITS = 1 << 26
#: Shingles gathered by a task before it deals them out to buckets.
FLUSH = 1_000_000
#: Sets of a list from which on it is long: its pairs are then made by turns of hubs and not all at once.
LONG_LIST = 64
#: Bits of the sketch that rules out pairs before their sets are compared.
SKETCH_BITS = 2048
#: Most turns with hubs before the pairs that are left, and fewer links than one in so many open sets that end them.
HUB_TURNS = 2
FEW_LINKS = 50
#: Most pairs whose keys are sent to all tasks to pick their sets (8 bytes each); beyond, all sets are joined.
SENT_KEYS = 1 << 18
#: DivideSkip's weight of probing against merging.
SKIP_WEIGHT = 0.01

_SHORT = np.uint64(0xFFFFFFFF)


def required(n_a, n_b):
    """Least overlap of two sets of these sizes that link: 100 * overlap >= 75 * union."""
    return -(-SHARE[0] * (n_a + n_b) // (SHARE[0] + SHARE[1]))


def prefix_length(n: int) -> int:
    return n - -(-SHARE[0] * n // SHARE[1]) + 1


def _bucketed(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _sets_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return shingle_sets(*utf8_of(batch.column(batch.schema.get_field_index("text"))))


def _frequency_blocks(buckets: int):
    """Sorted 32-bit shingle names by bucket, as differences; a few MB at a time."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens = np.concatenate(parts)
        where, short = _bucketed(tokens, buckets), tokens & _SHORT
        order = np.argsort((where.astype(np.uint64) << np.uint64(32)) | short)
        where, short = where[order], short[order].astype(np.uint32)
        bounds = np.searchsorted(where, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = short[bounds[b] : bounds[b + 1]]
            steps = np.diff(own)
            narrow = not len(steps) or steps.max() < 65536
            rows.append((b, int(own[0]), narrow, steps.astype(np.uint16 if narrow else np.uint32).tobytes()))
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3], pa.binary())], ["bucket", "first", "narrow", "steps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in text_slices(batches):
            own = [s for s in _sets_of(batch) if len(s)]
            parts += own
            held += sum(map(len, own))
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _frequent(group: pa.Table) -> pa.Table:
    """Shingles of one bucket that many documents hold, by power of two of their count."""
    parts = []
    for first, narrow, steps in zip(group["first"].to_pylist(), group["narrow"].to_pylist(), group["steps"].to_pylist()):
        delta = np.frombuffer(steps, np.uint16 if narrow else np.uint32).astype(np.int64)
        parts.append(first + np.concatenate(([0], np.cumsum(delta))))
    tokens = np.sort(np.concatenate(parts))
    heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.diff(np.append(heads, len(tokens)))
    level = np.log2(counts).astype(np.int32)
    bucket = group["bucket"][0].as_py()
    rows = [(lv, int((own := (level == lv)).sum()), tokens[heads[own]].astype(np.uint32).tobytes()) for lv in np.unique(level[counts >= HOT_FROM]).tolist()]
    return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int32()), "level": pa.array([r[0] for r in rows], pa.int32()), "shingles": pa.array([r[1] for r in rows], pa.int64()), "tokens": pa.array([r[2] for r in rows], pa.binary())})


def frequent_shingles(docs: DataFrame, buckets: int) -> np.ndarray:
    """Names ``bucket << 32 | short`` of the most frequent shingles, at most HOT_SHINGLES, sorted."""
    blocks = docs.select("text").mapInArrow(frugal(_frequency_blocks(buckets)), "bucket int, first long, narrow boolean, steps binary")
    found = stored(blocks.groupBy("bucket").applyInArrow(frugal_group(_frequent), "bucket int, level int, shingles long, tokens binary"), "frequent")
    least, total = 64, 0
    for level, n in sorted(((r["level"], r["n"]) for r in found.groupBy("level").agg(F.sum("shingles").alias("n")).collect()), reverse=True):
        total += n
        if total > HOT_SHINGLES:
            break
        least = level
    rows = found.where(F.col("level") >= least).select("bucket", "tokens").collect()
    if not rows:
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([np.frombuffer(r["tokens"], np.uint32).astype(np.uint64) | np.uint64(r["bucket"] << 32) for r in rows]))


def _list_blocks(buckets: int, shared_hot):
    """Prefix postings by bucket. Equal sets of a task are listed once; frequent shingles are dealt by set, not by name."""

    def flush(parts: list[tuple]) -> pa.RecordBatch:
        tokens, keys, sizes, places, hot = (np.concatenate([p[i] for p in parts]) for i in range(5))
        where = np.where(hot, keys % buckets + buckets, _bucketed(tokens, buckets))
        name = (_bucketed(tokens, buckets) << 32) | (tokens & _SHORT).astype(np.int64)
        order = np.argsort(where, kind="stable")
        bounds = np.searchsorted(where[order], np.arange(2 * buckets + 1))
        rows = []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[b] : bounds[b + 1]]
            rows.append((b % buckets, b >= buckets, (name[own].astype(np.int64) if b >= buckets else (name[own] & 0xFFFFFFFF).astype(np.uint32)).tobytes(), keys[own].tobytes(), sizes[own].astype(np.int32).tobytes(), places[own].astype(np.int32).tobytes()))
        cols = list(zip(*rows))
        return pa.record_batch([pa.array(cols[0], pa.int32()), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])], ["bucket", "hot", "tokens", "keys", "sizes", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = shared_hot.value
        parts, held, listed = [], 0, set()
        for batch in text_slices(batches):
            for own in _sets_of(batch):
                n = len(own)
                if not n or (key := set_key(own)) in listed:
                    continue
                listed.add(key)
                name = (_bucketed(own, buckets).astype(np.uint64) << np.uint64(32)) | (own & _SHORT)
                if len(frequent):
                    at = np.searchsorted(frequent, name)
                    hot = frequent[np.minimum(at, len(frequent) - 1)] == name
                else:
                    hot = np.zeros(n, bool)
                taken = np.concatenate((np.flatnonzero(~hot), np.flatnonzero(hot)))[: prefix_length(n)]
                parts.append((own[taken], np.full(len(taken), key, np.int64), np.full(len(taken), n, np.int32), np.arange(len(taken), dtype=np.int32), hot[taken]))
                held += len(taken)
            if len(listed) > 200_000:
                listed.clear()  # bounds memory; a set listed twice is only dropped later
            if held >= FLUSH:
                yield flush(parts)
                parts, held = [], 0
        if held:
            yield flush(parts)

    return run


def _shared_lists(group: pa.Table) -> pa.Table:
    """Postings of one bucket whose list has two different sets; frequent shingles pass, their lists lie in many buckets."""
    bucket = group["bucket"][0].as_py()
    read = lambda name, kind, rows: np.concatenate([np.frombuffer(v, kind) for v in rows[name].to_pylist()] or [np.zeros(0, kind)])
    out = []
    for hot in (False, True):
        rows = group.filter(pc.equal(group["hot"], hot))
        tokens = read("tokens", np.int64 if hot else np.uint32, rows).astype(np.int64)
        keys, sizes, places = read("keys", np.int64, rows), read("sizes", np.int32, rows), read("places", np.int32, rows)
        if not hot:
            tokens |= bucket << 32
        order = np.lexsort((keys, tokens))
        tokens, keys, sizes, places = tokens[order], keys[order], sizes[order], places[order]
        fresh = np.ones(len(tokens), bool)
        fresh[1:] = (tokens[1:] != tokens[:-1]) | (keys[1:] != keys[:-1])
        tokens, keys, sizes, places = tokens[fresh], keys[fresh], sizes[fresh], places[fresh]
        if not hot and len(tokens):
            heads = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            lengths = np.diff(np.append(heads, len(tokens)))
            keep = np.repeat(lengths > 1, lengths)
            tokens, keys, sizes, places = tokens[keep], keys[keep], sizes[keep], places[keep]
        out.append((tokens, keys, sizes, places))
    return pa.table({name: np.concatenate([o[i] for o in out]) for i, name in enumerate(("shingle", "key", "size", "place"))})


def _filter_places(keys: np.ndarray) -> list[np.ndarray]:
    return [(keys % FILTER_BITS), ((keys // FILTER_BITS) % FILTER_BITS)]


def key_filter(spark, keys: DataFrame) -> np.ndarray:
    """A bit table of fixed size that holds all keys; others pass it by chance only."""
    places = keys.select(F.explode(F.array(F.pmod("key", F.lit(FILTER_BITS)), F.pmod(F.expr(f"key div {FILTER_BITS}"), F.lit(FILTER_BITS)))).alias("p"))
    words = places.groupBy(F.shiftright("p", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 32 AS INT)))").alias("bits"))
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    got = words.select(F.col("w").cast("int").alias("w"), "bits").toArrow()
    table[got["w"].to_numpy()] = got["bits"].to_numpy().astype(np.uint32)
    return table


def _in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    passed = keys >= 0
    for p in _filter_places(np.maximum(keys, 0)):
        passed &= (bits[p // 32] >> (p % 32).astype(np.uint32)) & 1 == 1
    return passed


def _keys_of(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([set_key(s) if len(s) else -1 for s in sets], np.int64)


def _sketch(own: np.ndarray) -> list[int]:
    """A bit for each of the hash values that occur, as 64-bit words."""
    bits = np.zeros(SKETCH_BITS, np.uint8)
    bits[(own >> np.uint64(40)) % np.uint64(SKETCH_BITS)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _described(shared_filter):
    """A row for each document: size and key of its set, and a sketch if its key is in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            sets = _sets_of(batch)
            keys = _keys_of(sets)
            sketches = [_sketch(s) if ok else None for s, ok in zip(sets, _in_filter(shared_filter.value, keys).tolist())]
            doc_ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
            yield pa.record_batch([doc_ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(keys), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "key", "sketch"])

    return run


def _bodies(shared_filter):
    """The sets whose key is in the filter; a task gives equal sets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in text_slices(batches):
            sets = _sets_of(batch)
            keys = _keys_of(sets)
            rows = []
            for own, key, ok in zip(sets, keys.tolist(), _in_filter(shared_filter.value, keys).tolist()):
                if ok and key not in given:
                    given.add(key)
                    rows.append((key, own.tobytes()))
            if len(given) > 200_000:
                given.clear()
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["key", "body"])

    return run


def divide_skip(probe: np.ndarray, lists: list[np.ndarray], needed: np.ndarray) -> np.ndarray:
    """Which of the listed sets occur at least ``needed`` times in the inverted lists of the probe's shingles.

    ``lists`` holds ascending set numbers, one list for each shingle of the probe. The longest lists are put
    aside; the others are merged, sets that occur often enough without the long lists stay, and are looked up
    in the long lists by binary search.
    """
    if not lists:
        return needed <= 0
    least = max(int(needed.min()), 1)
    ordered = sorted(lists, key=len, reverse=True)
    aside = min(int(least / (SKIP_WEIGHT * np.log2(max(len(ordered[0]), 2)) + 1)), least - 1, len(ordered))
    merged = np.sort(np.concatenate(ordered[aside:])) if aside < len(ordered) else np.zeros(0, np.int64)
    counts = np.bincount(merged, minlength=len(needed))
    alive = np.flatnonzero(counts >= np.maximum(needed - aside, 1))
    for k, long in enumerate(ordered[:aside]):
        if not len(alive):
            break
        at = np.searchsorted(long, alive)
        counts[alive] += long[np.minimum(at, len(long) - 1)] == alive
        alive = alive[counts[alive] + (aside - k - 1) >= needed[alive]]
    kept = np.zeros(len(needed), bool)
    kept[alive] = counts[alive] >= needed[alive]
    return kept


def search_block(probe: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """T-occurrence search of one set among some others: builds their inverted lists for the probe's shingles."""
    sizes = np.array([len(o) for o in others], np.int64)
    joined = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), sizes)
    at = np.minimum(np.searchsorted(probe, joined), len(probe) - 1)
    hit = probe[at] == joined
    at, owner = at[hit], owner[hit]
    order = np.argsort(at, kind="stable")
    bounds = np.searchsorted(at[order], np.arange(len(probe) + 1))
    owner = owner[order]
    lists = [owner[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()) if b > a]
    return divide_skip(probe, lists, required(sizes, len(probe)))


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one hub that follow each other are one search; a hub with many rows takes several."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        hubs, keys = col["hub"].to_numpy(), col["key"].to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], hubs[1:] != hubs[:-1], [True])))
        kept = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for c in range(a, b, 512):
                rows = slice(c, min(c + 512, b))
                probe = np.frombuffer(col["hub_body"][c].as_buffer(), np.uint64)
                others = [np.frombuffer(v.as_buffer(), np.uint64) for v in col["body"][rows.start : rows.stop]]
                kept.append(np.arange(rows.start, rows.stop)[search_block(probe, others)])
        kept = np.concatenate(kept)
        yield pa.record_batch([pa.array(hubs[kept]), pa.array(keys[kept])], ["hub", "key"])


def _possible(a: str, b: str):
    """Bounds that every linked pair meets where it first shares a shingle."""
    n_a, n_b = F.col(f"{a}.size"), F.col(f"{b}.size")
    rest = F.least(n_a - F.col(f"{a}.place"), n_b - F.col(f"{b}.place"))
    return rest * (SHARE[0] + SHARE[1]) >= SHARE[0] * (n_a + n_b)


def _plausible(n_a, sketch_a, n_b, sketch_b):
    """Whether the sketches allow the overlap: every bit that only one set has is a shingle the other lacks."""

    def alone(x, y):
        words = [F.bit_count(x[k].bitwiseAND(F.bitwise_not(y[k]))) for k in range(SKETCH_BITS // 64)]
        while len(words) > 1:
            words = [left + right for left, right in zip(words[::2], words[1::2])]
        return words[0]

    rest = F.least(n_a - alone(sketch_a, sketch_b), n_b - alone(sketch_b, sketch_a))
    return rest * (SHARE[0] + SHARE[1]) >= SHARE[0] * (n_a + n_b)


def _linked(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs (hub, key) that link, found by searching each hub among its keys."""
    pairs = stored(pairs, "pairs")
    few = pairs.count() <= SENT_KEYS
    named = lambda side: bodies.join(F.broadcast(pairs.select(F.col(side).alias("key")).distinct()), "key", "left_semi") if few else bodies
    hubs = named("hub").select(F.col("key").alias("hub"), F.col("body").alias("hub_body"))
    found = pairs.join(named("key"), "key").join(hubs, "hub").select("hub", "hub_body", "key", "body").mapInArrow(frugal(_search), "hub long, key long")
    return stored(found, "linked")


def _list_pairs(lists: DataFrame, sketches: DataFrame) -> DataFrame:
    """All pairs of sets in one of the lists that lie in different classes and may link."""
    lists = lists.select("shingle", "key", "size", "place", "class")
    apart = (F.col("a.key") < F.col("b.key")) & (F.col("a.class") != F.col("b.class"))
    pairs = (
        lists.alias("a").join(lists.alias("b"), "shingle").where(apart & _possible("a", "b"))
        .select(F.col("a.key").alias("hub"), F.col("b.key").alias("key")).distinct()
    )
    return _pruned(pairs, sketches)


def _pruned(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    hubs = sketches.select(F.col("key").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("size").alias("hub_size"))
    both = pairs.join(sketches, "key").join(hubs, "hub")
    return both.where(_plausible(F.col("hub_size"), F.col("hub_sketch"), F.col("size"), F.col("sketch"))).select("hub", "key")


def _hub_pairs(lists: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
    """In each list and band of sizes, every set with the one that this turn's hash puts first, if not yet in one class.

    Bands lie half a step higher every other turn. The hash differs by list, so that a set which shares many lists with a class meets many of its members.
    """
    first = F.min(F.struct(F.xxhash64("key", "shingle", F.lit(turn)).alias("h"), "key", "size", "class")).alias("hub")
    steps = F.log("size") / F.log(F.lit(SHARE[1] / SHARE[0]))
    lists = lists.withColumn("band", F.floor(steps + F.lit(turn % 2 / 2)).cast("int"))
    hubs = lists.groupBy("shingle", "band").agg(first)
    near = SHARE[1] * F.least("hub.size", "x.size") >= SHARE[0] * F.greatest("hub.size", "x.size")
    pairs = (
        lists.alias("x").join(hubs, ["shingle", "band"]).where((F.col("hub.class") != F.col("x.class")) & near)
        .select(F.col("hub.key").alias("hub"), F.col("x.key").alias("key")).distinct()
    )
    return _pruned(pairs, sketches)


def _open_lists(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """The lists whose sets lie in different classes, with the class of each set."""
    marked = lists.drop("class").join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = marked.groupBy("shingle").agg(F.min("class").alias("low"), F.max("class").alias("high"))
    return stored(marked.join(mixed.where(F.col("low") != F.col("high")).select("shingle"), "shingle"), "open")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """Columns doc_id, n_shingles, component_id, n_links for every row of ``docs`` (doc_id, text; more columns are ignored).

    Two documents link when their sets of 5-word shingles have a Jaccard similarity of 0.75 or more; words are
    runs of bytes other than white space of ASCII, A-Z lower-cased; fewer than five words are one shingle.
    component_id is the smallest doc_id reachable over links, n_links the number of other rows that the row links with. Null, empty and blank texts have an empty set and
    link with nothing: each is its own class. Repeated rows come out once each. A null doc_id has a null
    component unless it links with a numbered document. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    buckets = 4 * partitions_of(spark)
    hot = spark.sparkContext.broadcast(frequent_shingles(docs, buckets))
    blocks = docs.select("text").mapInArrow(frugal(_list_blocks(buckets, hot)), "bucket int, hot boolean, tokens binary, keys binary, sizes binary, places binary")
    lists = blocks.groupBy("bucket").applyInArrow(frugal_group(_shared_lists), "shingle long, key long, size int, place int")
    lists = stored(lists, "lists")
    listed = spark.sparkContext.broadcast(key_filter(spark, lists.select("key").distinct()))
    sets = stored(docs.mapInArrow(frugal(_described(listed)), "doc_id long, n_shingles long, key long, sketch array<long>"), "sets")
    sketches = sets.where(F.col("sketch").isNotNull()).select("key", "sketch", F.col("n_shingles").cast("int").alias("size")).dropDuplicates(["key"])
    sketches = stored(sketches, "sketches")
    lengths = lists.groupBy("shingle").count()
    long = stored(lengths.where(F.col("count") > LONG_LIST).select("shingle"), "long")
    pairs = stored(_list_pairs(lists.join(long, "shingle", "left_anti").withColumn("class", F.col("key")), sketches), "pairs")
    open_lists = stored(lists.join(long, "shingle").withColumn("class", F.col("key")), "open")
    partners = pairs.select("key").union(pairs.select("hub")).union(open_lists.select("key")).distinct()
    named = spark.sparkContext.broadcast(key_filter(spark, partners))
    bodies = stored(docs.select("text").mapInArrow(frugal(_bodies(named)), "key long, body binary").dropDuplicates(["key"]), "bodies")
    links = _linked(pairs, bodies)
    for turn in range(HUB_TURNS):
        classes = stored(connected_classes(links, "hub", "key").withColumnRenamed("node", "key"), "classes")
        open_lists = _open_lists(open_lists, classes)
        found = _linked(_hub_pairs(open_lists, sketches, turn), bodies)
        links = links.union(found)
        if found.count() * FEW_LINKS < open_lists.select("key").distinct().count():
            break
    classes = stored(connected_classes(links, "hub", "key").withColumnRenamed("node", "key"), "classes")
    links = links.union(_linked(_list_pairs(_open_lists(open_lists, classes), sketches), bodies))
    classes = stored(connected_classes(links, "hub", "key").withColumnRenamed("node", "key"), "classes")
    smallest = sets.where("key >= 0").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    smallest = stored(smallest, "smallest")
    members = classes.join(smallest.select("key", "copies"), "key").join(bodies, "key")
    counts = link_counts(members, required).groupBy("key").agg(F.sum("links").alias("links"))
    tops = smallest.join(classes, "key", "left").withColumn("class", F.coalesce("class", "key"))
    firsts = tops.groupBy("class").agg(F.min("first_id").alias("component_id"))
    by_key = tops.join(firsts, "class").join(counts, "key", "left")
    by_key = by_key.select("key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = sets.select("doc_id", "n_shingles", "key").join(by_key, "key", "left")
    return found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
