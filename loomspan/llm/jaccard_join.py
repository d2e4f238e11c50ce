"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document is the set of its distinct 5-word shingles (64-bit hashes). Sets that link (Jaccard >= t) share a
shingle within their prefixes, the first n - ceil(t n) + 1 shingles in one order that holds for all documents. The
order is rare first: the most frequent shingles (a bounded list, ORDERED) come last, by frequency, the others before
them by hash. Frequencies for this list are summed from batches in which a shingle is found FREQUENT times; any order
gives the same links, a good one gives short lists.

Prefix shingles that no other document has in its prefix are dropped as soon as equal ones meet; those of the frequent
list, which others have, are dealt over DEALT parts each, so that none is one task's. Equal sets are reduced to one representative each. In the list of
a shingle only members that could have it as their first shared shingle are paired (positional filter: enough shingles
must follow in both). Every member is first paired with at most PIVOTS others (of random parts of the list those with the fewest rarer
shingles, as they link with most); then, once components
are known, members outside a list's largest component are paired with those of other components, by bands of size that
the length and positional filters leave open: the smaller of two must have enough shingles left for the larger. So a
large group of near copies, or of texts that share much but not enough, costs pairs in proportion to its size, yet every
pair that could join two components is looked at. Each
pair is verified once: by the suffix filter (set sizes by hash range bound the overlap), then by intersection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.shared import components, discard, keep, passing, row_key
from loomspan.llm.textscan import mix, shingle_set, text_bytes, word_codes, word_spans

SHINGLE = 5
THRESHOLD = 80
#: Shingles ranked by frequency, at most (bounds the broadcast to 480 kB), and how often a batch must have one.
ORDERED, FREQUENT = 40_000, 4
#: Parts over which the prefix rows of a frequent shingle are dealt.
DEALT = 256
#: Members of a list that the others are first paired with, at most.
PIVOTS = 8
#: Shingles of a member that are remembered in each list, to leave out pairs that an earlier list has.
BEFORE = 8
#: Bits for each end of a pair by which texts are told that are in none, and the power of two of them at most (16 MB).
BITS, MOST_BITS = 8, 27


def shingles(data: np.ndarray) -> np.ndarray:
    return shingle_set(word_codes(data, *word_spans(data), lower=True), SHINGLE)


def _needed(n, percent: int):
    """Shared shingles at least that a set of n needs to link with any other: ceil(percent / 100 * n)."""
    return (percent * n + 99) // 100


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (often, key, n, a, b): for each text the size of its set and a 128-bit digest; and, with often, the
    shingles (key) that a batch has FREQUENT times, and how often (n)."""
    for batch in batches:
        n, a, b = [], [], []
        found = [shingles(data) for data in text_bytes(batch.column(1))]
        for h in found:
            n.append(len(h))
            a.append(int(np.bitwise_xor.reduce(h)) if len(h) else 0)
            b.append(int(mix(h + np.uint64(0x13198A2E03707344)).sum(dtype=np.uint64)) if len(h) else 0)
        x = (pa.array(np.array(v, dtype=np.uint64).view(np.int64)) for v in (n, a, b))
        names = ["often", "key", "n", "a", "b"]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), batch.column(0), *x], names)
        h = np.sort(np.concatenate(found or [np.empty(0, np.uint64)]))
        often = h[FREQUENT - 1 :][h[FREQUENT - 1 :] == h[: len(h) - FREQUENT + 1]] if len(h) >= FREQUENT else h[:0]
        h, times = np.unique(often, return_counts=True)
        times += FREQUENT - 1
        none = pa.array(np.zeros(len(h), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), bool)), pa.array(h.view(np.int64)), pa.array(times), none, none], names)


_FREQUENT = np.int64(-(1 << 63))


def _prefixes(frequent, percent: int):
    """(key, text) -> a row for each prefix shingle: (h, key, at), where at holds pos (from 0 in the common order) in its
    upper half, n in its lower one, and is negative for a frequent shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = frequent.value
        for batch in batches:
            out: list[tuple] = []
            for key, data in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                h = shingles(data)
                n = len(h)
                if not n:
                    continue
                length = n - _needed(n, percent) + 1
                rank = np.zeros(n, dtype=np.int32)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    rank = np.where(hashes[at] == h, ranks[at], 0)
                first = np.argsort(rank, kind="stable")[:length]  # h is sorted: it breaks ties
                at = (np.arange(length, dtype=np.int64) << 32) | n
                out.append((h[first], np.full(length, key), np.where(rank[first] > 0, at | _FREQUENT, at)))
            if out:
                h, key, at = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key), pa.array(at)], ["h", "key", "at"])

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _prefixes, sorted by h -> (h, key, n, pos): frequent shingles, and those that two rows have."""
    last, known = None, False  # the row before a batch, and whether it is one of these

    def rows(batch: pa.RecordBatch, stays: np.ndarray) -> pa.RecordBatch:
        h, key, at = (x.to_numpy()[stays] for x in batch.columns)
        n, pos = (at & 0x7FFFFFFF).astype(np.int32), (at >> 32 & 0x7FFFFFFF).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, key, n, pos)], ["h", "key", "n", "pos"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        h, stays = batch.column(0).to_numpy(), batch.column(2).to_numpy() < 0
        equal = h[1:] == h[:-1]
        stays[0] |= known
        stays[1:] |= equal
        stays[:-1] |= equal
        last, known = batch.slice(batch.num_rows - 1), bool(stays[-1])
        stays[-1] = False
        yield rows(batch, stays)
    if known:
        yield rows(last, np.array([True]))


def _marked(keys: DataFrame) -> tuple[np.ndarray, F.Column]:
    """Bits in which each of keys(key) has its own set, and the number of a key's bit: BITS a key, MOST_BITS at most, so
    that few other keys meet one that is set. A bounded table of 64 bits a row comes to the driver."""
    n = 1 << min(MOST_BITS, max(6, (BITS * keys.count() - 1).bit_length()))
    bit = F.pmod(F.xxhash64("key"), F.lit(n))
    rows = keys.select(bit.alias("bit")).groupBy((F.shiftright("bit", 6)).alias("at"))
    rows = rows.agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(n >> 6, dtype=np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out, bit


def _arrays(marks):
    """(key, text, bit) -> (key, hashes): the sets of the texts whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            ends = np.flatnonzero(bits[bit >> 6] >> (bit & 63) & 1)
            texts = text_bytes(batch.column(1))
            sets = [shingles(texts[i]).tobytes() for i in ends]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ends)), pa.array(sets, pa.binary())], ["key", "hashes"])

    return run


_RANGES = (np.arange(1, 16, dtype=np.uint64) << np.uint64(60)).astype(np.uint64)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    total = len(a) + len(b)
    least = -(-percent * total // (100 + percent))  # shared shingles that a link needs
    if min(len(a), len(b)) < least:
        return False
    # Suffix filter: shingles of one hash range can only meet in that range.
    parts = [np.diff(np.concatenate(([0], np.searchsorted(x, _RANGES), [len(x)]))) for x in (a, b)]
    if int(np.minimum(*parts).sum()) < least:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(long, short), len(long) - 1)
    shared = int((long[at] == short).sum())
    return 100 * shared >= percent * (total - shared)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(text_bytes(batch.column(2)), text_bytes(batch.column(3)))
            # Hashes are 8 bytes each, but a column's rows need not begin at a multiple of 8 in memory.
            ok = [_linked(np.frombuffer(x.tobytes(), np.uint64), np.frombuffer(y.tobytes(), np.uint64), percent) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _enough_in_prefixes(pairs: DataFrame, prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes share enough: what they share besides must follow the prefix that ends first."""
    for end, x in (("a", "x"), ("b", "y")):
        pairs = pairs.join(prefixes.select(F.col("key").alias(end), F.col("n").alias(f"n{x}"), F.col("shingles").alias(x)), end)
    needed = F.ceil((F.col("nx") + F.col("ny")) * percent / F.lit(100 + percent) - 1e-9)
    after = F.greatest(*(F.ceil(F.col(n) * percent / F.lit(100) - 1e-9) - 1 for n in ("nx", "ny")))
    return pairs.where(F.size(F.array_intersect("x", "y")) + after >= needed).select("a", "b")


def _verified(pairs: DataFrame, prefixes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) that link."""
    pairs = keep(_enough_in_prefixes(pairs, prefixes, percent))
    # Texts stay where they lie: only the sets of those that pairs need (and of a few more) are shuffled.
    bits, bit = _marked(pairs.select(F.explode(F.array("a", "b")).alias("key")))
    marks = docs.sparkSession.sparkContext.broadcast(bits)
    sets = docs.select("key", "text", bit.alias("bit")).mapInArrow(_arrays(marks), "key long, hashes binary").dropDuplicates(["key"])
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")
    out = keep(both.mapInArrow(_verify(percent), "a long, b long"))
    discard(pairs)
    return out


def _can_link(x: str, y: str, percent: int) -> F.Column:
    """Length filter, and positional filter if the list's shingle is the first that two members share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    needed = F.ceil((n + m) * percent / F.lit(100 + percent) - 1e-9)
    after = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (F.col(f"{x}.key") != F.col(f"{y}.key")) & (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (after >= needed)


def _band(n: F.Column) -> F.Column:
    """Sizes in steps of a twentieth: what may link lies in one of five bands."""
    return F.floor(F.log(n.cast("double")) / math.log(1.05)).cast("int")


def _pair(x: str, y: str) -> list[F.Column]:
    return [F.least(f"{x}.key", f"{y}.key").alias("a"), F.greatest(f"{x}.key", f"{y}.key").alias("b")]


def set_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, n, a, b) of docs(key, text), a row for each key; the classes of equal sets: (n, a, b, rep); and frequent
    shingles (h, n). Texts are read once for all of them."""
    scanned = keep(docs.mapInArrow(_scan, "often boolean, key long, n long, a long, b long"))
    sets = scanned.where("not often").select("key", "n", "a", "b").dropDuplicates(["key"])
    often = scanned.where("often").groupBy(F.col("key").alias("h")).agg(F.sum("n").alias("n"))
    return sets, keep(sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("key").alias("rep"))), often


def _lists(docs: DataFrame, reps: DataFrame, often: DataFrame, percent: int) -> DataFrame:
    """(h, key, n, pos): prefix shingles of representatives, of lists with two members at least."""
    top = often.orderBy(F.desc("n"), "h").limit(ORDERED).collect()  # bounded
    hashes = np.array([r.h for r in top], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    frequent = docs.sparkSession.sparkContext.broadcast((hashes[order], (len(top) - np.arange(len(top), dtype=np.int32))[order]))
    prefixes = docs.mapInArrow(_prefixes(frequent, percent), "h long, key long, at long")
    deal = F.when(F.col("at") < 0, F.pmod("key", F.lit(DEALT)))
    shared = keep(prefixes.repartition("h", deal).sortWithinPartitions("h").mapInArrow(_met, "h long, key long, n int, pos int"))
    members = keep(shared.dropDuplicates(["h", "key"]).join(reps.select(F.col("rep").alias("key")), "key", "left_semi"))
    discard(shared)
    lists = keep(members.groupBy("h").agg(F.count("*").alias("size")).where("size > 1").select("h"))
    out = keep(members.join(lists, "h").select("h", "key", "n", "pos"))
    discard(members, lists)
    return out


def set_links(docs: DataFrame, reps: DataFrame, often: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Links (a, b) between representatives that connect every component of the join: a spanning part of all links."""
    lists = _lists(docs, reps, often, percent)
    prefixes = keep(lists.groupBy("key").agg(F.first("n").alias("n"), F.collect_list("h").alias("shingles")))
    bucket = F.pmod(F.xxhash64("key"), F.lit(PIVOTS)).cast("int")
    pivots = lists.groupBy("h", bucket.alias("bucket")).agg(F.min_by(F.struct("key", "n", "pos"), F.struct("pos", F.xxhash64("key"))).alias("p")).select("h", "p.*")
    pivots = keep(pivots)
    x, y = lists.alias("x"), pivots.alias("y")
    first = keep(x.join(y, F.col("x.h") == F.col("y.h")).where(_can_link("x", "y", percent)).select(*_pair("x", "y")).distinct())
    discard(pivots)
    links = _verified(first, prefixes, docs, percent)
    parts = components(links)

    labelled = keep(lists.join(parts.withColumnRenamed("node", "key"), "key", "left").select("h", "key", "n", "pos", F.coalesce("component", "key").alias("part")))
    discard(lists)
    sizes = labelled.groupBy("h", "part").agg(F.count("*").alias("size"), F.bit_or(F.pow(F.lit(2), bucket).cast("long")).alias("buckets"))
    largest = sizes.groupBy("h").agg(F.count("*").alias("parts"), F.sum("size").alias("members"), F.bit_or("buckets").alias("buckets"), F.max_by("part", F.struct("size", "part")).alias("largest"))
    # Every pair with a pivot, one for each bucket that has members, was met above: a list is open if two others are left.
    largest = keep(largest.where((F.col("parts") > 1) & (F.col("members") - F.bit_count("buckets") > 1)).select("h", "largest"))
    # Each member carries the BEFORE shingles that it has before the list's. If two members share one of these, the pair
    # was met in that list already; so a pair is left to the lists where its shared shingles begin.
    before = F.collect_list("h").over(Window.partitionBy("key").orderBy("pos").rowsBetween(-BEFORE, -1))
    open_lists = keep(labelled.join(largest, "h").withColumn("before", before).withColumn("most", F.col("part") == F.col("largest")).drop("largest"))
    discard(labelled, largest)
    # Of two members the smaller one must have enough left for the larger one's size: most lists of shared boilerplate have
    # no member that has enough for its own. Those that do meet sizes from their own up to their limit, band by band; of
    # the list's largest component they meet the others alone.
    limit = F.least(F.floor((F.col("n") - F.col("pos")) * (100 + percent) / F.lit(percent) + 1e-9) - F.col("n"), F.floor(F.col("n") * 100 / F.lit(percent) + 1e-9))
    smaller = open_lists.withColumn("limit", limit).where(F.col("limit") >= F.col("n")).withColumn("band", F.explode(F.sequence(_band(F.col("n")), _band(F.col("limit")))))
    smaller = smaller.drop("limit").withColumn("meets", F.explode(F.when(F.col("most"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True))))).drop("most")
    x, y = smaller.alias("x"), open_lists.withColumn("band", _band(F.col("n"))).alias("y")
    same = (F.col("x.h") == F.col("y.h")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.meets") == F.col("y.most"))
    in_order = F.struct("x.n", "x.key") < F.struct("y.n", "y.key")
    fits = in_order & (F.col("x.part") != F.col("y.part")) & _can_link("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before")
    met = x.join(y, same).where(fits).select(*_pair("x", "y")).distinct()
    rest = keep(met.join(first, ["a", "b"], "left_anti"))
    discard(open_lists)
    more = _verified(rest, prefixes, docs, percent)
    discard(prefixes)
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = THRESHOLD) -> DataFrame:
    """Each row of docs with n_shingles (set size) and component_id (smallest id reachable by links, itself included).

    Words are runs without ASCII white space, with A-Z in lower case. Null and blank texts have an empty set and link
    with nothing; fewer words than five make one shingle. Ids are to be unique; rows with one id and text count as one
    document. A null id is replaced by a hash of its text within the join, and may so be named in component_id.
    Columns of these two names are replaced. An empty table gives an empty table."""
    names = ["n_shingles", "component_id"]
    keyed = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in names), row_key(id_column, text_column).alias("__key"))
    texts = keyed.select(F.col("__key").alias("key"), F.coalesce(text_column, F.lit("")).alias("text"))
    with passing() as stay:
        sets, classes, often = set_classes(texts)
        parts = components(set_links(texts, classes, often, percent))
        named = sets.join(classes, ["n", "a", "b"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        named = named.select(F.col("key").alias("__key"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "key").alias("component_id"))
        named = stay(keep(named))
    return keyed.join(named, "__key").drop("__key")
