"""Jaccard self-join of documents by word shingles, grouped by prefix.

Shingles are 64-bit hashes in one global order: by a level of their frequency, which
a counting sketch of fixed size gives, then by value. Any order gives the same links;
rare shingles first keep the lists of documents per prefix shingle short.

* Documents with one set of shingles become one node.
* Nodes with one size and one prefix become one group; prefixes are listed by group.
* Leaders first: each group meets the first group of its document lists with which it
  shares most lists, each node its group's first node. What histograms let pass and
  is verified gives first components. In lists that are still open, each group
  then meets up to LEADERS groups, and components are formed again.
* Then all other group pairs that share a prefix shingle and pass the filters by size
  and position are expanded to their nodes and verified, except inside a component,
  where a link changes nothing. No list and no pair is left out. Before sets are
  compared, histograms of their hashes bound the intersection from above. Long lists
  are dealt into blocks, and pairs of blocks are compared as matrices, so only pairs
  that pass the bound become rows.
* Components are found by alternating large and small stars.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occuspan.llm.common import BLOCK_KIND, add_text_columns, block_batch, give_back, shared_folder, sheltered, stage, sum_blocks

SHINGLE_WORDS = 5
PERCENT = 80
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 17
SKETCH_TASKS = 4096
# Up to so many ids of documents to read again go to every task; more are joined by shuffle.
BROADCAST_IDS = 1 << 20
BINS = 128
# Lists of more groups are compared in blocks of so many nodes.
SHORT_LIST = 16
BLOCK_NODES = 1024
# Smallest tokens of a group by which a pair that meets on several long lists is told from a new one.
FIRST_TOKENS = 16
# Groups of a list that all others of it meet before any two of them do.
LEADERS = 16
PAIRS_AT_ONCE = 1 << 16
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_set(data: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` words; of fewer words, the whole as one; of none, nothing."""
    words = data.lower().split()
    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n == 0:
        return h
    width = min(n, size)
    x = h[: n - width + 1].copy()
    for k in range(1, width):
        x = x * ODD + h[k : n - width + 1 + k]
    return np.unique(mixed(x if n >= size else x + np.full(1, n, np.uint64) * ODD))


def fingerprint(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def sketch(docs: DataFrame, size: int, bits: int, text: str) -> np.ndarray:
    """The level (binary logarithm) of how many documents hold shingles of each slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            sets = [shingle_set(t or b"", size) >> np.uint64(64 - bits) for t in batch.column(0).to_pylist()]
            if sets:
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                slots[found.astype(np.int64)] += times.astype(np.uint32)
        for at in range(0, len(slots), SKETCH_BLOCK):
            part = slots[at : at + SKETCH_BLOCK]
            if part.any():
                yield block_batch(at // SKETCH_BLOCK, part.astype(np.int64))
        del slots
        give_back()

    parts = docs.select(F.col(text).cast("binary")).coalesce(SKETCH_TASKS).mapInArrow(count, BLOCK_KIND)

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.int64)
                yield block_batch(block, np.log2(counts + 1.0).astype(np.uint8))

    levels = np.zeros(1 << bits, np.uint8)
    for row in sum_blocks(parts, "int64").mapInArrow(level, BLOCK_KIND).toLocalIterator():
        part = np.frombuffer(zlib.decompress(row.data), np.uint8)
        levels[row.block * SKETCH_BLOCK : row.block * SKETCH_BLOCK + len(part)] = part
    return levels


def histogram(hashes: np.ndarray) -> np.ndarray:
    """Shingles per bin of hash values, up to what two bytes hold."""
    bins = (hashes & np.uint64(BINS - 1)).astype(np.int64)
    return np.minimum(np.bincount(bins, minlength=BINS), 65_535).astype(np.uint16)


def bounded(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether intersections of sets with these histograms can reach what is needed; full bins bound nothing."""
    low = np.minimum(x, y)
    return (low.sum(axis=1, dtype=np.int64) >= need) | (low == 65_535).any(axis=1)


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def shingle_table(docs: DataFrame, levels: np.ndarray, size: int, percent: int, text: str, keep: list[str]) -> DataFrame:
    """Kept columns, node (fingerprint), n_shingles, group (hash of size and prefix), prefix, bins."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)
    shift = np.uint64(64 - (len(levels).bit_length() - 1))

    def make():
        level = sent.value

        def work(texts: list[bytes]) -> list:
            nodes, sizes, groups, prefixes, bins = [], [], [], [], []
            for t in texts:
                found = shingle_set(t, size)
                n = len(found)
                first = found[np.lexsort((found, level[(found >> shift).astype(np.int64)]))[: prefix_length(n, percent)]] if n else found
                nodes.append(fingerprint(found))
                sizes.append(n)
                groups.append(hashlib.blake2b(first.tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
                prefixes.append(first.view(np.int64))
                bins.append(histogram(found).tobytes())
            return [nodes, sizes, groups, prefixes, bins]

        return work

    return add_text_columns(docs, make, [("node", "binary"), ("n_shingles", "long"), ("group", "binary"), ("prefix", "array<long>"), ("bins", "binary")], keep, text)


def needed(a: Column, b: Column, percent: int) -> Column:
    """The smallest intersection of linked sets of these sizes."""
    return F.ceil((a + b) * percent / F.lit(100.0 + percent) - F.lit(1e-9))


def possible(small: Column, large: Column, small_at: Column, large_at: Column, percent: int, first: bool) -> Column:
    """Whether sets of these sizes can link, given a shared shingle at these places.

    first: it is the first one they share; else as many shingles as stand ahead may be shared, too.
    """
    ahead = F.lit(0) if first else F.least(small_at, large_at)
    rest = F.least(small - small_at, large - large_at)
    return (100 * small >= percent * large) & (ahead + rest >= needed(small, large, percent))


def components(links: DataFrame, folder: str, name: str) -> DataFrame:
    """node, root of every linked node; links: a, b."""
    edges = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), folder, f"{name}0")
    before, turn = None, 0
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, turn = state, turn + 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.filter("u <> v").distinct(), folder, f"{name}{turn}large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        edges = stage(small.filter("u <> v").distinct(), folder, f"{name}{turn}")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, folder: str, name: str, size: int, percent: int, text: str, doc_id: str) -> DataFrame:
    """The pairs a, b of nodes whose sets link, by the sets themselves, read again for these nodes only."""
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), folder, f"{name}pairs")
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = stage(wanted.join(nodes.select("node", "rep"), "node"), folder, f"{name}wanted")
    ids = wanted.select("rep").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    read = docs.join(ids, F.col(doc_id).eqNullSafe(F.col("rep")), "left_semi")

    def make():
        def work(texts: list[bytes]) -> list:
            sets = [shingle_set(t, size) for t in texts]
            return [[fingerprint(s) for s in sets], [s.tobytes() for s in sets]]

        return work

    sets = add_text_columns(read, make, [("node", "binary"), ("hashes", "binary")], [], text)
    # Copies under one id come once; other texts under it are not wanted.
    sets = stage(sets.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), folder, f"{name}sets")
    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    with_both = with_a.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return stage(with_both.mapInArrow(check, "a binary, b binary"), folder, f"{name}links")


def short_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs g, o of groups that share a token of a short list, filtered by size and first shared place."""
    x, y = lists.alias("x"), lists.alias("y")
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.gid") < F.col("y.gid")))
    first_part = F.col("x.n") - F.ceil(F.col("x.n") * (2.0 * percent) / (100.0 + percent) - F.lit(1e-9)) + 1
    apart = (F.col("x.low") != F.col("y.high")) | (F.col("x.high") != F.col("y.low"))
    near = possible(F.col("x.n"), F.col("y.n"), F.col("x.at"), F.col("y.at"), percent, False)
    matched = x.join(y, F.col("x.token") == F.col("y.token")).filter(smaller & apart & (F.col("x.at") < first_part) & near)
    return matched.select(F.col("x.gid").alias("g"), F.col("y.gid").alias("o")).distinct()


def open_lists(nodes: DataFrame, links: DataFrame, shared: DataFrame, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with their component so far, the span of components in each group, and the entries of
    lists that more than one component is on; in all other lists a link would change nothing."""
    roots = components(links, folder, f"{name}roots")
    placed = stage(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), folder, f"{name}placed")
    spans = placed.groupBy("gid").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    spread = shared.select("token", "gid", "n", "at", "held").join(spans, "gid")
    open_tokens = spread.groupBy("token").agg(F.min("low").alias("l"), F.max("high").alias("h")).filter("l <> h").select("token")
    return placed, spans, stage(spread.join(open_tokens, "token"), folder, f"{name}open")


def several_leaders(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs g, o: each group and up to LEADERS groups of each of its lists, the same ones in all lists
    that hold them. The pairs grow with the lists' entries, not with their pairs, and
    leave few near copies outside their component."""
    entry = F.struct("gid", "n", "at", "low", "high")
    turns = [F.min(F.struct(F.xxhash64(F.col("gid"), F.lit(turn)).alias("h"), entry.alias("e")))["e"] for turn in range(LEADERS)]
    leaders = lists.groupBy("token").agg(F.array_distinct(F.array(*turns)).alias("leaders"))
    met = lists.select("token", "gid", "n", "at", "low", "high").join(leaders, "token").withColumn("l", F.explode("leaders"))
    n, at, ln, lat = F.col("n"), F.col("at"), F.col("l.n"), F.col("l.at")
    fits = F.when(n <= ln, possible(n, ln, at, lat, percent, False)).otherwise(possible(ln, n, lat, at, percent, False))
    apart = (F.col("low") != F.col("l.high")) | (F.col("high") != F.col("l.low"))
    pairs = met.filter((F.col("gid") != F.col("l.gid")) & apart & fits)
    return pairs.select(F.least("gid", "l.gid").alias("g"), F.greatest("gid", "l.gid").alias("o")).distinct()


def least_shared(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * (n + m) // (100 + percent))


def pass_bound(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        n, m = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 4))
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BINS) for i in (2, 5))
        keep = pa.array(bounded(x, y, least_shared(n, m, percent)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(keep)


def within_bound(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b of nodes that histograms do not rule out; pairs: structs x and y of node, n, bins."""
    flat = pairs.select(*(F.col(f"{t}.{c}").alias(f"{t}{c}") for t in "xy" for c in ("node", "n", "bins")))
    return flat.mapInArrow(lambda b: pass_bound(b, percent), "a binary, b binary")


def long_pairs(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of nodes of different components on long lists: blocks of a list meet all blocks of it.

    A pair comes from the smallest token its groups share, if that is among the first ones of both;
    linked sets pass the filters on every list they share. Else each list gives it, and distinct() follows.
    """
    firsts = lists.groupBy("gid").agg(F.slice(F.sort_array(F.collect_list("token")), 1, FIRST_TOKENS).alias("firsts"))
    rows = lists.select("token", "gid", "at").join(placed.select("gid", "node", "n", "root", "bins"), "gid").join(firsts, "gid").drop("gid")
    blocks = rows.groupBy("token").agg(F.count(F.lit(1)).alias("nodes"))
    rows = rows.join(blocks.select("token", F.ceil(F.col("nodes") / BLOCK_NODES).alias("of")), "token")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")))
    # Aliases give the two sides columns of their own.
    names = [F.col(c).alias(c) for c in ("token", "i", "j", "node", "n", "at", "root", "bins", "firsts")]
    left = rows.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", F.col("of") - 1))).select(*names)
    right = rows.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), "own"))).select(*names)

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        a, b = x["node"].to_pylist(), y["node"].to_pylist()
        found = ([], [])
        if a and b:
            n, m, at, by = (t[c].to_numpy().astype(np.int64) for c, t in (("n", x), ("n", y), ("at", x), ("at", y)))
            roots = {r: k for k, r in enumerate({*x["root"].to_pylist(), *y["root"].to_pylist()})}
            r, s = (np.array([roots[v] for v in t["root"].to_pylist()]) for t in (x, y))
            bins, other = (np.frombuffer(b"".join(t["bins"].to_pylist()), np.uint16).reshape(-1, BINS) for t in (x, y))
            token, same_block = x["token"][0].as_py(), x["i"][0].as_py() == x["j"][0].as_py()
            # Only smaller tokens, on whose lists the pair has come already, matter here.
            own, others = ([{k for k in f if k < token} for f in t["firsts"].to_pylist()] for t in (x, y))
            for start in range(0, len(a), 256):
                rows_at = np.arange(start, min(start + 256, len(a)))
                small, large = np.minimum.outer(n[rows_at], m), np.maximum.outer(n[rows_at], m)
                rest = np.minimum.outer(at[rows_at], by) + np.minimum.outer(n[rows_at] - at[rows_at], m - by)
                open_ = (100 * small >= percent * large) & (rest >= least_shared(small, large, percent)) & np.not_equal.outer(r[rows_at], s)
                k, l = np.nonzero(open_)
                k = k + start
                for part in range(0, len(k), PAIRS_AT_ONCE):
                    u, v = k[part : part + PAIRS_AT_ONCE], l[part : part + PAIRS_AT_ONCE]
                    hit = bounded(bins[u], other[v], least_shared(n[u], m[v], percent))
                    for p, q in zip(u[hit].tolist(), v[hit].tolist()):
                        if (not same_block or a[p] < b[q]) and own[p].isdisjoint(others[q]):
                            found[0].append(a[p])
                            found[1].append(b[q])
        return pa.table({"a": pa.array(found[0], pa.binary()), "b": pa.array(found[1], pa.binary())})

    keys = ["token", "i", "j"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a binary, b binary")


def jaccard_components(
    docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, sketch_bits: int = SKETCH_BITS, root: str | None = None
) -> DataFrame:
    """Every row with n_shingles and component_id, the smallest id its links reach.

    Sets link when 100 * intersection >= percent * union. A null or empty text, or
    one of blanks, has an empty set and links with nothing, so its component is its
    own id. Repeated rows and equal texts share a component. A null id is passed
    over when ids are compared; a component of null ids has a null id. Ids may be null
    or repeated, so component_id need not tell components apart; a column named by
    `root` does (null for an empty set). Columns named like a result give way. An
    empty table gives an empty table.
    """
    results = ["n_shingles", "component_id", *([root] if root else [])]

    def run(source: DataFrame) -> DataFrame:
        return component_rows(source, size, percent, "text", "doc_id", sketch_bits, root)

    return sheltered(docs, {"text": text, "doc_id": doc_id}, results, run, [doc_id] if keep is None else keep)


def component_rows(source: DataFrame, size: int, percent: int, text: str, doc_id: str, sketch_bits: int, root: str | None) -> DataFrame:
    """jaccard_components over columns text, doc_id and others with private names, all of which are kept but the text."""
    folder = shared_folder(source.sparkSession)
    names = [c for c in source.columns if c != text]
    results = ["n_shingles", "component_id", *([root] if root else [])]
    levels = sketch(source, size, sketch_bits, text)
    rows = stage(shingle_table(source, levels, size, percent, text, list(dict.fromkeys([*names, doc_id]))), folder, "rows")
    full = rows.filter("n_shingles > 0")
    groups = full.groupBy("group", F.col("n_shingles").alias("n")).agg(F.first("prefix").alias("prefix"), F.min("node").alias("head"))
    groups = stage(groups.withColumn("gid", F.monotonically_increasing_id()), folder, "groups")
    nodes = full.groupBy("node", "group").agg(F.min(doc_id).alias("rep"), F.first("bins").alias("bins"))
    nodes = stage(nodes.join(groups.select("group", "gid", "n", "head"), "group").drop("group"), folder, "nodes")

    listed = groups.select("gid", F.posexplode("prefix").alias("at", "token"))
    lists = listed.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("gid").alias("leader")).filter("held > 1")
    shared = stage(listed.join(lists, "token").join(groups.select("gid", "n"), "gid"), folder, "shared")

    leaders = shared.filter("gid = leader").select("token", F.col("n").alias("ln"), F.col("at").alias("lat"))
    n, at, ln, lat = map(F.col, ("n", "at", "ln", "lat"))
    fits = F.when(n <= ln, possible(n, ln, at, lat, percent, False)).otherwise(possible(ln, n, lat, at, percent, False))
    met = shared.filter("gid <> leader").join(leaders, "token").filter(fits).groupBy("gid", "leader").agg(F.count(F.lit(1)).alias("common"))
    met = met.groupBy("gid").agg(F.max(F.struct("common", (-F.col("leader")).alias("other"))).alias("best")).select("gid", (-F.col("best.other")).alias("other"))
    heads = groups.select("gid", "head")
    led = met.join(heads.withColumnRenamed("head", "a"), "gid").join(heads.select(F.col("gid").alias("other"), F.col("head").alias("b")), "other")
    inside = nodes.filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    first = stage(led.select("a", "b").unionByName(inside), folder, "first")
    sized = nodes.select(F.struct("node", "n", "bins").alias("x"), F.col("node").alias("a"))
    first = first.join(sized, "a").join(sized.select(F.col("x").alias("y"), F.col("a").alias("b")), "b")
    links = verified(within_bound(first, percent), nodes, source, folder, "first", size, percent, text, doc_id)

    placed, spans, spread = open_lists(nodes, links, shared, folder, "first")
    several = several_leaders(spread, percent)
    led = several.join(heads.select(F.col("gid").alias("g"), F.col("head").alias("a")), "g").join(heads.select(F.col("gid").alias("o"), F.col("head").alias("b")), "o")
    led = stage(led.select("a", "b"), folder, "several")
    led = led.join(sized, "a").join(sized.select(F.col("x").alias("y"), F.col("a").alias("b")), "b")
    more = verified(within_bound(led, percent), nodes, source, folder, "several", size, percent, text, doc_id)
    links = links.unionByName(more)
    placed, spans, spread = open_lists(nodes, links, spread.drop("low", "high"), folder, "second")
    pairs = short_pairs(spread.filter(F.col("held") <= SHORT_LIST), percent)
    pairs = pairs.unionByName(spans.filter("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("o")))
    side = [F.struct("node", "root", "n", "bins").alias("x"), F.col("gid")]
    across = pairs.join(placed.select(side[0], side[1].alias("g")), "g").join(placed.select(side[0].alias("y"), side[1].alias("o")), "o")
    across = across.filter("x.root <> y.root and x.node < y.node or x.root <> y.root and g <> o")
    across = within_bound(across, percent)
    across = across.unionByName(long_pairs(spread.filter(F.col("held") > SHORT_LIST), placed, percent))
    more = verified(across, nodes, source, folder, "last", size, percent, text, doc_id)

    roots = components(links.unionByName(more), folder, "roots")
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "rep", "root")
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(smallest, "root").select("node", "component_id", *([F.col("root").alias(root)] if root else []))
    found = rows.drop("group", "prefix", "bins").join(named, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col(doc_id))
    return found.withColumn("component_id", component).select(*names, *results)
