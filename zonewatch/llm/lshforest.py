"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Equal sets are one class;
only one signature of each class goes on. Every tree of the forest takes the `trees * first` values
of the signature in another order, and sorts the classes by it; those that share a tree's first
`first` values are a region, neighbours in its sorted order.

- In a region of at most `whole` classes all are each other's candidates.
- In a larger one a class's candidates are its `near` neighbours on both sides of the sorted order.
  Those are the ones with the longest common prefixes, so the depth that a class is looked at adapts
  to how crowded its surroundings are. Every member also meets the region's hub, the class reached
  by always following the most frequent next values, and the hubs of its crowded parts further down.
  In a group of copies with independent edits that is the text they were made from, or one next to it.

So a class has a fixed number of candidates a tree, whatever a region holds. Candidates are
confirmed on full sets: first the likeliest partner of every class (the most common prefix over all
trees), then every candidate pair that still lies in two components and whose signatures agree often
enough (at `least` of their values; for a pair at the threshold that is over 6 standard deviations
below the mean). Components are computed in Spark.

Crowded regions that still hold more than one component are then settled exactly. Similar sets share
one of their rarest shingles (so many that the rest of a set is too small for the threshold), so
classes of two components that share one are compared on full sets: first below the rarer shingles,
which joins most of a group of copies of copies, then, between the components that are left, below
all of them. A shingle that only one component holds costs nothing, a common one is cut into blocks.
Thus two classes that the links connect end up in one component, however large their group, unless
all trees miss them: at similarity 0.75 a pair shares a region of one of 32 trees with probability
0.999995.

Null, empty and all-blank texts have no shingles and are linked with nothing. Repeated rows are a
class like any copies. A row with a null id links like any other and takes its component's name from
the others; where no row of a component has an id, the name is null and all its rows are kept. An
empty table gives no rows; other columns are ignored, whatever their names. The id may be any column
that Spark orders, a struct too. Very long texts are read a piece at a time; memory holds a text's
word hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, components, hot_keys, lean, lookup, pieces, ranked, save

TREES, FIRST = 32, 4
#: Prefix lengths at which a crowded region's parts have hubs, and those that lead on to a hub.
DEPTHS = (4, 8, 16, 32)
PATH = (4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128)
#: Values of a tree's order, behind the region's own, that classes are sorted by; rows sorted at once in a task.
DEEP, RUN = 32, 4096

#: Classes that share a shingle are compared in blocks of this many; shingles of at most FEW classes come first.
BLOCK, FEW = 256, 64

#: So many (class, id) rows are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_NODES = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _words(raw: np.ndarray, powers) -> np.ndarray:
    """A hash of each A-Z lower-cased word."""
    blank = np.concatenate([[True], _BLANK[raw], [True]])
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edge[::2], edge[1::2]
    up, down = powers if powers is not None and len(powers[0]) > len(raw) else _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[:len(raw)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, width: int = 5, powers=None, size: int = 1 << 16) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles: A-Z lower-cased words, `width` at a time."""
    words = np.concatenate([_words(np.frombuffer(p.encode("utf-8", "surrogatepass"), np.uint8), powers) for p in pieces(text or " ", size)])
    if not len(words):
        return np.empty(0, np.uint64)
    width = min(width, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * _BASE + words[i:len(words) - width + 1 + i])
    return np.unique(out)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The smallest of each hash function's upper 32 bits over all shingles."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(low, (factors[:, None] * found[None, at:at + 512]).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def _set_hash(found: np.ndarray) -> int:
    halves = np.array([mix(found).sum(dtype=np.uint64), mix(found ^ _BASE).sum(dtype=np.uint64)], np.uint64)
    return int(mix(halves * _BASE + np.uint64(len(found))).sum(dtype=np.uint64).view(np.int64))


def _sign(n: int, width: int):
    def start():
        import pyarrow as pa

        powers, factors = _powers(1 << 17), _factors(n)

        def sign(texts):
            sizes, nodes, sigs = [], [], []
            for text in texts:
                found = shingles(text, width, powers)
                sizes.append(len(found))
                nodes.append(_set_hash(found) if len(found) else None)
                sigs.append(signature(found, factors).tobytes() if len(found) else None)
            return pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())
        return sign
    return start


def _prefixes(sig: np.ndarray, tree: int, depths: tuple[int, ...]) -> np.ndarray:
    """Hashes of each signature's prefixes in the tree's order (rows x depths)."""
    values = np.roll(sig, -tree * FIRST, axis=1).astype(np.uint64)
    state, out = np.full(len(sig), tree + 1, np.uint64), []
    for i in range(max(depths)):
        state = mix(state * _BASE + values[:, i % values.shape[1]])
        if i + 1 in depths:
            out.append(state)
    return np.stack(out, axis=1).view(np.int64)


def _plant(trees: int):
    def plant(batches):
        for p in batches:
            sig = np.frombuffer(b"".join(p["sig"]), "<u4").reshape(len(p), -1)
            for t in range(trees):
                yield pd.DataFrame({"node": p["node"], "tree": t, "k": _prefixes(sig, t, (FIRST,))[:, 0]})
    return plant


def _order(whole: int):
    """Of each class the places to take in its trees' sorted orders; in crowded regions the prefixes that lead to hubs too."""
    def order(batches):
        for p in batches:
            sig = np.frombuffer(b"".join(p["sig"]), "<u4").reshape(len(p), -1)
            tree, k, n = (np.concatenate(p[c].to_list()) for c in ("tree", "k", "n"))
            of = np.repeat(np.arange(len(p)), [len(x) for x in p["tree"]])
            for t in np.unique(tree):
                at = np.flatnonzero(tree == t)
                turned = np.roll(sig[of[at]], -t * FIRST, axis=1)[:, FIRST:FIRST + DEEP].astype(">u2")
                keys, many = [None] * len(at), np.flatnonzero(n[at] > whole)
                if len(many):
                    for i, x in zip(many, _prefixes(sig[of[at[many]]], int(t), PATH)):
                        keys[i] = x
                yield pd.DataFrame({"k": k[at], "turned": [x.tobytes() for x in turned], "node": p["node"].to_numpy()[of[at]], "n": n[at], "keys": keys})
    return order


def _neighbours(whole: int, near: int):
    """Pairs of classes side by side in a run of a sorted order, and how long their common prefix is there."""
    reach = max(whole - 1, near)

    def pairs_of(p):
        k, node, n, own, run, place = (p[c].to_numpy() for c in ("k", "node", "n", "own", "run", "rank"))
        turned = np.frombuffer(b"".join(p["turned"]), ">u2").reshape(len(p), -1)
        for step in range(1, min(reach, len(p) - 1) + 1):
            # of a pair the later row is in its own run; the earlier may have come from the run before
            at = np.flatnonzero((k[step:] == k[:-step]) & own[step:] & (run[step:] == run[:-step]) & (place[step:] - place[:-step] == step)
                                & (step <= np.where(n[step:] <= whole, whole - 1, near)))
            if len(at):
                same = turned[at] == turned[at + step]
                depth = FIRST + np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))
                a, b = node[at], node[at + step]
                yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "depth": depth})

    def neighbours(batches):
        last = None
        for p in batches:  # a batch is looked at together with the last rows of the one before
            q = p if last is None else pd.concat([last.assign(own=False), p], ignore_index=True)
            yield from pairs_of(q)
            last = q.iloc[-reach:]
    return neighbours


def _sorted_neighbours(orders: DataFrame, whole: int, near: int) -> DataFrame:
    """(a, b, depth) of neighbours in the trees' sorted orders. All orders are one range-sorted table, cut
    into runs of equal length that begin with the last rows of the run before."""
    reach = max(whole - 1, near)
    rows = ranked(orders.select("k", "turned", "node", "n"), "k", "turned", "node").withColumn("run", F.expr(f"rank div {RUN}"))
    again = rows.where(F.col("rank") % RUN >= RUN - reach).withColumn("run", F.col("run") + 1)
    runs = rows.withColumn("own", F.lit(True)).unionByName(again.withColumn("own", F.lit(False)))
    return (runs.repartition(F.col("run")).sortWithinPartitions("run", "rank").select("run", "rank", "own", "k", "turned", "node", "n")
            .mapInPandas(lean(_neighbours(whole, near)), "a long, b long, depth int"))


def _hubs(crowded: DataFrame, whole: int) -> DataFrame:
    """(a, b, depth): the members of crowded parts of regions with the part's hub."""
    names = [f"k{d}" for d in PATH]
    part = (crowded.select("node", *(F.get("keys", i).alias(n) for i, n in enumerate(names)))
            .groupBy(*names).agg(F.count("*").alias("n"), F.min("node").alias("hub")))
    # from the deepest parts upwards: a part's hub is that of its most frequent continuation
    levels = []
    for i in range(len(PATH) - 1, -1, -1):
        if PATH[i] in DEPTHS:
            part = save(part, f"parts-{PATH[i]}")
            levels.append(part.where(F.col("n") > whole).select(F.lit(PATH[i]).alias("depth"), F.col(names[i]).alias("k"), "hub"))
        if i:
            part = part.groupBy(*names[:i]).agg(F.sum("n").alias("n"), F.max_by("hub", F.struct("n", "hub")).alias("hub"))
    parts = levels[0]
    for level in levels[1:]:
        parts = parts.unionByName(level)
    at = save(crowded.select("node", F.explode(F.array(*(F.get("keys", PATH.index(d)) for d in DEPTHS))).alias("k")), "keys")
    return (lookup(at, save(parts, "hubs"), "k", hot_keys(at, "k")).where("node <> hub")
            .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "depth"))


def _candidates(forest: DataFrame, classes: DataFrame, whole: int, near: int) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, depth), a < b: pairs of classes worth a look, once for each tree that proposes them; and
    (node, k) of crowded regions, if there are any."""
    sizes = forest.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    places = forest.join(sizes, "k").groupBy("node").agg(F.collect_list(F.struct("tree", "k", "n")).alias("l"))  # a tree at most once
    places = places.select("node", *(F.transform("l", lambda x: x[c]).alias(c) for c in ("tree", "k", "n")))
    orders = save(places.join(classes.select("node", "sig"), "node").mapInPandas(
        lean(_order(whole)), "k long, turned binary, node long, n long, keys array<long>"), "orders")
    pairs = _sorted_neighbours(orders, whole, near)
    crowded = orders.where(F.col("n") > whole)
    if not crowded.limit(1).count():
        return pairs, None
    return pairs.unionByName(_hubs(crowded.select("node", "keys"), whole)), crowded.select("node", "k")


def _unsettled(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """The classes of crowded regions that hold more than one component."""
    rows = crowded.select("node", "k").join(found, "node", "left").select("node", "k", F.coalesce("component", "node").alias("c"))
    mixed = rows.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("k")
    return save(rows.join(mixed, "k").select("node").distinct(), "unsettled")


def _items(batches):
    for p in batches:
        for at in range(0, len(p), 32):
            part = p.iloc[at:at + 32]
            found = [np.frombuffer(x, np.int64) for x in part["items"]]
            yield pd.DataFrame({"node": np.repeat(part["node"].to_numpy(), [len(f) for f in found]), "item": np.concatenate(found)})


def _rarest(sets: DataFrame, percent: int) -> DataFrame:
    """(node, size, item, at): of every set the rarest items that a set like it shares one of, and their places in
    the set by rarity. Items of one set only come first and meet nothing, so they are counted but not returned."""
    sized = sets.select("node", F.expr("octet_length(items) div 8").alias("size"))
    items = sets.mapInPandas(lean(_items), "node long, item long")
    shared = items.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    lists = items.join(shared, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "item"))).alias("l"))
    own = F.expr("size - size(l)")
    first = F.expr(f"size - ceil({percent} * size / 100D) + 1").cast("int") - own.cast("int")
    return (lists.join(sized, "node").where(first > 0)
            .select("node", "size", own.alias("own"), F.posexplode(F.slice("l", F.lit(1), first)).alias("pos", "e"))
            .select("node", "size", F.col("e.item").alias("item"), (F.col("own") + F.col("pos")).alias("at")))


def _across(rarest: DataFrame, found: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """(a, b), a < b: classes of two components that share one of their rarest items (that at most `most`
    classes share) and can be similar by their sizes and the item's places."""
    rows = save(rarest.join(found, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component"), "rarest-of")
    held = rows.groupBy("item", "c").agg(F.count("*").alias("n"))
    mixed = held.groupBy("item").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.max_by("c", F.struct("n", "c")).alias("main")).where("n > top")
    rows = save(lookup(rows, mixed if most is None else mixed.where(F.col("n") <= most), "item", hot_keys(rows, "item")).where("n IS NOT NULL"), "mixed")
    # all outside the item's largest component meet all others, in blocks
    wide, high = (F.ceil(c / BLOCK).cast("long") for c in (F.col("n"), F.col("n") - F.col("top")))
    block = F.xxhash64("node")
    some = rows.where("c <> main").select("item", "main", F.col("node").alias("a"), F.col("c").alias("ca"), F.col("size").alias("sa"), F.col("at").alias("ata"),
                                          F.pmod(block, high).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), wide - 1)).alias("j"))
    others = rows.select("item", F.col("node").alias("b"), F.col("c").alias("cb"), F.col("size").alias("sb"), F.col("at").alias("atb"),
                         F.explode(F.sequence(F.lit(0).cast("long"), high - 1)).alias("i"), F.pmod(block, wide).alias("j"))
    able = F.expr(f"{100 + percent} * least(sa - ata, sb - atb) >= {percent} * (sa + sb) AND 100 * least(sa, sb) >= {percent} * greatest(sa, sb)")
    return (some.join(others, ["item", "i", "j"]).where("ca <> cb AND (cb = main OR a < b)").where(able)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _sets(width: int):
    def sets(batches):
        powers = _powers(1 << 16)
        for p in batches:
            found = [shingles(t, width, powers) for t in p["text"]]
            out = pd.DataFrame({"node": p["node"], "items": [f.tobytes() for f in found]})
            yield out[[_set_hash(f) == n for f, n in zip(found, p["node"])]]
    return sets


def _confirm(percent: int):
    def confirm(batches):
        for p in batches:
            linked = []
            for a, b in zip(p["x"], p["y"]):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield p.loc[linked, ["a", "b"]]
    return confirm


def _agree(least: float):
    def agree(batches):
        for p in batches:
            x, y = (np.frombuffer(b"".join(p[c]), "<u4").reshape(len(p), -1) for c in ("x", "y"))
            yield p.loc[(x == y).mean(axis=1) >= least, ["a", "b"]]
    return agree


def _ends(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs with both sides' components as ca and cb; a class that isn't found is its own."""
    for c in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")), c, "left")
    return pairs.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))


def _merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) when the links are added: components of the components, as few links lie between those."""
    ends = save(_ends(links, found), "ends")
    up = components(ends, "ca", "cb").select(F.col("node").alias("component"), F.col("component").alias("up"))
    every = save(found.unionByName(ends.select(F.col("a").alias("node"), F.col("ca").alias("component")))
                 .unionByName(ends.select(F.col("b").alias("node"), F.col("cb").alias("component"))).distinct(), "members")
    return save(lookup(every, up, "component", hot_keys(every, "component")).select("node", F.coalesce("up", "component").alias("component")), "found")


def _with(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """The pairs with both sides' value as x and y."""
    return (pairs.join(table.select(F.col("node").alias("a"), F.col(value).alias("x")), "a")
            .join(table.select(F.col("node").alias("b"), F.col(value).alias("y")), "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = 5,
                    trees: int = TREES, whole: int = 16, near: int = 4, least: float = 0.5) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    signed = save(annotate(texts, ["id", "h"], "text", _sign(trees * FIRST, width), "n_shingles long, node long, sig binary"), "signatures")
    # a class goes by one of its rows: the smallest id, or where all ids are null the hash of a text
    classes = save(signed.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.min("h").alias("h"), F.first("sig").alias("sig")), "classes")
    forest = classes.select("node", "sig").mapInPandas(lean(_plant(trees)), "node long, tree int, k long")
    proposed, crowded = _candidates(forest, classes, whole, near)
    pairs = save(proposed.groupBy("a", "b").agg(F.sum("depth").alias("depth")), "candidates")

    needed = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    wanted = save(needed.join(classes, "node").select("node", F.col("rep").alias("id"), "h"), "wanted")
    few = wanted.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    sized = F.broadcast if few else lambda x: x
    named = texts.join(sized(wanted.where("id IS NOT NULL").select("node", "id")), "id").select("node", "text")
    unnamed = (texts.where("id IS NULL").join(sized(wanted.where("id IS NULL").select("node", "h")), "h")
               .groupBy("node").agg(F.first("text").alias("text")))
    # a repeated id gives a set twice, and then a confirmed pair twice, which is one link
    sets = save(named.unionByName(unnamed).mapInPandas(lean(_sets(width)), "node long, items binary"), "sets")

    def confirmed(some: DataFrame) -> DataFrame:
        return save(_with(some, sets, "items").select("a", "b", "x", "y").mapInPandas(lean(_confirm(percent)), "a long, b long"), "confirmed")

    ends = pairs.union(pairs.select("b", "a", "depth"))
    best = save(ends.groupBy("a").agg(F.max_by("b", F.struct("depth", "b")).alias("b"))
                .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "best")
    found = components(confirmed(best))
    other = _ends(pairs.join(best, ["a", "b"], "left_anti").select("a", "b"), found).where("ca <> cb").select("a", "b")
    likely = _with(other, classes, "sig").select("a", "b", "x", "y").mapInPandas(lean(_agree(least)), "a long, b long")
    more = confirmed(likely)
    if more.limit(1).count():
        found = _merged(found, more)
    if crowded is not None:
        unsettled = _unsettled(crowded, found)
        if unsettled.limit(1).count():
            rarest = save(_rarest(sets.join(unsettled, "node").dropDuplicates(["node"]), percent), "rarest")
            tried = None
            for most in (FEW, None):
                met = _across(rarest, found, percent, most)
                met = save(met if tried is None else met.join(tried, ["a", "b"], "left_anti"), "across")
                more = confirmed(met)
                if more.limit(1).count():
                    found = _merged(found, more)
                tried = met

    # a component, or one text, can hold a third of all rows
    located = save(classes.select("node", "rep").join(found, "node", "left")
                   .select("node", "rep", F.coalesce("component", "node").alias("component")), "located")
    names = located.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = save(lookup(located, names, "component", hot_keys(located, "component")).select("node", "component_id"), "named")
    return (lookup(signed.select("id", "n_shingles", "node"), named, "node", hot_keys(signed, "node"))
            .select("id", "n_shingles", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull())))
