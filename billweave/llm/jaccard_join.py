"""Groups of documents whose sets of word shingles are similar.

Two documents link if the Jaccard similarity of their shingle sets reaches `PERCENT` / 100; linked
ones, directly or over others, form a group.

Method: signature trees. Every set has a bitmap of its tokens whose width follows the set's size
(two bits and more for each token, `MOST_BITS` at most). A tree holds sets of one width in its leaves;
every node has the OR of their bitmaps, the most tokens that are not the first of their bit, and the
range of set sizes. Two trees (or one and itself) are traversed together; a pair of nodes is left as
soon as the largest overlap that bitmaps and sizes allow is below what the threshold asks for. Sets of
the next width are folded to the narrower one, as sizes that may link are at most one width apart.

How it is spread:
1. Documents with equal sets are one. Each set has `BANDS` keys, each made of `ROWS` minima under hash
   functions of their own, and its bitmap.
2. Sets that share a key meet in a task, which builds signature trees of them and traverses these. No
   pair whose bitmaps allow a link is left out; pairs count at the first of the keys that they share
   only. A pair at the threshold shares no key with probability (1 - 0.75 ** ROWS) ** BANDS, which is
   5e-10, and is taken for one that met before with less than 1e-8.
3. The sets of a key that have such a partner go to one task with their whole texts; signature trees
   and then the sets themselves give the links among them exactly. More than `BLOCK` sets of a key, or
   more than `BLOCK_SHINGLES` in all, are dealt into blocks, and each pair of blocks is a task of its
   own, so a group of any size is split and nothing is dropped. Only links that span the groups leave
   a task, and leaves that are in one group already are not compared.
4. The components of those links are the groups.
Pairs within a group are never written out.

Words: A-Z lower-cased, cut at ASCII blanks. Sets: distinct shingles of `SHINGLE` words (64-bit
hashes); a shorter text is one shingle. Null text, or text without words, has an empty set and links
with nothing. The group's name is its smallest id; null ids are left out of it, and a group without
any other has a null name. Names can be equal by chance (null, or one id on several texts); what tells
groups apart is `root`. A row that occurs twice is two documents with equal sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from billweave.llm.components import components
from billweave.llm.rows import fresh, saved, slices

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 26, 2
#: Sets and shingles in a block of a key, rows of keys in a task, sets in a leaf, nodes under a node.
BLOCK, BLOCK_SHINGLES, KEY_ROWS, LEAF, FAN = 2048, 1_000_000, 8_000, 32, 8
#: Members of a key's group that meet in one task.
CHUNK = 2048
#: Widest bitmap; tokens of two leaves up to which all their overlaps are one product.
MOST_BITS, DENSE = 1 << 15, 1 << 18
SEED = 7_919
SETS = "id {id}, rid long, n long, name binary, keys array<long>, marks binary, map binary"


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or "").encode(errors="surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mixed = hashes[:len(words) - size + 1].copy()
    for k in range(1, size):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed += hashes[k:len(words) - size + 1 + k]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def multipliers() -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least hash of the set under each function."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        np.minimum(least, (found[at:at + 4096] * factors[:, None]).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One number for the minima of each band."""
    key = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(31)) ^ row) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(29))


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the maps of sets of these sizes: a power of two, at least two for each token."""
    return np.minimum(MOST_BITS, 1 << np.maximum(6, np.ceil(np.log2(2 * n))).astype(np.int64))


def bitmap(found: np.ndarray) -> bytes:
    bits = np.zeros(int(widths(np.array(len(found)))), np.uint8)
    bits[(found >> np.uint64(8)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def describe(batches: Iterator[pa.RecordBatch], size: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    factors = multipliers()
    for batch in batches:
        for part in slices(batch):
            n, names, keys, marks, maps = [], [], [], [], []
            for text in part.column("text").to_pylist():
                found = shingles(text, size)
                some = len(found) > 0
                key = band_keys(minima(found, factors)) if some else None
                n.append(len(found))
                names.append(xxhash.xxh3_128_digest(found.tobytes()) if some else None)
                keys.append(key.view(np.int64) if some else None)
                marks.append((key >> np.uint64(32)).astype("<u4").tobytes() if some else None)
                maps.append(bitmap(found) if some else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("id").cast(id_type), part.column("rid"), pa.array(n, pa.int64()),
                 pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                 pa.array(marks, pa.binary()), pa.array(maps, pa.binary())],
                ["id", "rid", "n", "name", "keys", "marks", "map"])


class Groups:
    """Union-find over the numbers below n."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


class Bitmaps:
    """The bitmaps of some sets, each in its own width and, for the narrower neighbour, folded."""

    def __init__(self, n: np.ndarray, maps: list[bytes], likeness: np.ndarray) -> None:
        #: sets with equal or close numbers of `likeness` become neighbours in trees
        self.n, self.likeness, self.width = n, likeness, widths(n)
        #: width -> (row of each set or -1, maps, tokens beyond the first of each bit)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in np.unique(self.width).tolist():
            own, wider = np.flatnonzero(self.width == width), np.flatnonzero(self.width == 2 * width)
            wide = self._read(maps, wider, 2 * width)
            half = wide.shape[1] // 2
            words = np.concatenate([self._read(maps, own, width), wide[:, :half] | wide[:, half:]])
            row = np.full(len(n), -1)
            row[own], row[wider] = np.arange(len(own)), len(own) + np.arange(len(wider))
            spare = n[np.concatenate([own, wider])] - np.bitwise_count(words).sum(1, dtype=np.int64)
            self.held[width] = row, words, spare

    @staticmethod
    def _read(maps: list[bytes], rows: np.ndarray, width: int) -> np.ndarray:
        raw = b"".join(maps[r] for r in rows.tolist())
        return np.frombuffer(raw, "<u8").reshape(len(rows), width // 64)

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of these pairs of sets can reach the threshold, by sizes and bitmaps."""
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        keep = 100 * small >= PERCENT * large
        narrow = np.minimum(self.width[i], self.width[j])
        for width in np.unique(narrow[keep]).tolist():
            row, words, spare = self.held[width]
            here = np.flatnonzero(keep & (narrow == width))
            step = 1 + (1 << 22) // width
            for at in range(0, len(here), step):
                part = here[at:at + step]
                x, y = row[i[part]], row[j[part]]
                overlap = most_shared(words[x] & words[y], spare[x], spare[y], small[part])
                keep[part] = enough(overlap, small[part] + large[part])
        return keep

    def tree(self, width: int, members: np.ndarray, own: bool) -> SignatureTree | None:
        """Of those members that have this width or, folded, of those with the next."""
        members = members[self.width[members] == (width if own else 2 * width)]
        return SignatureTree(self, width, members) if len(members) else None


def most_shared(both: np.ndarray, spare: np.ndarray, spare2: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest overlap that two maps allow: their shared bits, and what stands beside the first of a bit."""
    return np.minimum(np.bitwise_count(both).sum(1, dtype=np.int64) + np.minimum(spare, spare2), least)


def enough(overlap: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    # overlap / union reaches p: overlap * (100 + p) >= p * (both sizes)
    return (100 + PERCENT) * overlap >= PERCENT * sizes


class SignatureTree:
    """Sets of one width in leaves; by level, the nodes' bitmaps, most spare tokens, and size ranges."""

    def __init__(self, maps: Bitmaps, width: int, members: np.ndarray) -> None:
        # sets of about one size, and among those alike ones, are neighbours
        order = np.lexsort((maps.likeness[members], np.floor(np.log(maps.n[members]) / np.log(1.15))))
        self.members = members[order]
        row, words, spare = maps.held[width]
        at, sizes = row[self.members], maps.n[self.members]
        #: levels[0]: leaves; of each level: bitmaps, most spare tokens, least size, largest size
        self.levels = [self._above((words[at], spare[at], sizes, sizes), LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._above(self.levels[-1], FAN))

    @staticmethod
    def _above(level: tuple, fan: int) -> tuple:
        maps, most, small, large = level
        cuts = np.arange(0, len(maps), fan)
        return (np.bitwise_or.reduceat(maps, cuts), np.maximum.reduceat(most, cuts),
                np.minimum.reduceat(small, cuts), np.maximum.reduceat(large, cuts))

    def leaf(self, n: int) -> np.ndarray:
        return self.members[n * LEAF:(n + 1) * LEAF]

    def children(self, nodes: np.ndarray, level: int) -> list[range]:
        if level >= len(self.levels):
            return [range(n, n + 1) for n in nodes.tolist()]
        below = len(self.levels[level - 1][0])
        return [range(n * FAN, min((n + 1) * FAN, below)) for n in nodes.tolist()]


def can_overlap(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes can hold a link, by the largest overlap that they allow."""
    (maps, most, small, large), (maps2, most2, small2, large2) = a, b
    # sizes alone: the ranges must come close enough
    keep = (100 * large[i] >= PERCENT * small2[j]) & (100 * large2[j] >= PERCENT * small[i])
    here = np.flatnonzero(keep)
    step = 1 + (1 << 16) // maps.shape[1]
    for at in range(0, len(here), step):
        part = here[at:at + step]
        x, y = i[part], j[part]
        overlap = most_shared(maps[x] & maps2[y], most[x], most2[y], np.minimum(large[x], large2[y]))
        keep[part] = enough(overlap, small[x] + small2[y])
    return keep


def traverse(one: SignatureTree, two: SignatureTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of leaves that can hold a link; a leaf with itself comes first."""
    i = j = np.zeros(1, np.int64)
    for level in range(max(len(one.levels), len(two.levels)) - 1, -1, -1):
        a, b = (t.levels[min(level, len(t.levels) - 1)] for t in (one, two))
        keep = can_overlap(a, b, i, j)
        i, j = i[keep], j[keep]
        if level:
            pairs = np.array([(x, y) for xs, ys in zip(one.children(i, level), two.children(j, level))
                              for x in xs for y in ys if one is not two or x <= y], np.int64).reshape(-1, 2)
            i, j = pairs[:, 0], pairs[:, 1]
    order = np.argsort(i != j, kind="stable")
    for x, y in zip(i[order].tolist(), j[order].tolist()):
        yield one.leaf(x), two.leaf(y)


def leaf_pairs(maps: Bitmaps, members: np.ndarray, others: np.ndarray | None = None
               ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves that can hold a link of two members, or of a member and one of the others."""
    for width in maps.held:
        own, wider = maps.tree(width, members, True), maps.tree(width, members, False)
        if others is None:
            walks = [(own, own), (own, wider)]
        else:
            own2, wider2 = maps.tree(width, others, True), maps.tree(width, others, False)
            walks = [(own, own2), (own, wider2), (wider, own2)]
        for one, two in walks:
            if one and two:
                yield from traverse(one, two)


def set_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two leaves, those of a leaf with itself once."""
    i, j = np.repeat(left, len(right)), np.tile(right, len(left))
    once = i < j if left is right or np.array_equal(left, right) else np.ones(len(i), bool)
    return i[once], j[once]


def by_side(side: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """The rows that are compared among themselves, or those of side 1 and those of side 2."""
    if not side[rows].any():
        return rows, None
    return rows[side[rows] == 1], rows[side[rows] == 2]


def with_partner(table: pa.Table) -> pa.Table:
    """Of some keys' groups: the sets that have a partner there by bitmaps, and with no earlier key."""
    table = table.sort_by("key")
    key, rid, n, slot, side, name = (table.column(c).to_numpy()
                                     for c in ("key", "rid", "n", "pos", "side", "name"))
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), "<u4").reshape(len(key), BANDS)
    maps = Bitmaps(n, table.column("map").to_pylist(), marks[np.arange(len(key)), slot - 1])
    found = np.zeros(len(key), bool)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        for at in range(0, len(i), 20_000):
            x, y = i[at:at + 20_000], j[at:at + 20_000]
            first = (marks[x] == marks[y]).argmax(1) >= slot[x]
            x, y = x[first], y[first]
            linked = maps.may_link(x, y)
            found[x[linked]] = found[y[linked]] = True

    cuts = np.array([0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)])
    sizes = np.diff(cuts)
    # groups of one leaf, those of a size at once
    alone = (sizes <= LEAF) & (np.maximum.reduceat(side, cuts[:-1]) == 0)
    for size in np.unique(sizes[alone]).tolist():
        a, b = np.triu_indices(size, 1)
        start = cuts[:-1][alone & (sizes == size)][:, None]
        meet((start + a).ravel(), (start + b).ravel())
    for group in np.flatnonzero(~alone).tolist():
        members, others = by_side(side, np.arange(cuts[group], cuts[group + 1]))
        for left, right in leaf_pairs(maps, members, others):
            if not (found[left].all() and found[right].all()):
                meet(*set_pairs(left, right))
    return pa.table([name[found], rid[found]], ["key", "rid"])


def tree_links(sets: list[np.ndarray], side: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that span the groups among these sets; between sides 1 and 2 only, where those are given."""
    maps = Bitmaps(np.array([len(s) for s in sets]), [bitmap(s) for s in sets], np.array([s[0] for s in sets]))
    groups = Groups(len(sets))
    for left, right in leaf_pairs(maps, *by_side(side, np.arange(len(sets)))):
        if len({groups.root(m) for m in (*left.tolist(), *right.tolist())}) > 1:
            yield from leaf_links(sets, maps, left, right, groups)


def leaf_links(sets: list[np.ndarray], maps: Bitmaps, left: np.ndarray, right: np.ndarray,
               groups: Groups) -> Iterator[tuple[int, int]]:
    """Compares two leaves exactly, and of them the pairs that their own bitmaps allow."""
    i, j = set_pairs(left, right)
    close = maps.may_link(i, j)
    i, j = i[close], j[close]
    both = np.unique(np.concatenate([i, j]))
    if len(i) > len(both) and maps.n[both].sum() <= DENSE:
        # every token is a column; single-precision sums are exact below 2 ** 24 tokens
        tokens, column = np.unique(np.concatenate([sets[m] for m in both]), return_inverse=True)
        held = np.zeros((len(both), len(tokens)), np.float32)
        held[np.repeat(np.arange(len(both)), maps.n[both]), column] = 1
        product = (held @ held.T).astype(np.int64)
        shared = product[np.searchsorted(both, i), np.searchsorted(both, j)]
        linked = enough(shared, maps.n[i] + maps.n[j])
        i, j = i[linked], j[linked]
        exact = True
    else:
        exact = False
    for a, b in zip(i.tolist(), j.tolist()):
        if groups.root(a) != groups.root(b) and (exact or links(sets[a], sets[b])):
            groups.join(a, b)
            yield a, b


def links(one: np.ndarray, two: np.ndarray) -> bool:
    small, large = sorted((one, two), key=len)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    return bool(enough((large[at] == small).sum(), len(one) + len(two)))


def exact_links(size: int):
    """Of the keys' sets in a task: links that span their groups."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("rid", "ascending")])
        key, rid, side = (table.column(c).to_numpy() for c in ("key", "rid", "side"))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        edges = []
        text = table.column("text")
        for start, end in zip(cuts, cuts[1:]):
            rows = np.arange(start, end)
            rows = rows[np.unique(rid[start:end], return_index=True)[1]]  # a row given twice
            sets = [shingles(text[int(r)].as_py(), size) for r in rows]
            if len(sets) > 1 and len(set(side[rows].tolist())) == (2 if side[rows].max() else 1):
                edges += [(int(rid[rows[a]]), int(rid[rows[b]])) for a, b in tree_links(sets, side[rows])]
        pairs = np.array(edges, np.int64).reshape(-1, 2)
        return pa.table([pairs[:, 0], pairs[:, 1]], ["u", "v"])

    return run


def in_blocks(df: DataFrame, group: str, blocks: Column, task: Column) -> DataFrame:
    """Rows with the task they go to: groups that need several blocks are dealt into them by hash.

    Each pair of blocks is a task, with the rows of one as side 1 and of the other as side 2; a block
    with itself, or a small group, has side 0.
    """
    mine = F.pmod(F.xxhash64("rid", F.lit("block")), F.col("_blocks"))
    dealt = df.withColumn("_blocks", blocks.cast("long")).withColumn("_mine", mine)
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    dealt = dealt.withColumn("_other", others)
    side = F.when(F.col("_mine") == F.col("_other"), 0).when(F.col("_mine") < F.col("_other"), 1).otherwise(2)
    pair = F.xxhash64(group, F.least("_mine", "_other"), F.greatest("_mine", "_other"))
    return (dealt.withColumn("side", side.cast("int"))
            .withColumn(group, F.when(F.col("_blocks") > 1, pair).otherwise(F.col(group)))
            .withColumn("task", F.when(F.col("_blocks") > 1, pair).otherwise(task))
            .drop("_blocks", "_mine", "_other"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   size: int = SHINGLE) -> DataFrame:
    """Of every row: id, rid (a hash of id and text), n (size of its set), group (smallest id) and root.

    root is one number for each group and no other's; it is null for an empty set.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("rid", F.xxhash64("id", "text"))
    id_type = rows.schema["id"].dataType
    arrow_id = to_arrow_type(id_type)
    described = saved(rows.mapInArrow(lambda b: describe(b, size, arrow_id),
                                      SETS.format(id=id_type.simpleString())))
    # 1. one row for each set; its number is the least rid
    sets = saved(described.where("name IS NOT NULL").groupBy("name").agg(
        F.min("rid").alias("rid"), F.min("id").alias("id"), F.first("n").alias("n"),
        F.first("keys").alias("keys"), F.first("marks").alias("marks"), F.first("map").alias("map")))
    # 2. sets that share a key; those that are alone with a key go no further
    keyed = sets.select("rid", F.posexplode("keys")).select(
        "rid", "pos", F.xxhash64("pos", "col").alias("key"))
    shared = saved(keyed.withColumn("count", F.count("*").over(Window.partitionBy("key")))
                   .where("count > 1").join(sets.select("rid", "n", "marks", "map"), "rid")
                   .withColumn("name", F.col("key")))
    tasks = 1 + shared.count() // KEY_ROWS
    met = in_blocks(shared, "key", F.ceil(F.col("count") / CHUNK), F.pmod("key", F.lit(tasks)))
    near = (met.select("task", "key", "name", "pos", "rid", "n", "marks", "map", "side").groupBy("task")
            .applyInArrow(with_partner, "key long, rid long").distinct().join(sets.select("rid", "n"), "rid"))
    near = saved(near)
    # 3. exact links between the sets of a key, from whole texts
    blocks = near.groupBy("key").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    total = near.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    tasks = 1 + max(total["rows"] // BLOCK, (total["n"] or 0) // BLOCK_SHINGLES)
    # merged at every size: what is joined to the texts grows with them
    whole = near.join(blocks, "key").join(rows.select("rid", "text").hint("merge"), "rid")
    members = in_blocks(whole, "key", F.col("blocks"), F.pmod(F.xxhash64("key"), F.lit(tasks)))
    links = members.select("task", "key", "rid", "text", "side").groupBy("task").applyInArrow(
        exact_links(size), "u long, v long")
    # 4. groups; sets without a link are their own
    roots = components(links).withColumnRenamed("node", "rid")
    grouped = sets.select("name", "rid", "id").join(roots, "rid", "left").withColumn(
        "root", F.coalesce("root", "rid"))
    named = grouped.groupBy("root").agg(F.min("id").alias("group"))
    by_set = grouped.select("name", "root").join(named, "root").select("name", "group", "root")
    out = described.select("id", "rid", "n", "name").join(by_set, "name", "left")
    return out.select("id", "rid", "n", F.when(F.col("name").isNull(), F.col("id"))
                      .otherwise(F.col("group")).alias("group"), "root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each group: that with the smallest id (and text hash, for equal ids).

    Rows with an empty set are in no group and all stay.
    """
    key, empty, at = fresh(docs, "rid"), fresh(docs, "empty"), fresh(docs, "at")
    groups = similar_groups(docs, doc_id, text, size)
    first = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "rid")
    linked = groups.where("n > 0").withColumn("at", F.row_number().over(first)).where("at = 1")
    kept = linked.select(F.col("rid").alias(key), F.lit(False).alias(empty)).unionByName(
        groups.where("n = 0").select(F.col("rid").alias(key), F.lit(True).alias(empty)).distinct())
    marked = docs.withColumn(key, F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`")))
    # rows that are given twice have one hash
    again = Window.partitionBy(key).orderBy(key)
    out = marked.join(kept, key).withColumn(at, F.row_number().over(again))
    return out.where(F.col(empty) | (F.col(at) == 1)).select(*[F.col(f"`{c}`") for c in docs.columns])
