"""SimHash near-dedup: fingerprints of word shingles, blocks of equal bits, Hamming check, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, map_arrow, ordered, row_hashes, save, unused

SEED = 42
#: Buckets of more fingerprints are linked by bit flips instead of in pairs.
PAIRWISE = 64


def fingerprint(text: bytes, shingle: int, words: int = 1) -> list[int]:
    """``words`` times 64 bits, as signed numbers; a bit is 1 if it is set in over half the shingles' hashes.

    The first word's hash is XXH64 (seed 42), the others mix that with their number.
    """
    norm = b" ".join(text.lower().split())  # bytes: lowers A-Z only, splits at ASCII white space only
    if not norm:
        return [0] * words
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) < shingle:
        hashes = [xxhash.xxh64_intdigest(norm, SEED)]
    else:
        starts = [0, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(norm)]
        hashes = [xxhash.xxh64_intdigest(norm[i:j], SEED) for i, j in zip(starts, ends, strict=True)]
    return majority(np.array(hashes, "<u8"), words).tolist()


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """The bits of ``fingerprint`` over these hashes, a signed number a word."""
    ones = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 14)]
        for w in range(words):
            mixed = part if not w else _mix(part + np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            ones[w] += np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(``keep``, fp long) of every document's whole text; with more ``words``, (``keep``, fp, fp1, ...). Columns kept are longs.

    Texts with fewer words are one shingle; null texts and texts without words have fingerprint 0.
    """

    names = ["fp", *(f"fp{w}" for w in range(1, words))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                fps = [fingerprint(t or b"", shingle, words) for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(c, pa.int64()) for c in zip(*fps, strict=True))], names=[*keep, *names])

    rows = docs.select(*[F.col(c).cast("long").alias(c) for c in keep], F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, ", ".join(f"{c} long" for c in [*keep, *names]))


def _keys(bits: int, blocks: int | None = None) -> list[int]:
    """Masks of the blocks whose equality makes a bucket: of ``blocks``, all but ``bits`` stay equal in every close pair."""
    blocks = blocks or bits + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(masks, blocks - bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at ``bits`` or fewer differing bits that connect all such pairs.

    ``fps`` has the distinct fingerprints. They are split into bits + 2 blocks; a close pair agrees on two blocks at
    least, so it meets in the bucket of those two. In a bucket of up to PAIRWISE fingerprints pairs are joined and
    verified. A larger bucket (a group of near copies may hold a third of all) would make pairs in the square of its
    size. There, for 2 bits, each fingerprint emits itself and its one-bit changes outside the equal blocks: two
    share such a key if and only if they differ in 2 bits or fewer, so linking each to the key's smallest joins the
    same components with rows in proportion to the bucket. For other distances all buckets are joined in pairs.
    """
    masks = _keys(bits)
    spread = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)])).alias("k"))
    rows = spread.select(F.xxhash64("k.block", "k.part").alias("key"), F.col("k.block").cast("byte").alias("block"), "fp")
    close = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= bits
    sizes = save(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    met = attach(rows, sizes, "key", [F.col("fp")]).filter("n > 1")
    met = save(met)
    few = met if bits != 2 else met.filter(F.col("n") <= PAIRWISE)
    a, b = few.select("key", "block", F.col("fp").alias("a")), few.select("key", "block", F.col("fp").alias("b"))
    found = a.join(b, ["key", "block"]).filter((F.col("a") < F.col("b")) & close(F.col("a"), F.col("b"))).select("a", "b")
    if bits == 2:
        flips = [F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]
        many = met.filter(F.col("n") > PAIRWISE).withColumn("flip", F.explode(F.element_at(F.array(*flips), F.col("block").cast("int") + 1)))
        many = many.select("key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
        stars = save(many.groupBy("key", "z").agg(F.min("fp").alias("a"), F.max("fp").alias("last"), F.count("*").alias("n")).filter("n > 1"))
        at = F.xxhash64("key", "z")
        star = attach(many.withColumn("at", at), stars.select(at.alias("at"), "a", "n"), "at", [F.col("fp")])
        found = found.unionByName(star.filter((F.col("a") < F.col("fp")) & close(F.col("a"), F.col("fp"))).select("a", F.col("fp").alias("b")))
    return found.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) for every node of the pairs (a, b): root is the smallest node it reaches.

    Alternating large-star and small-star rounds, each a grouped minimum and a join, until the edges stay the same;
    their number grows with the logarithm of a component's size. A hub's minimum is combined before the shuffle and
    its edges are joined through ``attach``, so no task holds a hub's neighbours.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Neighbours larger than a node (large) or smaller than it link to the smallest around instead."""
        if large:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        both = both.distinct()
        low = save(both.groupBy("a").agg(F.min("b").alias("m0"), F.count("*").alias("n")).select("a", F.least("a", "m0").alias("m"), "n"))
        met = attach(both, low, "a", [F.col("b")])
        if large:
            out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return save(out.filter("a <> b").distinct())

    edges, seen = save(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen, edges = now, star(star(edges, True), False)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def group(docs: DataFrame, shingle: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) of every document: component_id is the smallest doc_id reachable through links.

    Documents with equal fingerprints are one class and only classes are linked. Null doc_ids take part but never
    name a component that has others; a component of null ids alone has a null id. Repeated rows are all returned.
    Empty table: no rows.
    """
    fps = save(fingerprints(docs, shingle))
    classes = save(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = save(components(links(classes.select("fp"), bits)))
    rooted = save(classes.join(found, classes["fp"] == found["node"], "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    facts = attach(rooted, save(named), "root", [F.col("fp")], count="classes").select("fp", "component_id", "n")
    return attach(fps, save(facts), "fp", [F.col("doc_id")]).drop("n")


#: Near-duplicates by similarity: 64-bit words of a set's fingerprint; rows that a block's bucket holds, about; rows of a
#: bucket from which on it is dealt out over several tasks; misses of a pair by all blocks, as a power of 1/e.
WORDS, BUCKET, SPLIT, MISS = 4, 2048, 6144, 9
FP = [f"f{w}" for w in range(WORDS)]


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct XXH64 (seed 42) of a text's word shingles, cut as in ``fingerprint``; none without words."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) < shingle:
        return np.array([xxhash.xxh64_intdigest(norm, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) - shingle + 1] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(norm)]
    return np.unique(np.array([xxhash.xxh64_intdigest(norm[i:j], SEED) for i, j in zip(starts, ends, strict=True)], np.uint64))


def differing(similarity: float) -> float:
    """Share of the bits in which fingerprints of sets of this Jaccard similarity (the bound, at equal sizes) differ on average."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def blocks(similarity: float, count: int) -> np.ndarray:
    """Masks (block, word) of bits drawn by a fixed seed. Fingerprints equal in one block's bits are compared.

    So many bits a block that unlike fingerprints, ``count`` in all, fill its buckets with about BUCKET rows; so many
    blocks that a pair of this similarity agrees in none with probability exp(-MISS), at the mean distance.
    """
    width = min(32, max(4, (count // BUCKET).bit_length() - 1))
    number = math.ceil(MISS / (1 - differing(similarity)) ** width)
    rng = np.random.default_rng(SEED)
    per = 64 * WORDS // width
    bits = np.concatenate([rng.permutation(64 * WORDS)[: per * width].reshape(per, width) for _ in range(-(-number // per))])[:number]
    masks = np.zeros((number, WORDS), np.uint64)
    for i in range(width):
        masks[np.arange(number), bits[:, i] // 64] |= np.uint64(1) << (bits[:, i] % 64).astype(np.uint64)
    return masks.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64)))


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h1, h2, s1, s2, size, f0, ...): 128 bits that name the text's set of shingles, its size and its fingerprint."""
    names = ["s1", "s2", "size", *FP]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sets = [shingles(t or b"", shingle) for t in b.column(3).to_pylist()]
                named = [pa.array([xxhash.xxh64_intdigest(x.tobytes(), i) for x in sets], pa.uint64()).view(pa.int64()) for i in (1, 2)]
                fps = np.stack([majority(x, WORDS) for x in sets])
                columns = [*b.columns[:3], *named, pa.array(map(len, sets), pa.int64()), *(pa.array(fps[:, w]) for w in range(WORDS))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "h1", "h2", F.col("text").cast("binary").alias("text"))
    return map_arrow(rows, run, ", ".join(f"{c} long" for c in ["doc_id", "h1", "h2", *names]))


def close_rows(fps: np.ndarray, sizes: np.ndarray, groups: np.ndarray, similarity: float, star: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits), i < j, for rows of different groups whose fingerprints may belong to sets of this similarity, some at a time.

    Fingerprints may differ in 4.5 standard deviations more bits than the mean, five in the first word, which is looked
    at first. All such pairs; with ``star``, a row meets the first it is close to and is left out from then on.
    """
    p = differing(similarity)
    near, far = (int(n * p + z * math.sqrt(n * p * (1 - p))) for n, z in ((64, 5), (64 * WORDS, 4.5)))
    fps, left = fps.view(np.uint64), np.arange(len(fps))
    while len(left) > 1 and (star or len(np.unique(groups[left])) > 1):
        top = left[:128]
        i, j = np.nonzero(np.bitwise_count(fps[top, 0][:, None] ^ fps[left, 0][None, :]) <= near)
        i, j = top[i], left[j]
        some = (i < j) & (groups[i] != groups[j]) & (np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]))
        i, j = i[some], j[some]
        bits = np.bitwise_count(fps[i] ^ fps[j]).sum(1, dtype=np.int64)
        i, j, bits = i[bits <= far], j[bits <= far], bits[bits <= far]
        left = left[128:]
        if star:
            j, first = np.unique(j, return_index=True)  # rows come in order, so the first is the smallest
            i, bits, left = i[first], bits[first], np.setdiff1d(left, j, assume_unique=True)
        yield i, j, bits


def _partners(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(node, others) of the pairs (a, b), each on both sides."""
    node, other = np.concatenate([a, b]), np.concatenate([b, a])
    order = np.argsort(node, kind="stable")
    nodes, starts = np.unique(node[order], return_index=True)
    ends = pa.array(np.append(starts, len(node)).astype(np.int32))
    return pa.table([pa.array(nodes), pa.ListArray.from_arrays(ends, pa.array(other[order]))], names=["node", "others"])


def _met(rows: DataFrame, masks: np.ndarray, similarity: float, star: bool) -> DataFrame:
    """(node, others): the rows (node, size, root, fingerprint) that share a block's bits with it and pass ``close_rows``, on both sides of a pair.

    A bucket of more than SPLIT rows is dealt out over several tasks. With ``star`` each of its parts stands for itself,
    what that leaves meets later, and of a row's pairs with smaller ones the closest is returned. Else the rows of a
    bucket's largest group go to one part each and the others to all parts, so that every pair of different groups meets;
    it is returned by the first block in which it agrees. Lists keep a row a node where each of a group is like each.
    """
    shared = [F.struct(F.lit(i).alias("block"), F.xxhash64(*[F.col(c).bitwiseAND(F.lit(x)) for c, x in zip(FP, m, strict=True)]).alias("part")) for i, m in enumerate(masks.tolist())]
    rows = rows.select("node", "size", "root", *FP, F.explode(F.array(*shared)).alias("at")).select("node", "size", "root", *FP, "at.block", F.col("at.part").alias("key"))
    hot = save(rows.groupBy("block", "key").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).withColumn("parts", F.ceil(F.col("n") / SPLIT).cast("int")))
    if not star:
        groups = rows.join(F.broadcast(hot), ["block", "key"]).groupBy("block", "key", "parts", "root").agg(F.count("*").alias("n"))
        hot = save(groups.groupBy("block", "key", "parts").agg(F.max_by("root", F.struct("n", "root")).alias("top")))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = F.lit(True) if star else F.col("root") == F.col("top")
    part = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(dealt, F.array(mine)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    rows = rows.join(F.broadcast(hot), ["block", "key"], "left").withColumn("part", F.explode(part)).select("block", "key", "part", dealt.cast("int").alias("dealt"), "node", "size", "root", *FP)

    def run(table: pa.Table) -> pa.Table:
        t = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.argsort(t["node"])
        t = {c: x[order] for c, x in t.items()}
        fps, found = np.stack([t[c] for c in FP], axis=1), [[np.zeros(0, np.int64)] * 3]
        for i, j, bits in close_rows(fps, t["size"], t["node"] if star else t["root"], similarity, star):
            if not star:
                new = np.full(len(i), True) if not t["part"][0] else (t["dealt"][i] == 1) | (t["dealt"][j] == 1)
                for mask in masks[: t["block"][0]]:
                    new &= ((fps[i] ^ fps[j]) & mask).any(1)
                i, j, bits = i[new], j[new], bits[new]
            found.append([t["node"][i], t["node"][j], bits])
        a, b, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([a, b, bits], names=["a", "b", "bits"]) if star else _partners(a, b)

    grouped = rows.groupBy("block", "key", "part")
    if not star:
        return grouped.applyInArrow(run, "node long, others array<long>").groupBy("node").agg(F.flatten(F.collect_list("others")).alias("others"))
    pairs = grouped.applyInArrow(run, "a long, b long, bits long").groupBy("b").agg(F.min(F.struct("bits", "a")).alias("x")).select("x.a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("others"))


def _bags(docs: DataFrame, wanted: DataFrame, shingle: int, bound: int = 500_000) -> DataFrame:
    """(node, bag): the sets of shingles of the rows (node, doc_id, h1, h2) of ``wanted``, which is broadcast up to ``bound`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(t or b"", shingle) for t in b.column(1).to_pylist()])], names=["node", "bag"])

    few = wanted.count() <= bound
    w = (F.broadcast(wanted) if few else wanted).select("node", F.col("doc_id").alias("w0"), F.col("h1").alias("w1"), F.col("h2").alias("w2"))
    rows = docs.join(w, F.col("doc_id").cast("long").eqNullSafe(F.col("w0")) & (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2")))
    return map_arrow(rows.select("node", F.col("text").cast("binary").alias("text")), run, "node long, bag array<long>").dropDuplicates(["node"])


def _alike(met: DataFrame, docs: DataFrame, classes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b), a < b, of the classes (node, others) whose sets have at least this Jaccard similarity, which is exact.

    Nodes are hashed into groups, and a set goes once to each pair of groups that has one of its pairs.
    """
    met = save(met)
    wanted = save(met.select("node").join(classes.select("node", "size", "least.doc_id", "least.h1", "least.h2"), "node"))
    bags = save(_bags(docs, wanted.drop("size"), shingle))
    groups = max(8, (wanted.agg(F.sum("size")).first()[0] or 0) >> 22)  # 32 MB of hashes each
    of = lambda node: F.pmod(F.xxhash64(node), F.lit(groups)).cast("int")
    rows = met.join(bags, "node").withColumn("mine", of("node")).withColumn("theirs", F.explode(F.array_distinct(F.transform("others", of))))
    some = F.filter("others", lambda x: (x > F.col("node")) & (of(x) == F.col("theirs")))
    rows = rows.select(F.least("mine", "theirs").alias("low"), F.greatest("mine", "theirs").alias("high"), "node", "bag", some.alias("others"))

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        order = np.argsort(nodes)
        bags, others = table.column("bag").combine_chunks(), table.column("others").combine_chunks()
        bag = lambda i: bags[int(i)].values.to_numpy()
        found = [[np.zeros(0, np.int64)] * 2]
        for i, node in enumerate(nodes):
            wanted = others[i].values.to_numpy()
            for at in range(0, len(wanted), 1000):
                b = wanted[at : at + 1000]
                theirs = [bag(k) for k in order[np.searchsorted(nodes, b, sorter=order)]]
                mine = np.sort(bag(i))
                every, sizes = np.concatenate(theirs), np.array([len(x) for x in theirs])
                spots = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
                both = np.add.reduceat((mine[spots] == every).astype(np.int64), np.cumsum(sizes) - sizes)
                like = b[both / (len(mine) + sizes - both) >= similarity]
                found.append([np.full(len(like), node), like])
        return pa.table([np.concatenate(x) for x in zip(*found, strict=True)], names=["a", "b"])

    return save(rows.groupBy("low", "high").applyInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h1, h2, stays) of saved rows: of each group of near copies by word shingles, the row that stays.

    ``docs`` has doc_id, text and two hashes of the row. Rows with equal sets of shingles are one class, numbered by its
    smallest row. Classes whose SimHash fingerprints agree in all bits of a block (see ``blocks``) and differ in few bits
    overall are candidates, and candidates whose sets have the wanted Jaccard similarity are linked. First, as long as
    that takes many away, every class meets the smallest one close to it in each of its buckets; a class linked to a
    smaller one has its group and leaves these rounds, so a family of near copies costs rows in proportion to its size.
    Then, in each bucket, all classes meet those of other groups, also the ones that left, so the groups are the
    components of all linked pairs of candidates. The smallest row of a group's smallest class stays.
    """
    fps = save(signatures(docs, shingle))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "h1", "h2")
    classes = fps.groupBy("s1", "s2").agg(F.min(row).alias("least"), *[F.first(c).alias(c) for c in ("size", *FP)])
    classes = save(ordered(classes, [F.col("least")], "node"))
    count = classes.count()
    masks = blocks(similarity, count)
    rows = classes.filter("size > 0").select("node", "size", *FP)
    alike = lambda pairs: _alike(pairs, docs, classes, shingle, similarity)
    left, links = rows, None
    for _ in range(5):  # how many rounds run decides what the last step costs, not what it links
        found = alike(_met(left.withColumn("root", F.col("node")), masks, similarity, True))
        links = found if links is None else links.unionByName(found)
        gone = save(found.select(F.col("b").alias("node")).distinct())
        absorbed = gone.count()
        if absorbed * 5 <= count:
            break
        left = save(left.join(gone, "node", "left_anti"))
    roots = save(components(links))
    rooted = save(rows.join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), *FP))
    links = links.unionByName(alike(_met(rooted, masks, similarity, False)))
    below = save(components(links)).filter("node <> root").select("node").distinct()
    tops = classes.join(below, "node", "left_anti").select("least.doc_id", "least.h1", "least.h2")
    same = [fps["doc_id"].eqNullSafe(tops["doc_id"]), fps["h1"] == tops["h1"], fps["h2"] == tops["h2"]]
    return save(fps.join(tops.withColumn("stays", F.lit(True)), same, "left").select(fps["doc_id"], fps["h1"], fps["h2"], F.coalesce("stays", F.lit(False)).alias("stays")))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bound: int = 500_000) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group, the row with the smallest doc_id (null ids last).

    Ids may repeat or be null and texts may be null; those without words are copies of each other. All columns are kept,
    whatever they are called. Rows that equal each other in all columns are one row. The hashes of the rows that go are
    broadcast if a count shows that there are at most ``bound``, else joined by a shuffle; texts are not shuffled otherwise.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    h1, h2 = row_hashes(docs)
    decided = near_duplicates(docs.select("doc_id", "text", h1.alias("h1"), h2.alias("h2")), shingle, similarity)
    a, b = unused(docs.columns, "h1"), unused(docs.columns, "h2")
    gone = save(decided.filter("not stays").select("h1", "h2").distinct())
    if gone.count() <= bound:
        gone = F.broadcast(gone)
    rows = docs.withColumns({a: h1, b: h2}).join(gone.toDF(a, b), [a, b], "left_anti")
    if decided.filter("stays").groupBy("h1", "h2").count().filter("count > 1").limit(1).count():
        rows = rows.dropDuplicates([a, b])
    return rows.select(*columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, empty texts, repeats and empty tables as in ``group``."""
    found = group(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
