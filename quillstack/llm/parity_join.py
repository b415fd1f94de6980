"""Near-duplicate groups by an exact Jaccard self-join on word shingles.

Two sets A, B with J(A, B) >= num/den differ in at most d = (den-num)(|A|+|B|) / (den+num)
shingles.  XOR hashes turn a set into sketches whose distance bounds that difference from
below, so no link is lost:

* *Blocks.*  The top bits of a shingle's hash deal it to one of 2^j blocks, and a block holds
  the XOR of its shingles' hashes.  A shingle that only one set has changes one block, so of
  any d+1 blocks one is the same in both (pigeonhole).  j depends on d alone, so a set joins
  at every j that a partner's size can ask for (two at most), with its first D+1 blocks that
  aren't empty, D being the largest d of that j.  Of two such lists the shorter-reaching one
  has a block in common with the other.  A set with fewer than D+1 blocks that aren't empty
  gives all of them, and its D+1 smallest hashes besides, for partners in the same case.
* *Bits.*  Each shingle flips one of B bits, B between 2 and 4 times the size of the set (512
  at least); a candidate pair whose Hamming distance is over d is dropped.  Sketches fold to
  half their width by XOR of their halves, so sets of different B compare, and a fold to 512
  bits is tested first.

Sets that are equal are one class from the start.  In each group of equal blocks the members
are first compared with the smallest class only, and what is linked becomes one component;
after that, pairs of one group in different components are compared, all of them.  Copies are
thus never expanded into pairs, and no group is gathered in a task: groups are aggregated
before the shuffle, and rows meet their group in joins that Spark can split.  Of groups with the
same members, as a passage makes one for each of its blocks, one is compared.  Groups are compared
from the smallest on while that takes no more than ``PAIRS`` pairs for each of their members, so pairs grow
with the input; larger ones are crowds, as a passage makes of the texts that share it.  The sets of crowds meet by their
rarest blocks instead, and those of the crowds that are left by their rarest shingles
(``_uncrowded``): prefixes of a ninth and a fifth of the smaller and the larger set.  What stays
quadratic are texts of which one passage is more than 4/5 of the larger and 8/9 of the smaller of two,
and which aren't linked: similar to between 0.72 and 0.8.

Sets are kept as 64-bit hashes of their shingles, and sets are taken as equal if their sizes and two
64-bit hashes of all shingles are; a false link needs a collision of such hashes.

Edge cases: null and empty texts and texts of spaces have an empty set and link with nothing;
a text of fewer than ``width`` words is one shingle; repeated rows are linked like any other equal
texts; rows of one id with different texts are documents of their own, with a size and a component
each; rows with a null id belong to the component of documents with an equal set, else to none,
and link nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free_names, job, map_arrow, release, stored
from .tokens import slices

WIDTH = 5
NUM, DEN = 4, 5
CROWD = 512
PAIRS = 8  # compared for each member of a group, before the sets of larger groups move to rarer signatures: moving one shuffles all it has
BITS = [f"k{i}" for i in range(8)]
_P = np.uint64(0x9E3779B97F4A7C15)
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of all texts, ascending within each; offsets of each text)."""
    n = len(texts)
    cut = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    at = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    coded = cut.flatten().dictionary_encode()
    words = pc.ascii_lower(coded.dictionary).to_pandas().to_numpy(object)
    hashed = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    real = (np.array([bool(w) for w in words], bool) if len(words) else np.zeros(0, bool))[code]
    of = hashed[code][real]
    at = np.concatenate(([0], np.cumsum(real)))[at]
    sizes = np.diff(at)
    found: list[np.ndarray] = []
    empty = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        whole = np.zeros(max(len(of) - width + 1, 0), np.uint64)
        for k in range(width):
            whole = whole * _P + of[k : k + len(whole)] if len(whole) else whole
        whole = _mix(whole)
        for lo, size in zip(at[:-1].tolist(), sizes.tolist(), strict=True):
            if size >= width:
                found.append(np.unique(whole[lo : lo + size - width + 1]))
            elif size:
                h = np.full(1, size * 0x632BE59BD9B4E019 % 2**64, np.uint64)
                for w in of[lo : lo + size]:
                    h = h * _P + w
                found.append(_mix(h))
            else:
                found.append(empty)
    counts = np.fromiter(map(len, found), np.int64, n)
    return np.concatenate(found) if found else empty, np.concatenate(([0], np.cumsum(counts)))


def _most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def _level(d: np.ndarray) -> np.ndarray:
    """Bits of the number of blocks for a difference of at most d: 2^j >= 1.2 (d + 1)."""
    return np.ceil(np.log2(1.2 * (np.maximum(d, 1) + 1))).astype(np.int64)


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all sets, offsets of each): of each list of ``signature_lists`` as many as it needs."""
    owner, _, rank, need, sig = signature_lists(hashes, bounds)
    first = rank < need
    return sig[first], np.concatenate(([0], np.cumsum(np.bincount(owner[first], minlength=len(bounds) - 1))))


def signature_lists(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, list, rank, need, signature), by owner: the blocks that aren't empty of each level, and the
    hashes of sets with too few of them, in order.  Sets that are similar enough have a signature in common
    among the first ``need`` of a list, in this or any other order that is the same for all sets."""
    n = np.diff(bounds)
    lowest, highest = _most(n, -(-n * NUM // DEN)), _most(n, n * DEN // NUM)
    doc = np.repeat(np.arange(len(n)), n)
    value = _mix(hashes ^ _P)
    found: list[tuple[np.ndarray, ...]] = []
    levels = _level(highest)

    def emit(own: np.ndarray, level: np.ndarray, d: np.ndarray) -> None:
        """own: which sets; level and d: their blocks' bits and D."""
        d_of, j_of = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
        d_of[own], j_of[own] = d, level
        mine = np.flatnonzero(d_of[doc] > 0)
        if not len(mine):
            return
        h, v, of = hashes[mine], value[mine], doc[mine]
        block = h >> (64 - j_of[of]).astype(np.uint64)
        new = np.ones(len(h), bool)
        new[1:] = (of[1:] != of[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        held = np.bitwise_xor.reduceat(v, first)
        owner, block = of[first], block[first]
        filled = np.bincount(owner, minlength=len(n))
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(filled) - filled, filled)
        j = j_of[owner].astype(np.uint64)
        found.append((owner, 2 * j_of[owner], rank, d_of[owner] + 1, _mix(held ^ _mix((block << _U(8)) ^ j))))
        short = (d_of > 0) & (filled <= d_of)
        if short.any():
            size = np.bincount(of, minlength=len(n))
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            least = short[of]
            of, place, v = of[least], place[least], v[least]
            found.append((of, 2 * j_of[of] + 1, place, d_of[of] + 1, _mix(v + j_of[of].astype(np.uint64) + _U(0x5851F42D4C957F2D))))

    with np.errstate(over="ignore"):
        has = np.flatnonzero(highest > 0)
        emit(has, levels[has], highest[has])
        below = np.flatnonzero((lowest > 0) & (_level(lowest) < levels))
        if len(below):
            # the largest d of the lower level
            top = (2.0 ** _level(lowest[below]) / 1.2).astype(np.int64) - 1
            top = np.where(_level(top + 1) == _level(lowest[below]), top + 1, top)
            emit(below, _level(lowest[below]), np.minimum(top, highest[below]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    whole = [np.concatenate(x) for x in zip(*found, strict=True)]
    order = np.argsort(whole[0], kind="stable")
    return tuple(x[order] for x in whole)


def shingle_lists(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """As ``signature_lists``, of single shingles: the first ``need`` of a set, in any order that is the same for all, hold
    one of the first ``brief`` of a similar set that isn't larger."""
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(n)), n)
    rank = np.arange(len(owner)) - np.repeat(bounds[:-1] - bounds[0], n)
    need, brief = n + 1 + -n * NUM // DEN, n + 1 + -2 * n * NUM // (DEN + NUM)
    with np.errstate(over="ignore"):
        sig = _mix(hashes + _U(0x2545F4914F6CDD1D))
    return owner, np.zeros(len(owner), np.int64), rank, need[owner], brief[owner], sig


def sketches(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(512 parity bits a set, as 8 signed 64-bit numbers; all sets' wide sketches, offsets of each)."""
    n = np.diff(bounds)
    width = 2 ** np.ceil(np.log2(np.maximum(2 * n, 512))).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(width)))
    bit = (hashes & np.repeat((width - 1).astype(np.uint64), n)).astype(np.int64) + np.repeat(ends[:-1], n)
    odd = (np.bincount(bit, minlength=int(ends[-1])) & 1).astype(np.uint8)
    wide = np.packbits(odd, bitorder="little").view("<i8")
    short = np.bitwise_xor.reduceat(wide.reshape(-1, 8), ends[:-1] // 512) if len(n) else np.zeros((0, 8), np.int64)
    return short, wide, ends // 64


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _checksums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set."""
    out = np.zeros((2, len(bounds) - 1), np.uint64)
    filled = np.diff(bounds) > 0
    if len(h):
        with np.errstate(over="ignore"):
            out[0, filled] = np.bitwise_xor.reduceat(_mix(h + _U(1)), bounds[:-1][filled])
            out[1, filled] = np.add.reduceat(_mix(h + _U(2)), bounds[:-1][filled])
    return out


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, t (hash of the text), n, two hashes of the set, its bits and its block hashes, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                h, bounds = shingles(part.column("text"), width)
                n = np.diff(bounds)
                sums = _checksums(h, bounds)
                bits, wide, ends = sketches(h, bounds)
                arrays = [part.column("doc_id"), part.column("t"), pa.array(n), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(8)), _lists(wide, ends), _lists(*signatures(h, bounds))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "t", "n", "s1", "s2", *BITS, "wide", "blocks"])

    schema = "doc_id long, t long, n long, s1 long, s2 long, " + ", ".join(f"{k} long" for k in BITS) + ", wide array<long>, blocks array<long>"
    return map_arrow(docs.select("doc_id", "t", "text"), run, schema)


class _Texts:
    """Whole texts of sets, read again where they are needed: of the row whose id and text hash stand for the set.

    Texts are picked by their ids, a table of one column that is as small as can be; what else has such an id
    goes when sets meet their nodes by id and text hash."""

    def __init__(self, docs: DataFrame, keys: DataFrame, classes: DataFrame, width: int):
        self.docs, self.width = docs, width
        self.of_node = classes.select("node", "doc_id", "t")
        again = keys.groupBy("doc_id", "t").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id", "t")
        self.again = stored(again, "join-again")
        self.repeats = not self.again.isEmpty()

    def _mapped(self, wanted: DataFrame, run, schema: str, *once: str) -> DataFrame:
        """run over the texts of ids; of what repeated rows give one row of each ``once``."""
        ids = stored(wanted.distinct(), "join-asked")
        found = stored(map_arrow(self.docs.join(ids, "doc_id", "left_semi").select("doc_id", "t", "text"), run, f"doc_id long, t long, {schema}"), "join-mapped")
        if not self.repeats:
            return found
        often = stored(found.join(self.again, ["doc_id", "t"], "left_semi").dropDuplicates(["doc_id", "t", *once]), "join-once")
        return found.join(self.again, ["doc_id", "t"], "left_anti").union(often)

    def sets(self, ids: DataFrame) -> DataFrame:
        """doc_id, t and h, the whole set, of the texts with these ids."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), _lists(*shingles(part.column("text"), width))], ["doc_id", "t", "h"])

        return self._mapped(ids, run, "h array<long>")

    def lists(self, nodes: DataFrame, of: Callable) -> DataFrame:
        """node, list, rank, need, brief, sig: all signatures of each set once, not only those needed."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    owner, kind, rank, need, *brief, sig = of(*shingles(part.column("text"), width))
                    row = pa.array(owner)
                    arrays = [part.column("doc_id").take(row), part.column("t").take(row), pa.array(kind), pa.array(rank), pa.array(need), pa.array(brief[0] if brief else need), pa.array(sig.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "t", "list", "rank", "need", "brief", "sig"])

        own = stored(nodes.join(self.of_node, "node"), "join-rows-of")
        found = self._mapped(own.select("doc_id"), run, "list long, rank long, need long, brief long, sig long", "list", "rank")
        return found.join(own, ["doc_id", "t"]).select("node", "list", "rank", "need", "brief", "sig")


def _uncrowded(texts: _Texts, members: DataFrame, crowds: DataFrame, of: Callable) -> DataFrame:
    """Memberships (sig, node, brief) that take the place of those in crowds, groups that are too large to compare.

    A crowd is what a passage makes that many different texts hold.  Both sets of a pair that meets in a
    crowd are in one, so it is enough to join the sets of crowds with each other, and that in
    another order of signatures: the rarest among these sets first.  What the passage gives is then
    taken only by sets that have too little else.  Each set has each of its signatures once here, however
    many rows have it, or a set would fill what it needs with repeats of one signature.  Of a pair the set that isn't
    larger has the common signature among its brief ones."""
    moved = stored(members.join(crowds, "sig", "left_semi").select("node").distinct(), "join-moved")
    lists = stored(texts.lists(moved, of), "join-lists")
    common = stored(lists.groupBy("sig").agg(F.count("*").alias("often")).filter("often > 1"), "join-common")
    ranked = lists.join(common, "sig", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    at = F.row_number().over(Window.partitionBy("node", "list").orderBy("often", "sig"))
    return ranked.withColumn("at", at).filter("at <= need and often > 1").groupBy("sig", "node").agg(F.max(F.expr("at <= brief")).alias("brief"))


def _mixed(members: DataFrame) -> DataFrame:
    """sig and c (members) of groups in more than one component, one of those with the same members; they are taken as
    the same if two 64-bit hashes of them are."""
    same = [F.bit_xor(F.xxhash64("node", "brief", F.lit(k))).alias(f"m{k}") for k in (0, 1)]
    groups = members.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("brief").alias("brief"), F.count("*").alias("c"), *same)
    return groups.filter("lo < hi and brief").groupBy("c", "m0", "m1").agg(F.min("sig").alias("sig")).select("sig", "c")


def _affordable(mixed: DataFrame, crowd: int) -> tuple[int, bool]:
    """(size up to which groups are compared pair by pair: ``crowd`` at most, and with ``PAIRS`` pairs for each member of
    any group at most; whether any is larger). A row for each size up to ``crowd`` reaches the driver."""
    by_size = mixed.groupBy(F.least("c", F.lit(crowd + 1)).alias("c")).agg(F.count("*").alias("n"), F.sum("c").alias("members"))
    sizes = sorted(tuple(r) for r in by_size.collect())
    left, most = PAIRS * sum(m for _, _, m in sizes), 1
    for c, n, _ in sizes:
        left -= n * c * (c - 1) // 2
        if c > crowd or left < 0:
            return most, True
        most = c
    return most, False


def _apart(texts: _Texts, members: DataFrame, rooted: Callable[[DataFrame], DataFrame], crowd: int) -> DataFrame:
    """Memberships (step, sig, node, root, brief) of the groups whose members in different components are to be compared."""
    found = []
    for step, finer in enumerate((signature_lists, shingle_lists, None)):
        mixed = stored(_mixed(members), "join-mixed")
        most, crowded = _affordable(mixed, crowd)
        if crowded and finer:
            compared, crowds = mixed.filter(F.col("c") <= most), stored(mixed.filter(F.col("c") > most).select("sig"), "join-crowds")
        else:
            compared, crowds = mixed, None
        found.append(members.join(compared, "sig", "left_semi").select(F.lit(step).alias("step"), "sig", "node", "root", "brief"))
        if crowds is None:
            break
        members = stored(rooted(_uncrowded(texts, members, crowds, finer)), "join-uncrowded")
    return reduce(DataFrame.union, found)


def _possible(a: str, b: str) -> Column:
    """The bounds on sizes and on the Hamming distance of two rows."""
    sizes = F.least(f"{a}.n", f"{b}.n") * DEN >= F.greatest(f"{a}.n", f"{b}.n") * NUM
    apart = sum((F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in BITS[1:]), F.bit_count(F.col(f"{a}.k0").bitwiseXOR(F.col(f"{b}.k0"))))
    return sizes & (apart * (DEN + NUM) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (DEN - NUM))


def _close(x: str, y: str) -> Column:
    """The bound on the Hamming distance of the wide sketches."""
    a, b = F.col(f"{x}.wide"), F.col(f"{y}.wide")
    size = F.least(F.size(a), F.size(b))

    def folded(w: Column) -> Column:  # sizes differ by a factor of 2 at most
        return F.when(F.size(w) > size, F.zip_with(F.slice(w, F.lit(1), size), F.slice(w, size + 1, size), lambda p, q: p.bitwiseXOR(q))).otherwise(w)

    apart = F.aggregate(F.zip_with(folded(a), folded(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda t, c: t + c)
    return apart * (DEN + NUM) <= (F.col(f"{x}.n") + F.col(f"{y}.n")) * (DEN - NUM)


def _verified(pairs: DataFrame, texts: _Texts) -> DataFrame:
    """Those pairs (a, b) whose whole sets are similar enough; pairs also have the rows of a and b: doc_id_a, t_a, doc_id_b, t_b."""
    sets = texts.sets(pairs.select(F.col("doc_id_a").alias("doc_id")).union(pairs.select("doc_id_b")))
    left, right = (sets.select(F.col("doc_id").alias(f"doc_id_{x}"), F.col("t").alias(f"t_{x}"), F.col("h").alias(f"h{x}")) for x in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ha, hb = batch.column("ha"), batch.column("hb")
            a, b = ha.flatten().to_numpy(zero_copy_only=False).view(np.uint64), hb.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ao, bo = (x.offsets.to_numpy() - x.offsets[0].as_py() for x in (ha, hb))
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = a[ao[i] : ao[i + 1]], b[bo[i] : bo[i + 1]]
                common = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                keep[i] = DEN * common >= NUM * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(left, ["doc_id_a", "t_a"]).join(right, ["doc_id_b", "t_b"]).select("a", "b", "ha", "hb")
    return map_arrow(joined, run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b): root is the smallest node of its component.

    Large-star and small-star rounds until nothing changes; only counts reach the driver."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "join-edges")
    known = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "join-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "join-large")
        least = stored(large.groupBy("a").agg(F.min("b").alias("m")), "join-least")
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "join-edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == known:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = now


def _grouped(docs: DataFrame, width: int, crowd: int) -> tuple[DataFrame, list[DataFrame]]:
    """doc_id, t, n, component (its smallest id) and group (a number of the component's own) of each row of docs
    (doc_id, t, text); both null without shingles. Two components have one smallest id if that stands on several texts.
    With it, the tables that it is read from."""
    rows = stored(described(docs, width), "join-rows")
    keys = stored(rows.select("doc_id", "t", "n", "s1", "s2"), "join-keys")
    # a class is a set; the row of its smallest id stands for it. Its node is a number of its own, as ids may repeat, in
    # the order of ids: the first text of a group is then its head, and copies edited from it are linked by one comparison
    classes = keys.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("doc_id"), F.min_by("t", "doc_id").alias("t")).filter("doc_id is not null")
    classes = stored(classes.sort("doc_id").withColumn("node", F.monotonically_increasing_id()), "join-classes")
    texts = _Texts(docs, keys, classes, width)
    of_row = ["doc_id", "t", "n", "s1", "s2"]
    heads = rows.join(classes, of_row).dropDuplicates(of_row)
    heads = stored(heads.select("node", "doc_id", "t", "n", *BITS, "wide", "blocks"), "join-heads")
    forget(rows)
    blocks = heads.select("node", F.explode("blocks").alias("sig"))
    shared = stored(blocks.groupBy("sig").agg(F.min("node").alias("head"), F.count("*").alias("c")).filter("c > 1").select("sig", "head"), "join-shared")
    release(docs)
    members = stored(blocks.join(shared, "sig"), "join-members")
    bits = stored(heads.drop("blocks").join(members.select("node").distinct(), "node", "left_semi"), "join-bits")
    forget(heads)
    release(docs)

    def with_bits(frame: DataFrame, on: str, name: str, *columns: str) -> DataFrame:
        return frame.join(bits.select(F.col("node").alias(on), F.struct("n", *columns).alias(name)), on)

    def close(pairs: DataFrame) -> DataFrame:
        near = with_bits(with_bits(pairs, "a", "x", "doc_id", "t", "wide"), "b", "y", "doc_id", "t", "wide").filter(_close("x", "y"))
        return near.select("a", "b", *(F.col(f"{k}.{c}").alias(f"{c}_{v}") for k, v in (("x", "a"), ("y", "b")) for c in ("doc_id", "t")))

    stars = members.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = with_bits(with_bits(stars, "a", "x", *BITS), "b", "y", *BITS).filter(_possible("x", "y")).select("a", "b")
    stars = stored(close(stars), "join-stars")
    links = stored(_verified(stars, texts), "join-links")
    roots = components(links)

    rooted = lambda frame: frame.join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"), "brief")
    labelled = stored(rooted(members.select("sig", "node", F.lit(True).alias("brief"))), "join-labelled")
    apart = stored(with_bits(_apart(texts, labelled, rooted, crowd), "node", "k", *BITS), "join-apart")
    if not apart.isEmpty():
        x, y = (apart.select("step", "sig", F.col("node").alias(a), F.col("root").alias(f"r{a}"), F.col("k").alias(k), F.col("brief").alias(f"brief_{k}")) for a, k in (("a", "x"), ("b", "y")))
        meets = (F.col("brief_x") & (F.col("x.n") <= F.col("y.n"))) | (F.col("brief_y") & (F.col("y.n") <= F.col("x.n")))
        of_group = (x["step"] == y["step"]) & (x["sig"] == y["sig"]) & (x["a"] < y["b"]) & (x["ra"] != y["rb"])
        crossing = x.join(y, of_group & meets & _possible("x", "y")).select("a", "b").distinct()
        # the join would be moved below distinct(), to pairs as often as they meet
        crossing = stored(close(crossing), "join-near").join(stars.select("a", "b"), ["a", "b"], "left_anti")
        crossing = stored(crossing, "join-crossing")
        if not crossing.isEmpty():
            more = stored(_verified(crossing, texts), "join-links")
            roots = components(links.union(more)) if not more.isEmpty() else roots

    linked = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    least = linked.join(classes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("component"))
    linked = linked.join(least, "root").select("node", F.col("root").alias("group"), "component")
    of_class = classes.join(linked, "node", "left").select("n", "s1", "s2", F.coalesce("component", "doc_id").alias("component"), F.coalesce("group", "node").alias("group"))
    of_class = stored(of_class, "join-components")
    return keys.join(of_class, ["n", "s1", "s2"], "left").select("doc_id", "t", "n", "component", "group"), [keys, of_class]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id. ``crowd``: size from which a group of equal blocks whose
    sets aren't linked is split at the latest; it changes the work, never the result."""
    with job() as tables:
        found, read = _grouped(_rows(docs, id_col, text_col), width, crowd)
        tables.forget(docs.sparkSession, *read)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """The documents, all columns, of which one row of each near-duplicate group stays: one with the smallest id.

    Rows leave by id and text, so a text of its own stays whatever other rows have its id; rows without an id
    stay, and so do rows without shingles."""
    id_, t = free_names(docs, "row_id", "row_t")
    with job() as tables:
        groups = stored(_grouped(_rows(docs, id_col, text_col), width, crowd)[0].filter("component is not null and doc_id is not null"), "join-grouped")
        first = groups.filter("doc_id = component").groupBy("group", "doc_id").agg(F.min("t").alias("t")).select("doc_id", "t")
        first = stored(first, "join-first")
        rows = groups.groupBy("doc_id", "t").agg(F.count("*").alias("times"))
        gone = stored(rows.join(first, ["doc_id", "t"], "left_anti").select(F.col("doc_id").alias(id_), F.col("t").alias(t)), "join-gone")
        often = stored(rows.filter("times > 1").join(first, ["doc_id", "t"], "left_semi").select(F.col("doc_id").alias(id_), F.col("t").alias(t)), "join-often")
        tables.forget(docs.sparkSession, gone, often)
    keyed = docs.withColumns({id_: F.col(id_col).cast("long"), t: F.xxhash64(F.col(text_col).cast("string"))})
    kept = keyed.join(gone, [id_, t], "left_anti")
    if not often.isEmpty():
        kept = kept.join(often, [id_, t], "left_anti").unionByName(keyed.join(often, [id_, t], "left_semi").dropDuplicates([id_, t]))
    return kept.select(docs.columns)
