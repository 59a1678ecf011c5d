"""N-gram Jaccard join: universe-partition pigeonhole over hashed word shingles, verified exactly.

Two documents link when percent * union <= 100 * intersection of their shingle sets. Sets of sizes a and b
that link differ in at most H = (100 - percent) * (a + b) / (100 + percent) elements. Hashing every shingle
into one of m segments therefore leaves at least one pair of segments close enough:

* size bands: band k holds sizes lo..hi with hi <= lo * 100 / percent, so a set can only link within its
  own band or with an adjacent one. A set is indexed by the scheme of its own band and, as the larger
  partner, by the scheme of the band below.
* allocation: a scheme gives every segment an allowance, 1 (segments must be equal) or 2 (equal, or equal
  after one deletion), the allowances adding up to H + 1. By the pigeonhole principle a linking pair meets
  in a segment. Empty segments are alike in many unrelated sets, which would make groups that grow with the
  number of all sets; so a scheme has a few segments more, its slack, and a set leaves the signature of nothing
  out unless the allowances of its empty segments exceed the slack (see `signatures`). How many segments take allowance 2 is chosen per scheme by a cost model: signatures written
  against the candidates that segments of that length are expected to bring up in a band as full as counted.
* copies: documents with the same set are one class from the start and are never expanded into pairs.
* sketches: a class carries the parities of its shingles' hashes, a bit or two for each shingle. As many
  bits differ as elements at most, so a pair whose sketches differ in more than H bits is no link, and its
  texts are never moved. Longer sketches fold onto shorter ones.
* verification: classes that share a signature are grouped around a pivot, the class with the most shared
  signatures. Pass one checks all classes of a group against its pivot, which settles a group of near copies
  in a linear number of checks: by sketches, then exactly, first with one pivot for each class, then with the
  others where the components still differ. Pass two compares the sketches of the members that are still in
  different components, in pairs of blocks, and checks exactly those that have a possible partner, in blocks
  with matrix products inside the task. Pairs of pass two are never written out as rows.

Defined results: null or blank texts have no shingles and link with nothing; fewer words than the shingle
length make one shingle; repeated rows are copies of each other; rows with a null doc_id link like any other
but never name a component: it is null where no member has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweir.llm import bytehash
from factweir.llm.common import discard, pick, prepare, work_dir, written
from factweir.llm.components import Forest, components, extended

#: Classes of one block of a group, exactly compared; a task holds the sets of two blocks.
BLOCK_ROWS = 256
#: Classes of one block whose sketches are compared.
SKETCH_ROWS = 1024
#: Members of a group that one task checks against the pivot.
STAR_ROWS = 512


@dataclass(frozen=True)
class Rule:
    """Shingle length and threshold (percent of the union that must be shared)."""

    shingle: int = 5
    percent: int = 80

    def distance(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text, A-Z lower-cased."""
    h = bytehash.words(text, lower=True)[2]
    if not len(h):
        return h
    k = min(n, len(h))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = bytehash.mix(out) + h[i : len(h) - k + 1 + i]
    return np.unique(bytehash.mix(out + np.uint64(k)))


def set_hash(s: np.ndarray, salt: int) -> int:
    """Order-free 64-bit hash of a set."""
    return int(np.add.reduce(bytehash.mix(s ^ np.uint64(salt)), dtype=np.uint64)) if len(s) else 0


def bands(percent: int, upto: int) -> list[tuple[int, int]]:
    """Size bands lo..hi, each as wide as links allow, up to the first that reaches `upto`."""
    out, lo = [], 1
    while not out or out[-1][1] < upto:
        out.append((lo, max(lo, lo * 100 // percent)))
        lo = out[-1][1] + 1
    return out


@dataclass(frozen=True)
class Scheme:
    """Segments of a size band; the first `double` of them have allowance 2, the others 1.

    slack: what the allowances add up to beyond the H + 1 that a linking pair needs.
    """

    segments: int
    double: int
    slack: int = 0


def spare(segments: int, double: int, lo: int) -> int:
    """Slack for segments of sets of `lo` shingles or more: what nearly all of them lose by empty segments."""
    t = lo / segments
    mean = ((segments - double) + 2 * double * (1 + t)) * math.exp(-t)
    return math.ceil(mean + 3 * math.sqrt(mean)) if mean > 0.02 else 0


def plan(rule: Rule, lo: int, hi: int, sets: int, shared: float) -> Scheme:
    """The cheapest scheme of a band with `sets` sets.

    shared: assumed chance that a shingle of one set is also in another, unrelated one; a segment of t
    shingles then agrees by chance with probability shared ** t. One candidate costs as much as
    CANDIDATE signatures.
    """
    need = rule.distance(hi, hi * 100 // rule.percent) + 1
    if need == 1:
        return Scheme(1, 0)
    best, size = (math.inf, Scheme(need, 0)), (lo + hi) / 2
    for double in range(min(need // 2, 4) + 1):
        m = need - double
        t = size / m
        signatures = m + double * t
        chance = (m - double) * shared**t + double * (2 * t + 1) * shared ** max(t - 1, 0)
        cost = signatures + CANDIDATE * sets * min(1.0, chance)
        best = min(best, (cost, Scheme(m, double)), key=lambda x: x[0])
    one = best[1]
    slack = spare(one.segments, one.double, lo)
    return Scheme(one.segments + slack, one.double, slack)


CANDIDATE = 4.0


def signatures(s: np.ndarray, k: int, scheme: Scheme) -> np.ndarray:
    """Signatures of a set under the scheme of band k.

    A segment with allowance 2 gives its own signature and those after each single deletion, so that two
    such segments that differ by one added or removed shingle share one.

    The signature of nothing (an empty segment, or one of allowance 2 less its only shingle) is left out where the
    allowances of the segments that have it are at most the slack. A linking pair that agrees in no other signature
    differs by the allowance of every other segment at least; as all add up to H + 1 + slack, those that both have
    the signature of nothing in exceed the slack, for both sets. Both then keep it, and meet.
    """
    m = np.uint64(scheme.segments)
    seg = (s % m).astype(np.int64)
    each = bytehash.mix(s + np.uint64(0x5851F42D4C957F2D))
    total = np.zeros(scheme.segments, dtype=np.uint64)
    np.add.at(total, seg, each)
    label = bytehash.mix(np.arange(scheme.segments, dtype=np.uint64) + np.uint64((k + 1) << 32))
    out = bytehash.mix(total + label)
    if scheme.double:
        at = seg < scheme.double
        out = np.concatenate([out, bytehash.mix(total[seg[at]] - each[at] + label[seg[at]])])
    if scheme.slack:
        held, twice = np.bincount(seg, minlength=scheme.segments), np.arange(scheme.segments) < scheme.double
        if int((held[~twice] == 0).sum()) + 2 * int((held[twice] <= 1).sum()) <= scheme.slack:
            nothing = np.concatenate([held == 0, held[seg[at]] == 1]) if scheme.double else held == 0
            out = out[~nothing]
    return out


def sketch(s: np.ndarray) -> bytes:
    """Parities of the hashes of a set, by their low bits; at least a bit for each element, 64 at least."""
    bits = max(64, 1 << int(len(s)).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of 64-bit words) of `width` words, from longer ones."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def may_link(a: bytes, b: bytes, na: int, nb: int, rule: Rule) -> bool:
    """Whether the sketches of two sets of sizes na and nb leave a link possible."""
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    width = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum()) <= rule.distance(na, nb)


def _rows(batches: Iterator[pa.RecordBatch], rule: Rule, schemes: list[Scheme], lows: np.ndarray) -> Iterator[pa.RecordBatch]:
    percent = rule.percent
    highs = [lo - 1 for lo in lows[1:].tolist()] + [None]
    for b in batches:
        n, node, other, short, sigs = [], [], [], [], []
        for text in b.column("text").to_pylist():
            s = shingle_set((text or "").encode(), rule.shingle)
            n.append(len(s))
            node.append(set_hash(s, 0x1F0A))
            other.append(set_hash(s, 0x77C3))
            short.append(sketch(s))
            if not len(s):
                sigs.append(np.zeros(0, dtype=np.int64))
                continue
            k = int(np.searchsorted(lows, len(s), "right")) - 1
            own = [signatures(s, k, schemes[k])]
            if k and highs[k - 1] * 100 >= percent * len(s):
                own.append(signatures(s, k - 1, schemes[k - 1]))
            sigs.append(np.concatenate(own).view(np.int64))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in sigs]))).astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": b.column("doc_id"),
                "row_key": b.column("row_key"),
                "n": pa.array(n, pa.int64()),
                "node": pa.array(np.array(node, dtype=np.uint64).view(np.int64)),
                "other": pa.array(np.array(other, dtype=np.uint64).view(np.int64)),
                "sketch": pa.array(short, pa.binary()),
                "sigs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs) if sigs else [], pa.int64())),
            }
        )


_ROWS = "doc_id long, row_key long, n long, node long, other long, sketch binary, sigs array<long>"


def _possible(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    """The (pivot, node) rows whose sketches leave a link possible."""
    for pdf in batches:
        fits = [may_link(*x, rule) for x in zip(*(pdf[c] for c in ("sketch", "pivot_sketch", "n", "pivot_n")), strict=True)]
        yield pdf.loc[np.array(fits, dtype=bool), ["pivot", "node", "weight"]]


def _set_of(text: str | None, node: int, rule: Rule) -> np.ndarray | None:
    """The set of a text if it is the class `node`'s (two texts may share a key, by a hash)."""
    s = shingle_set((text or "").encode(), rule.shingle)
    return s if np.uint64(set_hash(s, 0x1F0A)).view(np.int64) == node else None


def _star(batches: Iterator[pd.DataFrame], rule: Rule) -> Iterator[pd.DataFrame]:
    """Checks members against their pivot; the pivot's row comes first in each (pivot, salt) run."""
    key, base = None, None
    for pdf in batches:
        out = []
        for pivot, salt, node, text in zip(*(pdf[c] for c in ("pivot", "salt", "node", "text")), strict=True):
            s = _set_of(text, node, rule)
            if s is None:
                continue
            if node == pivot:
                key, base = (pivot, salt), s
            elif key == (pivot, salt):
                both = len(np.intersect1d(s, base, assume_unique=True))
                if 100 * both >= rule.percent * (len(s) + len(base) - both):
                    out.append((node, pivot))
        yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _open_members(pdf: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Of one pair of blocks, the members whose sketch leaves a link to a member of another component possible."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    block, n, comp, node = (pdf[c].to_numpy(dtype=np.int64) for c in ("block", "n", "comp", "node"))
    words = [np.frombuffer(x, dtype=np.uint64) for x in pdf["sketch"]]
    width = np.array([len(w) for w in words])
    hit = np.zeros(len(pdf), dtype=bool)
    for w in np.unique(width):
        own, near = np.flatnonzero(width == w), np.flatnonzero((width >= w) & (width * rule.percent <= 200 * w))
        folded = np.stack([fold(words[x], w) for x in near])
        at = np.searchsorted(near, own)
        step = max(1, (8 << 20) // (len(near) * int(w)))
        for start in range(0, len(own), step):
            rows = own[start : start + step]
            apart = np.bitwise_count(folded[at[start : start + step], None, :] ^ folded[None, :, :]).sum(axis=2, dtype=np.int64)
            fits = apart <= (100 - rule.percent) * (n[rows, None] + n[None, near]) // (100 + rule.percent)
            fits &= comp[rows, None] != comp[None, near]
            if i != j:
                fits &= block[rows, None] != block[None, near]
            hit[rows[fits.any(axis=1)]] = True
            hit[near[fits.any(axis=0)]] = True
    return pd.DataFrame({"pivot": pdf["pivot"].to_numpy()[hit], "node": node[hit]}, dtype="int64")


def overlaps(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of 0/1 tiles over `columns` elements each."""
    flat = np.concatenate(sets)
    value, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count > 1  # an element of one set only is in no intersection
    new = np.cumsum(keep) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[keep[place]]
    col = new[place][keep[place]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(keep.sum()), columns):
        i, j = np.searchsorted(col, (start, start + columns))
        tile = np.zeros((len(sets), columns), dtype=np.float32)
        tile[row[i:j], col[i:j] - start] = 1
        out += tile @ tile.T
    return out


def _blocks(pdf: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    """Links between different components inside one pair of blocks, as a spanning forest."""
    i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
    rows = [(b, node, comp, s) for b, node, comp, text in zip(*(pdf[c] for c in ("block", "node", "comp", "text")), strict=True) if (s := _set_of(text, node, rule)) is not None]
    if len(rows) < 2 or len({r[2] for r in rows}) < 2:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    size = np.array([len(r[3]) for r in rows])
    both = overlaps([r[3] for r in rows])
    linked = 100 * both >= rule.percent * (size[:, None] + size[None, :] - both)
    comp = np.array([r[2] for r in rows])
    linked &= comp[:, None] != comp[None, :]
    if i != j:
        block = np.array([r[0] for r in rows])
        linked &= block[:, None] != block[None, :]
    found, out = Forest(), []
    for x, y in zip(*np.nonzero(np.triu(linked)), strict=True):
        if found.join(int(comp[x]), int(comp[y])):
            out.append((rows[x][1], rows[y][1]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _dealt(members: DataFrame, size: int, folder: str) -> DataFrame:
    """members(pivot, node, ...) once for every pair (i, j) of blocks of its group that its own block is in.

    The sizes are a table of their own, so that adaptive execution can split a large group in the join.
    """
    blocks = written(members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("nb")), folder)
    dealt = members.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.select(*members.columns, "block", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))


class _Join:
    """The steps of one join; every table they write lies in `folder`."""

    def __init__(self, docs: DataFrame, rule: Rule, folder: str) -> None:
        self.docs, self.rule, self.folder, self.spark = docs, rule, folder, docs.sparkSession

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        discard(self.spark, *[f"{self.folder}/{n}" for n in names])

    def schemes(self, shared: float) -> tuple[list[Scheme], np.ndarray]:
        """A scheme for each size band, and the bands' lower ends."""
        percent = self.rule.percent
        sizes = (
            self.docs.select(F.floor(F.octet_length("text") / 6).alias("words"))
            .groupBy(F.floor(F.log(100 / percent, F.greatest("words", F.lit(1)))).alias("step"))
            .agg(F.count(F.lit(1)).alias("sets"), F.max("words").alias("most"))
            .collect()  # a row for each step of sizes: the logarithm of the longest text
        )
        # no text has more words than half its bytes and one: bands cover every size that can come up
        cuts = bands(percent, max([10, *(int(r["most"] or 0) * 3 + 4 for r in sizes)]))
        full = {int(r["step"] or 0): int(r["sets"]) for r in sizes}
        crowd = [full.get(int(math.log(max(lo, 1), 100 / percent)), 0) for lo, _ in cuts]
        return [plan(self.rule, lo, hi, c, shared) for (lo, hi), c in zip(cuts, crowd, strict=True)], np.array([lo for lo, _ in cuts])

    def near(self, rows: DataFrame) -> DataFrame:
        """(pivot, node, weight) of classes that share a signature, pivot excepted; weight is the pivot's.

        Signatures of one class only go first. A signature's smallest and greatest class are combined before
        the shuffle, however many classes hold it.
        """
        sigs = rows.select("node", F.explode("sigs").alias("sig"))
        ends = sigs.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
        ends = self.table(ends.select("sig"), "shared")
        members = self.table(sigs.join(ends, "sig").distinct(), "members")
        counts = self.table(members.groupBy("sig").agg(F.count(F.lit(1)).alias("c")), "counts")
        central = self.table(members.join(counts, "sig").groupBy("node").agg(F.sum("c").alias("weight")), "central")
        pivots = self.table(members.join(central, "node").groupBy("sig").agg(F.max(F.struct("weight", "node")).alias("p")).select("sig", "p.*").withColumnRenamed("node", "pivot"), "pivots")
        near = self.table(members.join(pivots, "sig").where("node <> pivot").select("pivot", "node", "weight").distinct(), "near")
        self.drop("shared", "members", "counts", "central", "pivots")
        return near

    def texts(self, nodes: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """node and text of the classes in nodes(node), each by one of its rows."""
        keys = nodes.distinct().join(classes.select("node", "row_key"), "node")
        docs = self.docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
        return self.table(docs.join(keys, "row_key").select("node", "text").distinct(), name)

    def star(self, pairs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
        """The links among pairs(pivot, node), exactly; the pivot's text goes to every salt of its pairs."""
        rule = self.rule
        size = self.table(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR_ROWS).cast("int").alias("salts")), f"{name}-sizes")
        dealt = pairs.join(size, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node")
        every = size.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("node"))
        dealt = self.table(dealt.unionByName(every), f"{name}-dealt")
        texts = self.texts(dealt.select("node"), classes, f"{name}-texts")
        rows = dealt.join(texts, "node").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", F.col("pivot") != F.col("node"))
        links = self.table(rows.select("pivot", "salt", "node", "text").mapInPandas(lambda it: _star(it, rule), "a long, b long"), name)
        self.drop(f"{name}-sizes", f"{name}-dealt", f"{name}-texts")
        return links

    def links(self, near: DataFrame, sets: DataFrame, classes: DataFrame) -> DataFrame:
        """(id, component) over classes: the smallest node that each linked node reaches."""
        rule = self.rule
        pivot_sets = sets.select(*[F.col(c).alias(d) for c, d in zip(("node", "n", "sketch"), ("pivot", "pivot_n", "pivot_sketch"), strict=True)])
        pairs = self.table(near.join(sets, "node").join(pivot_sets, "pivot").mapInPandas(lambda it: _possible(it, rule), "pivot long, node long, weight long"), "pairs")
        placed = lambda df, comp, c: df.join(comp.select(F.col("id").alias(c), F.col("component").alias(f"{c}_comp")), c, "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c))

        main = pairs.groupBy("node").agg(F.max(F.struct("weight", "pivot"))["pivot"].alias("pivot"))
        links = self.star(main.select("pivot", "node"), classes, "star")
        comp = self.table(components(links, f"{self.folder}/first"), "comp1")
        rest = self.table(placed(placed(pairs, comp, "node"), comp, "pivot").where("node_comp <> pivot_comp").join(main.select("node", "pivot"), ["node", "pivot"], "left_anti").select("pivot", "node"), "rest")
        if not rest.isEmpty():
            comp = self.table(extended(comp, self.star(rest, classes, "star2"), f"{self.folder}/second"), "comp2")

        # all pairs with a pivot are settled; groups whose other members are in several components stay open
        member = self.table(placed(near.select("pivot", "node"), comp, "node").withColumnRenamed("node_comp", "comp"), "placed")
        several = member.groupBy("pivot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("pivot")
        still = self.table(member.join(self.table(several, "several"), "pivot", "left_semi"), "still")
        if still.isEmpty():
            return comp
        dealt = _dealt(still, SKETCH_ROWS, f"{self.folder}/still-sizes").join(sets, "node")
        hits = dealt.groupBy("pivot", "i", "j").applyInPandas(lambda pdf: _open_members(pdf, rule), "pivot long, node long")
        hits = self.table(hits.distinct(), "hits")
        if hits.isEmpty():
            return comp
        texts = self.texts(hits.select("node"), classes, "hit-texts")
        dealt = _dealt(still.join(hits, ["pivot", "node"]), BLOCK_ROWS, f"{self.folder}/hit-sizes").join(texts, "node")
        more = self.table(dealt.groupBy("pivot", "i", "j").applyInPandas(lambda pdf: _blocks(pdf, rule), "a long, b long"), "blocks")
        self.drop("hit-texts")
        return self.table(extended(comp, more, f"{self.folder}/third"), "comp3")


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 80, shared: float = 0.35) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    shared is the cost model's assumption (see `plan`); it changes cost, never results.
    """
    spark, rule = docs.sparkSession, Rule(shingle, percent)
    docs = pick(docs, "doc_id", "text")
    prepare(spark)
    join = _Join(docs, rule, work_dir(spark, "ngram-join"))
    schemes, lows = join.schemes(shared)
    full = join.table(docs.withColumn("row_key", F.xxhash64("doc_id", "text")).select("doc_id", "row_key", "text").mapInArrow(lambda it: _rows(it, rule, schemes, lows), _ROWS), "signed")
    near = join.near(full)
    some = full.join(near.select("node").union(near.select("pivot")).distinct(), "node", "left_semi")
    sets = join.table(some.groupBy("node").agg(F.min("n").alias("n"), F.min("sketch").alias("sketch")), "sets")
    rows = join.table(full.select("doc_id", "row_key", "n", "node", "other"), "rows")
    join.drop("signed")
    classes = join.table(rows.where("n > 0").groupBy("node", "other", "n").agg(F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key")), "classes")
    comp = join.links(near, sets, classes)

    # tables of their own, so that the joins shuffle both sides anew and adaptive execution splits a large class or component
    placed = classes.join(comp, F.col("node") == F.col("id"), "left").withColumn("label", F.coalesce("component", "node"))
    named = join.table(placed.groupBy("label").agg(F.min("rep").alias("component_id")), "named")
    known = join.table(placed.join(named, "label").select("node", "other", "n", "component_id"), "known")
    found = rows.where("n > 0").join(known, ["node", "other", "n"]).select("doc_id", "n", "component_id")
    alone = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
