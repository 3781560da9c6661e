"""MinHash near-dedup by a chosen-path set similarity join.

Every document is the set of its five-word shingles and has a sketch of POSITIONS minwise tokens. Documents with equal
sets are one representative, which goes by a number of its own: exact copies form no pairs, and ids may repeat or be null.
In each of `trees` independent trees a node picks, by a hash of its path, which position its members branch on; members
with equal tokens go down together. A node of at most `leaf` members is compared exhaustively; a larger one branches
again. Nodes that are still large at the last level hold groups of near copies.

Comparison takes two rounds. First every member of a node is compared with pivots, the members that the largest number
of nodes hold, so work is linear in a group. Then, in each node whose members aren't in one component yet, every pair
across components is compared (in a large node: what is outside its main component with all the rest, in blocks). Links
within a component would change nothing. Links are confirmed on full sets, and components of the links give the classes.

A component may hold a third of all rows: its first document reaches its rows by a salted join. A node's rows meet
what is counted of it in one task; a row there is two numbers.

Defined cases: null, empty and blank texts have the empty set and link with nothing; fewer words than five are one
shingle; rows that repeat id and text are one document, each row with the same result; rows that repeat an id with
other texts are documents of their own; null ids sort before all others, each row a document by its text. Extra columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SHUFFLED, cut, pick, release, remove, row_key, settings, shared_dir, ship, stored
from .components import components, relabelled
from .shingles import mixed, shingle_hashes

POSITIONS = 64
STEP = 4096
_rng = np.random.default_rng(77)
MULTIPLY = (_rng.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(text))


def sketch(own: np.ndarray) -> np.ndarray:
    """POSITIONS minwise tokens: the upper half of the least product for each multiplier."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(own), STEP):
        least = np.minimum(least, (own[None, at : at + STEP] * MULTIPLY).min(axis=1))
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, n_shingles, s1, s2, sketch): s1 and s2 name the set; the sketch of an empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text or "")
                names = (int(own.sum(dtype=np.uint64)), int(mixed(own ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64))) if len(own) else (0, 0)
                rows.append((len(own), *(x - (1 << 64) if x >> 63 else x for x in names), sketch(own) if len(own) else None))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "k1", "k2")], *made], names=["id", "k1", "k2", "n_shingles", "s1", "s2", "sketch"])

    return docs.select("id", "k1", "k2", "text").mapInArrow(run, "id long, k1 long, k2 long, n_shingles long, s1 long, s2 long, sketch array<int>")


def branch(node: Column, sketch_col: str = "sketch") -> Column:
    """The child of a node that a member goes to: the node's hash picks the position, the member's token there the child."""
    return F.xxhash64(node, F.get(sketch_col, F.pmod(F.xxhash64(node, F.lit("position")), F.lit(POSITIONS)).cast("int")))


def agreement(a: Column, b: Column) -> Column:
    """How many positions agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def maybe(a: Column, b: Column, percent: int, slack: float) -> Column:
    """Whether two members (n, sketch) may be similar enough: sizes decide exactly, sketches with six deviations' slack."""
    sizes = (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) if percent else F.lit(True)
    return sizes & (agreement(a["sketch"], b["sketch"]) >= F.lit(POSITIONS * (percent / 100 - slack)))


def tree_nodes(reps: DataFrame, trees: int, leaf: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(small, large): rows (node, id) of nodes of 2 .. leaf members, and of those still larger at the last level."""
    level = reps.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(trees)), lambda t: branch(F.xxhash64(F.lit("tree"), t)))).alias("node"))
    small = None
    for k in range(depth):
        sizes = level.groupBy("node").agg(F.count("*").alias("members")).where("members > 1")
        level = cut(level.join(sizes, "node"))
        fits = level.where(F.col("members") <= leaf).select("node", "id")
        small = fits if small is None else small.unionByName(fits)
        large = level.where(F.col("members") > leaf).select("node", "id")
        release(reps.sparkSession)
        if k + 1 < depth:
            level = large.join(reps.select("id", "sketch"), "id").select("id", branch(F.col("node")).alias("node"))
    return small, large


def small_pairs(small: DataFrame, reps: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs (a, b), a < b, of the members of a small node with its pivot: the member that the most small nodes hold."""
    held = small.join(small.groupBy("id").agg(F.count("*").alias("nodes")), "id")
    m = F.struct("nodes", F.xxhash64("id").alias("h"), "id", F.col("n_shingles").alias("n"), "sketch").alias("m")
    whole = held.join(reps.select("id", "n_shingles", "sketch"), "id").select("node", m).groupBy("node").agg(F.max("m").alias("p"), F.collect_list("m").alias("ms"))  # at most `leaf` members
    found = F.transform(F.filter("ms", lambda x: (x["id"] != F.col("p.id")) & maybe(x, F.col("p"), percent, slack)), lambda x: x["id"])
    return whole.select("p.id", F.explode(found).alias("x")).select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def small_rest(small: DataFrame, labels: DataFrame, reps: DataFrame, percent: int, slack: float) -> DataFrame:
    """All other pairs of a small node whose members are in different components; nodes of one component need no more."""
    known = small.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("node", "id", F.coalesce("label", "id").alias("label"))
    open_nodes = known.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members")).where("lo < hi and members > 2").select("node")
    m = F.struct("id", F.col("n_shingles").alias("n"), "sketch", "label").alias("m")
    whole = known.join(open_nodes, "node").join(reps.select("id", "n_shingles", "sketch"), "id").select("node", m).groupBy("node").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    found = F.flatten(F.transform("ms", lambda a, i: F.transform(F.filter("ms", lambda b, j: (j > i) & (a["label"] != b["label"]) & maybe(a, b, percent, slack)), lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")))))
    return whole.select(F.explode(found).alias("p")).select("p.a", "p.b").distinct()


def pivot_pairs(large: DataFrame, reps: DataFrame, percent: int, slack: float) -> DataFrame:
    """Pairs of the members of a large node with its two pivots: as many pairs as members, twice."""
    held = large.groupBy("id").agg(F.count("*").alias("nodes"))
    ranked = large.join(held, "id").groupBy("node").agg(F.max(F.struct("nodes", F.xxhash64("id").alias("h"), "id")).alias("most"), F.max(F.struct(F.xxhash64("node", "id").alias("h"), "id")).alias("drawn"))
    pivots = ranked.select("node", F.explode(F.array("most.id", "drawn.id")).alias("pivot"))
    met = large.join(pivots, "node").where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    return likely(met, reps, percent, slack)


def likely(pairs: DataFrame, reps: DataFrame, percent: int, slack: float) -> DataFrame:
    side = lambda c: reps.select(F.col("id").alias(c), F.struct(F.col("n_shingles").alias("n"), "sketch").alias(f"m{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(maybe(F.col("ma"), F.col("mb"), percent, slack)).select("a", "b")


def full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, run: str) -> DataFrame:
    """(id, own): the full sets, as bytes, of the representatives asked for; only their texts are read into sets. `run` names the folder."""

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(t or "").tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "own"])

    named = reps.join(wanted.distinct(), "id", "left_semi").select("id", "k1", "k2")
    found = docs.select("k1", "k2", "text").join(named, ["k1", "k2"]).dropDuplicates(["k1", "k2"])  # rows may repeat
    return stored(found.select("id", "text").mapInArrow(to_sets, "id long, own binary"), f"{run}/sets")


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, percent: int, run: str) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column("own_a"), batch.column("own_b"), strict=True)
            keep = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in sides]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = full_sets(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("id")), run)
    met = pairs.join(sets.select(F.col("id").alias("a"), F.col("own").alias("own_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("own").alias("own_b")), "b")
    return met.select("a", "b", "own_a", "own_b").mapInArrow(compare, "a long, b long")


def stray_links(large: DataFrame, labels: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, slack: float, run: str, block: int = 128) -> DataFrame:
    """Links between components among the members of large nodes, found by comparing blocks; pairs never become rows.

    Nodes of one component need no more. Of the others, those that share members with a small hub form a cluster, which
    holds each of its nodes whole; what is outside a cluster's main component, in blocks, meets all of its blocks, full
    sets included. Within a pair of blocks the likeliest pairs come first, and a member needs one link to a component.
    """
    known = large.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("node", "id", F.coalesce("label", "id").alias("label"))
    spread = known.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("id").alias("hub")).where("lo < hi").select("node", "hub")
    opened = cut(known.join(spread, "node").select("node", "hub", "id", "label"))
    nearest = opened.groupBy("id").agg(F.min("hub").alias("near"))
    cluster = opened.join(nearest, "id").groupBy("node").agg(F.min("near").alias("cluster"))
    members = cut(opened.join(cluster, "node").select("cluster", "id", "label").distinct())
    sizes = members.groupBy("cluster", "label").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.sum("n").alias("members"), F.max(F.struct("n", "label")).alias("top"))
    sizes = sizes.select("cluster", "members", F.col("top.label").alias("main"))
    m = F.struct("id", "label", F.col("n_shingles").alias("n"), "sketch", "own").alias("m")
    held = members.join(sizes, "cluster").join(reps.select("id", "n_shingles", "sketch"), "id").join(full_sets(docs, reps, members.select("id"), run), "id").select("cluster", (F.col("label") != F.col("main")).alias("stray"), F.ceil(F.col("members") / block).alias("parts"), m)
    part = F.pmod(F.xxhash64("m.id"), F.col("parts")).alias("part")
    right = held.select("cluster", part, "m").groupBy("cluster", "part").agg(F.collect_list("m").alias("right"))
    strays = held.where("stray").select("cluster", "parts", part, "m").groupBy("cluster", "parts", F.col("part").alias("left_part")).agg(F.collect_list("m").alias("left"))
    left = strays.select("cluster", "left", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))  # each pair of blocks is dealt out by itself

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = cross_links(batch.column("left")[k].values, batch.column("right")[k].values, percent, slack)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    dealt = left.join(right, ["cluster", "part"]).select("left", "right")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def cross_links(left: pa.StructArray, right: pa.StructArray, percent: int, slack: float) -> list[tuple[int, int]]:
    def columns(x: pa.StructArray) -> tuple:
        rows = len(x)
        return (x.field("id").to_numpy(), x.field("label").to_numpy(), x.field("n").to_numpy(), x.field("sketch").flatten().to_numpy().reshape(rows, POSITIONS), x.field("own"))

    (ids, labels, sizes, prints, sets), (ids2, labels2, sizes2, prints2, sets2) = columns(left), columns(right)
    own = [np.frombuffer(y.as_buffer(), np.uint64) for y in sets2]
    found = []
    for i in range(len(ids)):
        same = (prints2 == prints[i]).sum(axis=1)
        near = (labels2 != labels[i]) & (100 * np.minimum(sizes2, sizes[i]) >= percent * np.maximum(sizes2, sizes[i])) & (same >= POSITIONS * (percent / 100 - slack))
        done, mine = set(), np.frombuffer(sets[i].as_buffer(), np.uint64)
        for j in sorted(np.flatnonzero(near), key=lambda j: -same[j]):
            if labels2[j] not in done and similar(mine, own[j], percent):
                done.add(labels2[j])
                found.append((int(min(ids[i], ids2[j])), int(max(ids[i], ids2[j]))))
    return found


def similar(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= percent * (len(p) + len(q) - both)


def classified(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, trees: int = 16, leaf: int = 16, depth: int = 6, slack: float = 0.25, salts: int = 16,
) -> DataFrame:
    """(id, k1, k2, n_shingles, first): one row for each input row; first (id, k1, k2) is the smallest document of its component."""
    ship(docs.sparkSession)
    docs = pick(docs, [id_col, text_col]).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    used = docs.select("id", "text", *row_key(F.col("id"), F.col("text")))
    spark, run = docs.sparkSession, f"near-{uuid.uuid4().hex}"
    with settings(spark, SHUFFLED):
        known, reps, labels = linked_classes(used, run, percent, trees, leaf, depth, slack)
        firsts = labels.groupBy("label").agg(F.min("document").alias("first"))
        # a component may hold a third of all rows: its first document goes to every salt
        salted = cut(firsts.select("label", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
        linked = labels.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(salted, ["label", "salt"]).select(F.col("node").alias("id"), "first")
        classes = reps.select("s1", "s2", "id", "document").join(linked, "id", "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("first", "document").alias("first"))
        out = known.select("id", "k1", "k2", "n_shingles", "s1", "s2").join(classes, (F.col("n_shingles") > 0) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
        out = stored(out.select("id", "k1", "k2", "n_shingles", F.coalesce("first", F.struct("id", "k1", "k2")).alias("first")), "near-classes")
    remove(spark, f"{shared_dir(spark).rstrip('/')}/{run}")
    release(spark)
    return out


def linked_classes(used: DataFrame, run: str, percent: int, trees: int, leaf: int, depth: int, slack: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, representatives, labels (node, label, document) of the representatives that have a link)."""
    known = stored(sketches(used), f"{run}/sketches")
    # a document is (id, k1, k2); nulls sort first in a struct
    reps = known.where("n_shingles > 0").groupBy("s1", "s2").agg(F.min(F.struct("id", "k1", "k2", "n_shingles", "sketch")).alias("m"))
    # the number is fixed once it is written
    reps = stored(reps.select(F.monotonically_increasing_id().alias("id"), F.struct("m.id", "m.k1", "m.k2").alias("document"), "m.k1", "m.k2", "s1", "s2", "m.n_shingles", "m.sketch"), f"{run}/reps")
    small, large = tree_nodes(reps, trees, leaf, depth)
    tested = cut(small_pairs(small, reps, percent, slack).union(pivot_pairs(large, reps, percent, slack)).distinct())
    release(used.sparkSession)
    labels = components(cut(confirmed(tested, used, reps, percent, run)))
    rest = cut(small_rest(small, labels, reps, percent, slack).join(tested, ["a", "b"], "left_anti"))
    release(used.sparkSession)
    more = confirmed(rest, used, reps, percent, run)
    release(used.sparkSession)
    more = cut(more.union(stray_links(large, labels, reps, used, percent, slack, run)))
    release(used.sparkSession)
    return known, reps, cut(relabelled(labels, more).join(reps.select(F.col("id").alias("node"), "document"), "node").select("node", "label", "document"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """Returns id_col, n_shingles, component_id and kept: one row for each input row.

    Links join documents with 100 * |intersection| >= percent * |union|; component_id is the smallest id reachable, kept
    whether it is the row's own. The keywords are those of classified().
    """
    out = classified(docs, id_col=id_col, **how)
    return out.select(F.col("id").alias(id_col), "n_shingles", F.col("first.id").alias("component_id"), F.col("id").eqNullSafe(F.col("first.id")).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, one of each group of near copies: that of the smallest document; of rows that repeat id and text, the smallest."""
    kept = classified(docs, id_col=id_col, text_col=text_col, **how).where((F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))).select("k1", "k2").distinct()
    rest = [c for c in docs.columns if c not in (id_col, text_col)]
    row = F.struct(*[docs[f"`{c}`"] for c in (id_col, *rest, text_col)]).alias("row")
    one = docs.select(row, *row_key(docs[f"`{id_col}`"].cast("long"), docs[f"`{text_col}`"])).groupBy("k1", "k2").agg(F.min("row").alias("row"))
    # what is kept grows with the corpus: it is shuffled, not gathered on the driver
    return one.join(kept.hint("merge"), ["k1", "k2"], "left_semi").select(*[F.col(f"row.`{c}`") for c in docs.columns])
