"""N-gram Jaccard join: a metric-space join of shingle sets, exact.

Distance is 1 - Jaccard similarity; two documents link at a distance of at most
EPSILON. Equal sets are one point. The steps:

1. Points that cannot link are set aside. A shingle no other document has is
   missing from every partner, and a point with more than EPSILON of its
   shingles missing has no partner. A quarter of all shingles (by hash) shows
   this for most points, all shingles of the rest for most others.
2. Each point enters the regions of its rarest shingles, as many as make two
   linked points meet in at least one region. Each region's most central point (that
   with the most widespread shingles) is its pivot; distances to the pivots are exact, a point's nearest pivot is its
   Voronoi home, and points within EPSILON of a pivot form a class with it.
3. Regions that hold several classes join across these, recursively. Every point
   meets at most PIVOTS pivots of its region that are of other classes. By the
   triangle inequality a member can link to it only if their distances to the
   pivot differ by at most EPSILON: within that window the point stands at the
   boundary of the pivot's cell and is measured against the member. Cells so
   settled leave, and the rest of the region is joined in the same way.

Points meet only where they can still share enough: shingles stand in one order,
rarest first, so at the first that two sets share nothing before it is common, and
what is left of either must reach the number that a link takes. A point that differs
from all its like in shingles of its own meets nobody.

Pairs within a class are never made: they are connected already. Shingles are
64-bit hashes, sets are known by 128-bit hashes of their shingles. Between tasks
shingles travel packed by hash bucket, and a shingle counts once per slice of
documents there, so a common one is as light as a rare one.

Defined results: a null or empty text, or one without words, has an empty set
and links with nothing; rows of one doc_id are points of their own; a null doc_id
takes part but is never a component_id (null where no other is there); equal rows
share a point; an empty table gives no rows; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import (documents, map_arrow, ship, shuffle_partitions, slices, stage, texts_of,
                     word_blocks, word_hash)

WORDS = 4
PERCENT = 85           # link at a similarity of at least so many percent
BUCKETS_BITS = 10     # shingles travel in 2 ** 10 buckets, more where there is more input
SAMPLE_MASK = 3        # of the first pass: shingles whose low bits are 0
PIVOTS = 256           # a region's pivots that are met at one level
SLICE_SHINGLES = 200_000
_MANY = np.uint32(0xFFFFFFFF)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                               0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the ``words``-word shingles (ASCII letters in
    lower case); of the whole sequence where it is shorter."""
    parts = [np.fromiter(map(word_hash, w), dtype=np.uint64, count=len(w))
             for w in word_blocks(text.lower())]
    h = parts[0] if len(parts) == 1 else np.concatenate(parts)
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    s = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(32))) * _MIX[i % 6] + h[i:i + n]
    s ^= s >> np.uint64(29)
    s *= _MIX[0]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def set_id(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _may_link(n, missing, percent):
    """Whether a set of n shingles of which ``missing`` are its own alone can
    still reach the similarity."""
    return (n > 0) & (100 * (n - missing) >= percent * n)


def _bucket_bits(df: DataFrame) -> int:
    """A task holds a bucket at a time: two buckets for each part of the input."""
    return max(BUCKETS_BITS, (2 * df.rdd.getNumPartitions()).bit_length())


def _by_bucket(tokens: np.ndarray, bits: int):
    """(bucket, from, to) of sorted tokens."""
    bucket = (tokens >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])).tolist() if len(bucket) else []
    for i, j in zip(cuts, [*cuts[1:], len(bucket)]):
        yield int(bucket[i]), i, j


def _runs(batches, key: str):
    """Consecutive rows of one key (as dicts of lists) of sorted batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and rows:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


# -- 1: members and who may link --------------------------------------------------

_SCAN = "bucket int, ref long, doc_id long, n long, sid binary, tokens binary, rows binary"


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document, and for each slice of documents and bucket the
    sampled shingles with the only document of the slice that has them."""
    bits = _bucket_bits(docs)

    def run(batches):
        ref = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            ids, sets = b.column("doc_id").to_pylist(), [shingles(t, words) for t in texts_of(b)]
            n = [len(s) for s in sets]
            refs = range(ref, ref + len(sets))
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r % (1 << bits) for r in refs], pa.int32()), pa.array(refs, pa.int64()),
                 pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(map(set_id, sets), pa.binary()),
                 pa.array(none, pa.binary()), pa.array(none, pa.binary())], _NAMES)
            row = np.repeat(np.arange(len(sets), dtype=np.uint32), n)
            token = np.concatenate(sets)
            take = (token & np.uint64(SAMPLE_MASK)) == 0
            token, row = token[take], row[take]
            order = np.argsort(token, kind="stable")
            token, at, count = np.unique(token[order], return_index=True, return_counts=True)
            row = np.where(count == 1, row[order][at], _MANY).astype("<u4")
            out = [(k, ref, token[i:j].tobytes(), row[i:j].tobytes()) for k, i, j in _by_bucket(token, bits)]
            if out:
                k, base, t, r = zip(*out)
                none = [None] * len(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int32()), pa.array(base, pa.int64()), pa.array(none, pa.int64()),
                     pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(t, pa.binary()),
                     pa.array(r, pa.binary())], _NAMES)
            ref += len(sets)

    return map_arrow(docs.select("doc_id", "text"), run, _SCAN)


_NAMES = [f.split()[0] for f in _SCAN.split(", ")]
_GROUP_BITS = 10
_OWN = "grp long, ref long, doc_id long, n long, sid binary, own binary"


def _own_shingles(scanned: DataFrame) -> DataFrame:
    """For groups of documents, which of them have a shingle for themselves
    (once per shingle); the documents' rows pass on."""
    names = [f.split()[0] for f in _OWN.split(", ")]

    def batch(grp, ref, doc_id, n, sid, own):
        return pa.RecordBatch.from_arrays(
            [pa.array(grp, pa.int64()), pa.array(ref, pa.int64()), pa.array(doc_id, pa.int64()),
             pa.array(n, pa.int64()), pa.array(sid, pa.binary()), pa.array(own, pa.binary())], names)

    def grouped(refs):
        refs = np.sort(np.concatenate(refs))
        keys, at = np.unique(refs >> _GROUP_BITS, return_index=True)
        parts = np.split((refs & ((1 << _GROUP_BITS) - 1)).astype("<u2"), at[1:])
        none = [None] * len(keys)
        return batch(keys.tolist(), none, none, none, none, [p.tobytes() for p in parts])

    def run(batches):
        held, total = [], 0
        for _, rows in _runs(batches, "bucket"):
            docs = [r for r in rows if r["tokens"] is None]
            if docs:
                yield batch([r["ref"] >> _GROUP_BITS for r in docs], [r["ref"] for r in docs],
                            [r["doc_id"] for r in docs], [r["n"] for r in docs], [r["sid"] for r in docs],
                            [None] * len(docs))
            blobs = [r for r in rows if r["tokens"] is not None]
            if not blobs:
                continue
            token = np.concatenate([np.frombuffer(r["tokens"], "<u8") for r in blobs])
            row = np.concatenate([np.frombuffer(r["rows"], "<u4") for r in blobs])
            base = np.repeat(np.array([r["ref"] for r in blobs], "int64"),
                             [len(r["rows"]) // 4 for r in blobs])
            _, at, count = np.unique(token, return_index=True, return_counts=True)
            at = at[count == 1]
            at = at[row[at] != _MANY]
            held.append(base[at] + row[at])
            total += len(at)
            if total > 1 << 21:
                yield grouped(held)
                held, total = [], 0
        if total:
            yield grouped(held)

    parts = scanned.repartition(shuffle_partitions(scanned.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(parts, run, _OWN)


def members(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """ref, doc_id, n, sid, open: every row with its set; ``open`` where its
    sampled shingles don't rule out a partner with another set."""
    def run(batches):
        for _, rows in _runs(batches, "grp"):
            own = np.zeros(1 << _GROUP_BITS, dtype=np.int64)
            for r in rows:
                if r["own"] is not None:
                    own += np.bincount(np.frombuffer(r["own"], "<u2"), minlength=1 << _GROUP_BITS)
            docs_ = [r for r in rows if r["own"] is None]
            n = np.array([r["n"] for r in docs_], "int64")
            ref = np.array([r["ref"] for r in docs_], "int64")
            may = _may_link(n, own[ref & ((1 << _GROUP_BITS) - 1)], percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ref), pa.array([r["doc_id"] for r in docs_], pa.int64()), pa.array(n),
                 pa.array([r["sid"] for r in docs_], pa.binary()), pa.array(may)],
                ["ref", "doc_id", "n", "sid", "open"])

    own = _own_shingles(_scan(docs, words))
    own = own.repartition(shuffle_partitions(docs.sparkSession), "grp").sortWithinPartitions("grp")
    return stage(map_arrow(own, run, "ref long, doc_id long, n long, sid binary, open boolean"),
                 "jaccard-members")


# -- the points left, their rarest shingles --------------------------------------


def _refs(known: DataFrame) -> DataFrame:
    """sid, ref, carrier: the ref of every open set, and the least of its doc_ids."""
    return known.where("open").groupBy("sid").agg(F.min("ref").alias("ref"), F.min("doc_id").alias("carrier"))


def _points(docs: DataFrame, known: DataFrame, words: int) -> DataFrame:
    """slice, ref, n, tokens: one row for each open set, read again from one of
    its documents. (A repeated row may give its point twice, which only makes
    its shingles look more common.)"""
    # Sets that a single change parts too far link with equal ones alone.
    carriers = _refs(known)
    texts = docs.select("doc_id", "text").join(carriers, F.col("doc_id") == F.col("carrier"))

    def sets(batches):
        for b in slices(batches):
            ids = [set_id(shingles(t, words)) for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), b.column("text")], ["sid", "text"])

    # Sets that no numbered document has are found among the others by their id.
    rest = map_arrow(docs.where("doc_id IS NULL").select("text"), sets, "sid binary, text string").dropDuplicates(["sid"])
    texts = texts.select("sid", "ref", "text").unionByName(
        rest.join(carriers.where("carrier IS NULL"), "sid").select("sid", "ref", "text"))

    def run(batches):
        key, held = TaskContext.get().partitionId() << 24, 0
        for b in slices(batches):
            out = []
            for sid, ref, text in zip(b.column("sid").to_pylist(), b.column("ref").to_pylist(), texts_of(b)):
                s = shingles(text, words)
                if set_id(s) == sid:  # a doc_id may have other texts too
                    out.append((key, ref, len(s), s.tobytes()))
                    held += len(s)
                    if held > SLICE_SHINGLES:
                        key, held = key + 1, 0
            if out:
                k, r, n, t = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array(r, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(t, pa.binary())], ["slice", "ref", "n", "tokens"])

    return stage(map_arrow(texts.select("sid", "ref", "text"), run,
                           "slice long, ref long, n long, tokens binary"), "jaccard-points")


def _counts(points: DataFrame) -> DataFrame:
    """slice, tokens, counts: for each slice, its shingles that several points
    of the corpus have, with their number of points."""
    def emit(rows, names, types):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    bits = _bucket_bits(points)
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    names = ["bucket", "slice", "tokens", "counts"]

    def count(batches):
        for key, rows in _runs(batches, "slice"):
            token, n = np.unique(np.concatenate([np.frombuffer(r["tokens"], "<u8") for r in rows]),
                                 return_counts=True)
            n = n.astype("<u4")
            yield emit([(b, key, token[i:j].tobytes(), n[i:j].tobytes()) for b, i, j in _by_bucket(token, bits)],
                       names, types)

    def total(batches):
        for b, rows in _runs(batches, "bucket"):
            token = [np.frombuffer(r["tokens"], "<u8") for r in rows]
            every, inv = np.unique(np.concatenate(token), return_inverse=True)
            n = np.bincount(inv, weights=np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]))
            n = np.minimum(n, 0xFFFFFFFF).astype("<u4")[inv]
            out, at = [], 0
            for r, t in zip(rows, token):
                mine = n[at:at + len(t)]
                at += len(t)
                more = mine > 1
                if more.any():
                    out.append((b, r["slice"], t[more].tobytes(), mine[more].tobytes()))
            if out:
                yield emit(out, names, types)

    schema = "bucket int, slice long, tokens binary, counts binary"
    parts = map_arrow(points.select("slice", "tokens"), count, schema)
    parts = parts.repartition(shuffle_partitions(points.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(parts, total, schema).drop("bucket")


def _rarest(points: DataFrame, percent: int) -> DataFrame:
    """ref, n, tokens, missing, rare, common: the points that may link, with the
    number of shingles that no other has, the shingles others have among as many of
    the rarest as a linked point cannot all lack (rarest first), and how widespread
    all of them are."""
    ship(points.sparkSession)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            token = np.concatenate([np.frombuffer(x, "<u8") for x in right.column("tokens").to_pylist()])
            count = np.concatenate([np.frombuffer(x, "<u4") for x in right.column("counts").to_pylist()])
            order = np.argsort(token)
            token, count = token[order], count[order]
        else:
            token, count = np.empty(0, "<u8"), np.empty(0, "<u4")
        out = []
        for ref, n, raw in zip(left.column("ref").to_pylist(), left.column("n").to_pylist(),
                               left.column("tokens").to_pylist()):
            own = np.frombuffer(raw, "<u8")
            at = np.searchsorted(token, own)
            found = at < len(token)
            found[found] = token[at[found]] == own[found]
            missing = n - int(found.sum())
            if not _may_link(n, missing, percent):
                continue
            own, c = own[found], count[at[found]]
            length = n + 1 - (percent * n + 99) // 100 - missing  # the missing ones come first
            rare = own[np.lexsort((own, c))[:max(0, length)]]
            # Points in the middle of their like have more shingles that many have.
            common = float(np.log2(c.astype(np.float64)).sum()) / n
            out.append((ref, n, raw, missing, rare.view("<i8").tolist(), common))
        ref, n, raw, lack, rare, common = zip(*out) if out else ((), (), (), (), (), ())
        return pa.table([pa.array(ref, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary()),
                         pa.array(lack, pa.int64()), pa.array(rare, pa.list_(pa.int64())),
                         pa.array(common, pa.float64())], ["ref", "n", "tokens", "missing", "rare", "common"])

    pairs = points.groupBy("slice").cogroup(_counts(points).groupBy("slice"))
    return stage(pairs.applyInArrow(run, "ref long, n long, tokens binary, missing long, rare array<long>, common double"),
                 "jaccard-rarest")


# -- 2, 3: pivots, windows, recursion ---------------------------------------------


def _measure(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Adds shared and united (sizes of intersection and union) to pairs (x, y)."""
    x = points.select(F.col("ref").alias("x"), F.col("tokens").alias("x_tokens"))
    y = points.select(F.col("ref").alias("y"), F.col("tokens").alias("y_tokens"))

    def run(batches):
        for b in batches:
            shared, united = [], []
            for p, q in zip(b.column("x_tokens").to_pylist(), b.column("y_tokens").to_pylist()):
                p, q = np.frombuffer(p, "<u8"), np.frombuffer(q, "<u8")
                s = len(np.intersect1d(p, q, assume_unique=True))
                shared.append(s)
                united.append(len(p) + len(q) - s)
            yield pa.RecordBatch.from_arrays(
                [b.column("x"), b.column("y"), pa.array(shared, pa.int64()), pa.array(united, pa.int64())],
                ["x", "y", "shared", "united"])

    joined = pairs.select("x", "y").join(x, "x").join(y, "y").select("x", "y", "x_tokens", "y_tokens")
    return stage(map_arrow(joined, run, "x long, y long, shared long, united long"), "jaccard-measured")


def _homes(pivot_links: DataFrame) -> DataFrame:
    """ref, home, at: each linked point's nearest pivot and its distance."""
    at = 1 - F.col("shared") / F.col("united")
    return pivot_links.groupBy(F.col("x").alias("ref")).agg(
        F.min(F.struct(at.alias("at"), F.col("y").alias("home"))).alias("h")).select("ref", "h.home", "h.at")


def _can_share(n, k, m, j, percent: int):
    """Whether sets of n and m shingles can link at a region where at most k and j
    of theirs are still to come (this one included). Shingles come in one order for
    all sets, rarest first, those of a single set before all others. At the first region
    two sets share they have nothing in common before it, so at most the lesser of k
    and j; elsewhere a pair may be left out, since it met there."""
    return percent * (n + m) <= (100 + percent) * F.least(k, j)


def _across(rows: DataFrame, cells: DataFrame, points: DataFrame, percent: int, found: DataFrame) -> DataFrame:
    """``found`` and the links between points of different classes in regions
    (region, ref, n, k, cls, home, at), where one of the two is at home with a pivot
    of ``cells`` (region, home, c, least, most, best). Every point meets these pivots,
    and classes that get linked so are one from then on. One farther from a pivot
    than a member's distance and EPSILON cannot link to that member; those still
    in another class that stand at the boundary of the pivot's cell are measured
    against it."""
    linked = 100 * F.col("shared") >= percent * F.col("united")
    width = (100 - percent) / 100 + 1e-9
    fits = ((percent * F.col("n") <= 100 * F.col("most")) & (percent * F.col("least") <= 100 * F.col("n"))
            & _can_share(F.col("n"), F.col("k"), F.col("least"), F.col("best"), percent))
    meet = rows.select("region", F.col("ref").alias("x"), "n", "k", "cls").join(cells, "region").where(
        (F.col("cls") != F.col("c")) & (F.col("x") != F.col("home")) & fits).select(
        "region", "x", "n", "k", F.col("home").alias("y"))
    to_pivot = _measure(meet.select("x", "y").distinct(), points)
    found = found.unionByName(to_pivot.where(linked))
    now = connected_components(found, "x", "y")
    apart = to_pivot.where(~linked).select("x", "y", (1 - F.col("shared") / F.col("united")).alias("far")).where(
        F.col("far") <= 2 * width)
    for side in ("x", "y"):
        apart = apart.join(now.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")), side, "left")
    apart = apart.where("coalesce(x_label, x) != coalesce(y_label, y)").select("x", "y", "far")
    members = rows.where("ref != home").select(
        "region", F.col("home").alias("y"), F.col("ref").alias("z"), F.col("n").alias("m"), F.col("k").alias("j"), "at")
    window = (meet.join(apart, ["x", "y"]).join(members, ["region", "y"])
              .where((F.abs(F.col("far") - F.col("at")) <= width)
                     & (percent * F.greatest("n", "m") <= 100 * F.least("n", "m"))
                     & _can_share(F.col("n"), F.col("k"), F.col("m"), F.col("j"), percent)))
    pairs = window.select(F.greatest("x", "z").alias("x"), F.least("x", "z").alias("y")).distinct()
    return found.unionByName(_measure(pairs, points).where(linked))


def links(points: DataFrame, percent: int = PERCENT, pivots: int = PIVOTS):
    """Links (x, y, shared, united) that connect every class of linked points,
    each verified, and the label of every point that has one: (links, labels)."""
    linked = 100 * F.col("shared") >= percent * F.col("united")
    # The regions are the rarest shingles; their pivots give the first classes.
    regions = points.select(F.posexplode("rare").alias("place", "region"), "ref", "n", "missing", "common").select(
        "region", "ref", "n", (F.col("n") - F.col("missing") - F.col("place")).alias("k"), "common").distinct()
    # The pivot is the point in the middle: most of the others are near to it.
    middle = F.struct((-F.col("common")).alias("rare"), "ref")
    first = regions.groupBy("region").agg(F.min(F.struct(middle.alias("m"), "n", "k")).alias("p"),
                                          F.count(F.lit(1)).alias("size")).where("size > 1")
    first = stage(first.select("region", F.col("p.m.ref").alias("pivot"), F.col("p.n").alias("m"), F.col("p.k").alias("j")),
                  "jaccard-first")
    met = regions.join(first, "region").where(
        (F.col("ref") != F.col("pivot")) & _can_share(F.col("n"), F.col("k"), F.col("m"), F.col("j"), percent))
    found = _measure(met.select(F.col("ref").alias("x"), F.col("pivot").alias("y")).distinct(), points).where(linked)
    classes = connected_components(found, "x", "y").select(F.col("node").alias("ref"), "label")
    rows = regions.join(classes, "ref", "left").join(_homes(found), "ref", "left").select(
        "region", "ref", "n", "k", F.coalesce("label", "ref").alias("cls"),
        F.coalesce("home", "ref").alias("home"), F.coalesce("at", F.lit(0.0)).alias("at"))
    while True:
        several = rows.groupBy("region").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
        rows = stage(rows.join(several.select("region"), "region"), "jaccard-regions")
        if rows.isEmpty():
            return found, connected_components(found, "x", "y")
        cells = rows.groupBy("region", "home").agg(
            F.min("cls").alias("c"), F.min("n").alias("least"), F.max("n").alias("most"), F.max("k").alias("best"))
        taken = stage(cells.withColumn("nth", F.row_number().over(
            Window.partitionBy("region").orderBy("home"))).where(F.col("nth") <= pivots), "jaccard-pivots")
        found = _across(rows, taken, points, percent, found)
        # What is at home with these pivots has met all; the rest of a region
        # with more pivots goes on.
        rows = rows.join(taken.select("region", "home"), ["region", "home"], "left_anti")


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    known = members(docs, words, percent)
    points = _rarest(_points(docs, known, words), percent)
    _, labels = links(points, percent, pivots)
    # The class of a set: of its point where it links, else its own. Lists are
    # written, so that the rows of a set or class with many copies can be split.
    refs = _refs(known).select("sid", F.col("ref").alias("node"))
    named = stage(refs.join(labels, "node").select("sid", "label"), "jaccard-labels")
    rows = known.join(named, "sid", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce(
            F.col("label").cast("string").cast("binary"), F.col("sid"))).alias("class"))
    least = stage(rows.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("component_id")),
                  "jaccard-least")
    return rows.join(least, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(documents(spark, sf_dir))
