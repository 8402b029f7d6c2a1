"""Line dedup: a segment-partition edit join over all lines of all documents.

A line with a word (taken without white space around it) is dropped if an equal
line, or one at an edit distance of at most THRESHOLD, occurs earlier: in a
document of lower doc_id, or above it in its own. Nearness is to lines as given,
whether these are dropped or not, and needs THRESHOLD + 1 characters on both
sides, so that no segment is empty; a line of one or two goes for an equal one
alone.

Join: a line of length l is split into THRESHOLD + 1 segments, indexed by (their
text, number, l). A partner at most THRESHOLD edits away holds one of them
unchanged; lines probe, for each length from their own down to THRESHOLD less,
only the few starts that a least-edits alignment allows. Lines that meet under a
key are a group; only packed hashes move to find them, and texts do for the members
of groups alone.

A line needs one earlier near line, not all of them. So each group offers its
HEADS earliest lines, every member goes through them in their order, with a banded
bit-parallel edit distance, until one is near, and rows are as many as members,
whatever a group's size. Members that found none, of groups with more earlier lines
than the heads, go on to the next heads, until every earlier line of their group has
been tried. A group that still has more than SPLIT_OVER lines is split again first,
by the segments of what remains of its lines without the shared segment (still at most
THRESHOLD apart), SPLITS times at most.

Places: documents follow each other by doc_id, nulls last, rows of one doc_id by a
hash of their text, lines by number.

Defined results: null and empty texts have no lines to drop; rows equal in doc_id
and text are repeats, of which the first as read keeps its lines and the others lose
all of them; equal lines keep the first; an empty table gives no rows; other
columns of the input stay as they are in ``deduped`` and are not read otherwise."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_arrow, null_text, shuffle_partitions, slices, stage

THRESHOLD = 2
HEADS = 128            # earliest lines of a group that its members are compared with at first,
MOST_HEADS = 256       # and at a time later on; bounds what a row carries
SPLIT_OVER = 4096      # groups with more lines left are split again,
SPLITS = 3             # but so often at most; bounds the copies of a line
BUCKET_BITS = 10       # keys are grouped in 2 ** 10 buckets, more where there is more input
CHUNK_CHARS = 1 << 19  # bounds the arrays of hashes that a task holds
BITMAP = 1 << 25       # bits of the filter by which texts of candidates are read
ASCII_SPACE = " \t\n\x0b\x0c\r"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_K = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def lines_of(text: str) -> list[tuple[int, str]]:
    """(number, line without white space around it) of the lines with a word."""
    out = []
    for i, line in enumerate(text.split("\n")):
        s = line.strip(ASCII_SPACE)
        if s:
            out.append((i, s))
    return out


def line_id(line: str) -> int:
    """Even 64-bit id; the lowest bit marks index keys."""
    return xxhash.xxh3_64_intdigest(line.encode()) & ~1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _K[0]
    x = (x ^ (x >> np.uint64(32))) * _K[1]
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n * 5 // 4, _INVERSE)]), dtype=np.uint64)
    return _powers


def segment_keys(texts: list[str], tau: int, shortest: int):
    """(text, key, is index, start, length) arrays of all index and probe keys;
    about CHUNK_CHARS characters at a time."""
    parts, first, chars = [], 0, 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > CHUNK_CHARS:
            parts.append((first, i))
            first, chars = i, 0
        chars += len(t)
    parts.append((first, len(texts)))
    out = []
    for a, b in parts:
        line, *rest = _chunk_keys(texts[a:b], tau, shortest)
        out.append((line + a, *rest))
    return out[0] if len(out) == 1 else tuple(np.concatenate(c) for c in zip(*out))


def _chunk_keys(texts: list[str], tau: int, shortest: int):
    n = np.array([len(t) for t in texts], dtype=np.int64)
    at = np.cumsum(n) - n
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    inverse = _inverse_powers(len(chars) + 1)
    # Sum of char * BASE^place; a stretch's sum times BASE^-start is its hash.
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, len(chars) - 1), _BASE)]), dtype=np.uint64)
    sums = np.zeros(len(chars) + 1, dtype=np.uint64)
    np.cumsum(_mix((chars + np.uint64(1)) * _K[2]) * powers[:len(chars)], out=sums[1:])
    out = []
    for less in range(tau + 1):
        length = n - less
        base, extra = length // (tau + 1), length % (tau + 1)
        for i in range(tau + 1):
            # The last ``extra`` segments are one longer.
            longer_before = np.maximum(0, i - (tau + 1 - extra))
            size = base + (i >= tau + 1 - extra)
            p = i * base + longer_before
            low = np.maximum(p - i, p + less - (tau - i))
            high = np.minimum(p + i, p + less + (tau - i))
            for shift in range(int(2 * tau + 1)):
                start = low + shift
                ok = np.flatnonzero((start <= high) & (start >= 0) & (start + size <= n) & (length >= shortest)
                                    & (size > 0))
                if not len(ok):
                    continue
                s = at[ok] + start[ok]
                h = (sums[s + size[ok]] - sums[s]) * inverse[s]
                key = _mix(h + length[ok].astype(np.uint64) * _K[0] + np.uint64(i + 1) * _K[1])
                out.append((ok, key, (less == 0) & (start[ok] == p[ok]), start[ok], size[ok]))
    if not out:
        e = np.empty(0, np.int64)
        return e, e.astype(np.uint64), e.astype(bool), e, e
    return tuple(np.concatenate(c) for c in zip(*out))


def edit_distance(a: str, b: str, tau: int) -> int:
    """Edit distance if at most ``tau``, else tau + 1. Bit-parallel over the band
    of 2 tau + 1 diagonals: bit r of a column's vectors stands for row
    column + r - tau, so that the vectors move down by one row per column."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > tau:
        return tau + 1
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    e = 0
    while e < len(b) - k and a[-1 - e] == b[-1 - e]:
        e += 1
    a, b = a[k:len(a) - e], b[k:len(b) - e]
    if not b:
        return len(a) if len(a) <= tau else tau + 1
    # a runs down the rows, b along the columns. In column c bit i of a vector
    # stands for row c - tau + i; vertical steps are kept as the next column needs
    # them. Rows above the matrix repeat row 0.
    m, n, width = len(a), len(b), 2 * tau + 1
    ones = (1 << width) - 1
    rows: dict[str, int] = {}
    for r, ch in enumerate(a):
        rows[ch] = rows.get(ch, 0) | (1 << r)
    plus, minus = ones & ~((1 << tau) - 1), 0
    # First the value in the band's lowest row, which goes down with the columns,
    # then the value in row m.
    score = min(tau, m)
    for c in range(1, n + 1):
        here, shift = rows.get(b[c - 1], 0), c - 1 - tau
        match = (here >> shift if shift >= 0 else here << -shift) & ones
        d0 = ((((match & plus) + plus) ^ plus) | match | minus) & ones
        hp = minus | (~(d0 | plus) & ones)
        hn = d0 & plus
        if c + tau <= m:
            score += not d0 >> (width - 1)
        else:
            at = m - c + tau
            score += (hp >> at & 1) - (hn >> at & 1)
        # From here on a column lowers the value by one at most, in row m only.
        if score > tau + n - max(c, m - tau):
            return tau + 1
        plus = (hn | ~((d0 >> 1) | hp)) & ones
        minus = (d0 >> 1) & hp
    return score


# -- candidates ---------------------------------------------------------------------

_PACKED = "bucket int, keys binary, ids binary"
_MEMBERS = "key long, id long"


def _bucket_bits(docs: DataFrame) -> int:
    """A task groups a bucket at a time: two buckets for each part of the input."""
    return max(BUCKET_BITS, (2 * docs.rdd.getNumPartitions()).bit_length())


def _packed_keys(docs: DataFrame, tau: int, bits: int) -> DataFrame:
    """For each slice of documents and bucket: keys and the ids of their lines."""
    def run(batches):
        for b in slices(batches):
            lines = {line_id(s): s for t in b.column("text").to_pylist() for _, s in lines_of(t or "")}
            if not lines:
                continue
            ids = np.array(list(lines), dtype=np.uint64)
            line, key, index, _, _ = segment_keys(list(lines.values()), tau, tau + 1)
            order = np.argsort(key, kind="stable")
            key = key[order]
            tagged = ids[line[order]] | index[order].astype(np.uint64)
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
            cuts = [*start.tolist(), len(bucket)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[start], pa.int32()), pa.array([key[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary()),
                 pa.array([tagged[x:y].tobytes() for x, y in zip(cuts, cuts[1:])], pa.binary())], ["bucket", "keys", "ids"])

    return map_arrow(docs.select("text"), run, _PACKED)


def _shared(key: np.ndarray, tagged: np.ndarray):
    """(keys, ids) of the keys that several lines share, one of them as its index."""
    ids, index = tagged & ~np.uint64(1), tagged & np.uint64(1)
    order = np.lexsort((ids, key))
    key, ids, index = key[order], ids[order], index[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
    lines = np.add.reduceat(fresh, start)
    shared = np.repeat((lines > 1) & (np.add.reduceat(index, start) > 0), size) & fresh
    return key[shared], ids[shared]


def _members(packed: DataFrame) -> DataFrame:
    """key, id: the lines of every group."""
    def run(batches):
        now, keys, ids = None, [], []

        def close():
            key, id_ = _shared(np.concatenate(keys), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(id_.view(np.int64))], ["key", "id"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != now and keys:
                    yield close()
                    keys, ids = [], []
                now = row["bucket"]
                keys.append(np.frombuffer(row["keys"], "<u8"))
                ids.append(np.frombuffer(row["ids"], "<u8"))
        if keys:
            yield close()

    parts = packed.repartition(shuffle_partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(parts, run, _MEMBERS)


def _bitmap(ids: DataFrame, col: str) -> np.ndarray:
    """A filter of BITMAP bits (4 MB at any size of the input) of 64-bit ids: a
    bit that isn't set proves that no such id is there."""
    bit = F.expr(f"pmod(shiftrightunsigned({col}, 7), {BITMAP})")
    rows = (ids.select((bit / 64).cast("int").alias("word"), (bit % 64).cast("int").alias("bit"))
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toPandas())
    out = np.zeros(BITMAP // 64, dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint64)


def _in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    bit = (ids >> np.uint64(7)) % np.uint64(BITMAP)
    return (bitmap[(bit // np.uint64(64)).astype(np.int64)] >> (bit % np.uint64(64))) & np.uint64(1) == 1


_PLACE = "none boolean, doc_id long, sig long, no int"


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, line, place: the lines whose ids ``ids`` lists, with their first place."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids, "id"))

    def run(batches):
        for b in slices(batches):
            doc, sig = b.column("doc_id").to_pylist(), b.column("sig").to_pylist()
            first: dict[str, tuple] = {}
            for d, g, t in zip(doc, sig, b.column("text").to_pylist()):
                for no, s in lines_of(t or ""):
                    place = (d is None, d or 0, g, no)
                    if s not in first or place < first[s]:
                        first[s] = place
            if not first:
                continue
            key = np.array([line_id(s) for s in first], dtype=np.uint64)
            keep = np.flatnonzero(_in_bitmap(shared.value, key)).tolist()
            line, place = list(first), list(first.values())
            none, doc, sig, no = zip(*(place[k] for k in keep)) if keep else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[keep].view(np.int64)), pa.array([line[k] for k in keep], pa.string()),
                 pa.array(none, pa.bool_()), pa.array(doc, pa.int64()), pa.array(sig, pa.int64()),
                 pa.array(no, pa.int32())], ["id", "line", "none", "doc_id", "sig", "no"])

    found = map_arrow(docs.select("doc_id", "text", _sig()), run, f"id long, line string, {_PLACE}")
    return (found.join(ids, "id", "left_semi").groupBy("id", "line")
            .agg(F.min(F.struct("none", "doc_id", "sig", "no")).alias("place")))


_ROWS = f"key long, line string, place struct<{_PLACE.replace(' ', ':').replace(',:', ',')}>, x boolean, y boolean, rest string"


def _near_any(lines: list[str], others: list[list[str]], tau: int) -> list[bool]:
    """For each line, whether one of its others (tried in their order) is near.
    An edit changes the counts of characters by two at most, which sets most apart."""
    texts = {s: i for i, s in enumerate(dict.fromkeys([*lines, *(h for hs in others for h in hs)]))}
    counts = np.zeros((len(texts), 64), dtype=np.int32)
    for s, i in texts.items():
        chars = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4") & 63
        counts[i] = np.bincount(chars, minlength=64)
    out = []
    for s, hs in zip(lines, others):
        apart = np.abs(counts[[texts[h] for h in hs]] - counts[texts[s]]).sum(axis=1) if hs else np.empty(0)
        out.append(any(hs[k] != s and edit_distance(s, hs[k], tau) <= tau
                       for k in np.flatnonzero(apart <= 2 * tau).tolist()))
    return out


def _offered(rows: DataFrame, heads: int, tau: int) -> DataFrame:
    """Every x of a group compared with the group's earliest y, in their order: (key,
    line, near, done (near, or all earlier y were among them); key, last: the last of these y)."""
    w = Window.partitionBy("key").orderBy("place", "line")
    ys = rows.where("y")
    first = ys.select("key", "line", "place", F.row_number().over(w).alias("nth")).where(F.col("nth") <= heads)
    offer = first.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("head"))
    # Written, so that the join has plain exchanges and the rows of a large group can be split.
    offer = stage(offer.select("key", F.transform("head", lambda h: h["line"]).alias("heads"),
                               F.transform("head", lambda h: h["place"]).alias("places"),
                               F.element_at("head", -1).alias("last")), "lines-heads")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a row holds up to ``heads`` lines
                b = batch.slice(at, 256)
                near = _near_any(b.column("line").to_pylist(), b.column("earlier").to_pylist(), tau)
                done = [x or c for x, c in zip(near, b.column("covered").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("line"), pa.array(near, pa.bool_()), pa.array(done, pa.bool_())],
                    ["key", "line", "near", "done"])

    before = F.size(F.filter("places", lambda p: p < F.col("place")))
    asked = rows.where("x").select("key", "line", "place").join(offer, "key").select(
        "key", "line", F.slice("heads", F.lit(1), before).alias("earlier"),
        ((F.size("heads") < heads) | (before < F.size("heads"))).alias("covered"))
    return map_arrow(asked, run, "key long, line string, near boolean, done boolean"), offer.select("key", "last")


def _split_again(rows: DataFrame, tau: int) -> DataFrame:
    """The rows under the keys of the segments of their ``rest``, each without the
    segment. A row without a rest is the whole line, and first loses the segment of its key."""
    def own(batches):
        for b in batches:
            text = b.column("line").to_pylist()
            if not text:
                continue
            keys = np.array(b.column("key").to_pylist(), dtype=np.int64).view(np.uint64)
            line, key, _, start, size = segment_keys(text, tau, tau + 1)
            mine = np.flatnonzero(key == keys[line])
            at = line[mine]
            yield _taken(b, at, b.column("key").take(pa.array(at)), [
                text[i][:p] + text[i][p + z:] for i, p, z in zip(at, start[mine], size[mine])])

    def next_keys(batches):
        for b in batches:
            rest = b.column("rest").to_pylist()
            if not rest:
                continue
            parent = np.array(b.column("key").to_pylist(), "int64").view(np.uint64)
            line, key, _, start, size = segment_keys(rest, tau, 0)
            yield _taken(b, line, pa.array(_mix(key + parent[line] * _K[2]).view(np.int64)), [
                rest[i][:p] + rest[i][p + z:] for i, p, z in zip(line, start, size)])
            # Too short for segments: they stay with all that are little longer.
            stay = np.flatnonzero(np.array([len(r) for r in rest]) < 3 * tau + 1)
            if len(stay):
                yield _taken(b, stay, pa.array(_mix(parent[stay]).view(np.int64)), [rest[k] for k in stay])

    rows = map_arrow(rows.where("rest IS NULL"), own, _ROWS).unionByName(rows.where("rest IS NOT NULL"))
    return map_arrow(rows, next_keys, _ROWS).dropDuplicates(["key", "line", "rest"])


def _taken(b: pa.RecordBatch, at: np.ndarray, key: pa.Array, rest: list[str]) -> pa.RecordBatch:
    take = {c: b.column(c).take(pa.array(at)) for c in ("line", "place", "x", "y")}
    return pa.RecordBatch.from_arrays([key, take["line"], take["place"], take["x"], take["y"], pa.array(rest, pa.string())],
                                      ["key", "line", "place", "x", "y", "rest"])


def near_lines(docs: DataFrame, tau: int = THRESHOLD, heads: int = HEADS, split_over: int = SPLIT_OVER) -> DataFrame:
    """line: the lines that an earlier line is near to (1 to ``tau`` edits), once each."""
    members = stage(_members(_packed_keys(docs, tau, _bucket_bits(docs))), "lines-members")
    lines = stage(_texts(docs, members.select("id").distinct()), "lines-texts")
    # Two lines of one id would both join: the line itself tells them apart from here on.
    true, none = F.lit(True), F.lit(None).cast("string")
    rows = stage(members.join(lines, "id").select(
        "key", "line", "place", true.alias("x"), true.alias("y"), none.alias("rest")), "lines-rows")
    found, splits = None, 0
    while True:
        offered, offer = _offered(rows, heads, tau)
        offered = stage(offered, "lines-offered")
        near = offered.where("near").select("line").distinct()
        found = near if found is None else found.unionByName(near).distinct()
        # Who goes on asking, and the lines of their groups after those offered.
        asks = stage(offered.where("NOT done").select("key", "line").join(near, "line", "left_anti").select(
            "key", "line", true.alias("asks")), "lines-open")
        if asks.isEmpty():
            return found
        groups = asks.select("key").distinct().join(offer, "key")
        going = rows.join(groups, "key").join(asks, ["key", "line"], "left").select(
            "key", "line", "place", (F.col("x") & F.col("asks").isNotNull()).alias("x"),
            (F.col("y") & (F.struct("place", "line") > F.col("last"))).alias("y"), "rest").where("x OR y")
        rows, heads = stage(going, "lines-rows"), max(heads, min(2 * heads, MOST_HEADS))
        if splits < SPLITS:
            large = stage(rows.where("y").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(
                F.col("n") > split_over).select("key"), "lines-large")
            if not large.isEmpty():
                rows = stage(rows.join(large, "key", "left_anti").unionByName(
                    _split_again(rows.join(large, "key", "left_semi"), tau)), "lines-rows")
                splits += 1


# -- decisions ------------------------------------------------------------------------


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode())


def _sig():
    """Tells rows of one doc_id apart; rows of equal text are repeats."""
    return F.xxhash64(null_text()).alias("sig")


def occurrences(docs: DataFrame) -> DataFrame:
    """ref, doc_id, sig, n_lines, numbers, keys: the lines with a word of every row."""
    def run(batches):
        ref = TaskContext.get().partitionId() << 36
        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            found = [lines_of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(ref, ref + len(texts)), pa.int64()), b.column("doc_id"), b.column("sig"),
                 pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int32()),
                 pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())),
                 pa.array([[line_key(s) for _, s in f] for f in found], pa.list_(pa.binary()))],
                ["ref", "doc_id", "sig", "n_lines", "numbers", "keys"])
            ref += len(texts)

    return stage(map_arrow(docs.select("doc_id", "text", _sig()), run, "ref long, doc_id long, sig long, n_lines int, "
                           "numbers array<int>, keys array<binary>"), "lines-occurrences")


def _repeats(rows: DataFrame) -> DataFrame:
    """doc_id, sig, ref (the first as read) of the rows that come more than once."""
    return stage(rows.groupBy("doc_id", "sig").agg(F.count(F.lit(1)).alias("_n"), F.min("ref").alias("ref"))
                 .where("_n > 1").drop("_n"), "lines-repeats")


def _decided(docs: DataFrame, rows: DataFrame, tau: int, heads: int, split_over: int) -> DataFrame:
    """ref, dropped, n_equal, n_near of the rows that lose lines, repeats left out of account."""
    each = rows.select("ref", "doc_id", "sig", F.explode(F.arrays_zip("numbers", "keys")).alias("l")).select(
        "ref", F.col("l.keys").alias("key"), F.struct(
            F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "sig",
            F.col("l.numbers").alias("no")).alias("place"))
    first = each.groupBy("key").agg(F.min("place").alias("first"))

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([line_key(s) for s in b.column("line").to_pylist()], pa.binary())], ["key"])

    near = map_arrow(near_lines(docs, tau, heads, split_over), keys, "key binary").withColumn("near", F.lit(True))
    # Written, so that the join below has plain exchanges on both sides and a line
    # that very many documents hold can be split.
    state = stage(first.join(near, "key", "left").select(
        "key", "first", F.coalesce("near", F.lit(False)).alias("near")), "lines-state")
    gone = each.join(state, "key").select("ref", F.col("place.no").alias("no"), "near",
                                          (F.col("place") != F.col("first")).alias("equal")).where("equal OR near")
    return gone.groupBy("ref").agg(
        F.sort_array(F.collect_list("no")).alias("dropped"),
        F.sum(F.col("equal").cast("long")).alias("n_equal"),
        F.sum((~F.col("equal")).cast("long")).alias("n_near"))


def dropped_lines(docs: DataFrame, tau: int = THRESHOLD, heads: int = HEADS,
                  split_over: int = SPLIT_OVER) -> DataFrame:
    """ref, doc_id, n_lines, dropped (numbers of the lines that go, from 0),
    n_equal, n_near of every row."""
    rows = occurrences(docs)
    decided = _decided(docs, rows, tau, heads, split_over)
    out = rows.join(decided, "ref", "left")
    zero, some = F.lit(0).cast("long"), F.array().cast("array<int>")
    cols = {"dropped": F.coalesce("dropped", some), "n_equal": F.coalesce("n_equal", zero), "n_near": F.coalesce("n_near", zero)}
    repeats = _repeats(rows)
    if not repeats.isEmpty():  # all but the first as read lose every line
        firsts = repeats.select(F.col("doc_id").alias("_doc"), F.col("sig").alias("_sig"), F.col("ref").alias("_first"))
        out = out.join(firsts, out["doc_id"].eqNullSafe(F.col("_doc")) & (out["sig"] == F.col("_sig")), "left")
        again = F.col("_first").isNotNull() & (F.col("ref") != F.col("_first"))
        cols = {"dropped": F.when(again, F.col("numbers")).otherwise(cols["dropped"]),
                "n_equal": F.when(again, F.size("numbers").cast("long")).otherwise(cols["n_equal"]),
                "n_near": F.when(again, zero).otherwise(cols["n_near"])}
    return out.select("ref", "doc_id", "n_lines", *[c.alias(n) for n, c in cols.items()])


def deduped(docs: DataFrame, tau: int = THRESHOLD, heads: int = HEADS, split_over: int = SPLIT_OVER) -> DataFrame:
    """Rows of ``docs`` without the dropped lines. A document that loses every
    line with a word goes, so of repeats with such a line one stays; one that had none
    stays. n_chars follows the text. Lines are known by doc_id, text and number."""
    rows = occurrences(docs)
    repeats = _repeats(rows)
    # Repeats lose the same lines as the first of them, and go afterwards.
    lost = rows.select("ref", "doc_id", "sig").join(_decided(docs, rows, tau, heads, split_over).select("ref", "dropped"), "ref")
    drops = lost.groupBy(F.col("doc_id").alias("_lost_id"), F.col("sig").alias("_lost_sig")).agg(F.first("dropped").alias("_lost_lines"))
    docs_ = docs.withColumn("_text_sig", _sig())
    out = docs_.join(drops, docs_["doc_id"].eqNullSafe(F.col("_lost_id")) & (F.col("_text_sig") == F.col("_lost_sig")), "left")
    left = F.expr("""array_join(transform(filter(transform(split(text, '\\n', -1), (l, i) -> struct(i, l)),
        x -> NOT array_contains(_lost_lines, x.i)), x -> x.l), '\\n')""")
    changed, word = F.col("_lost_lines").isNotNull(), "[^\\x20\\x09-\\x0D]"
    out = out.withColumn("_left_text", F.when(changed, left))
    out = out.where(~changed | F.col("_left_text").rlike(word))
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.when(changed, F.col("_left_text")).otherwise(docs_[c]).alias(c))
        elif c == "n_chars":
            cols.append(F.when(changed, F.length("_left_text").cast("long")).otherwise(docs_[c]).alias(c))
        else:
            cols.append(docs_[c].alias(c))
    if repeats.isEmpty():
        return out.select(*cols)
    many = repeats.select(F.col("doc_id").alias("_rep_id"), F.col("sig").alias("_rep_sig"))
    out = out.join(many, docs_["doc_id"].eqNullSafe(F.col("_rep_id")) & (F.col("_text_sig") == F.col("_rep_sig")), "left")
    again = F.col("_rep_sig").isNotNull() & F.coalesce(docs_["text"].rlike(word), F.lit(False))
    once = out.where(again).select(*cols, F.col("_rep_id"), F.col("_rep_sig")).dropDuplicates(["_rep_id", "_rep_sig"]).drop("_rep_id", "_rep_sig")
    return out.where(~again).select(*cols).unionByName(once)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(documents(spark, sf_dir)).drop("ref")
