"""MinHash near-dedup by an LSH forest.

1. One pass over the texts makes each document's shingle set, a 128-bit digest
   of it and ``HASHES`` minimum hashes. Documents with equal sets form one class.
2. Each of ``ORDERS`` orders sorts the classes by a signature order of its own.
   The longest common prefix of neighbours in it, ``DEPTH`` to ``DEEPEST`` hashes,
   parts them into regions. The depth of a region adapts to its density: at the
   least depth at which it holds ``REGION`` rows or fewer, each row meets all the
   others; a denser region is parted by one more hash, and what is still dense at
   the deepest meets its nearest neighbours, as do rows on both sides of a cut.
   Rows whose two-bit sketches agree well are candidates. At a Jaccard similarity
   of 0.8 the chance that a pair shares no region is (1 - 0.8**3)**24 = 3e-8.
3. Candidates joined together form zones. Full sets are compared exactly inside
   zones only: in one chunk if the zone is small; otherwise in several random
   dealings into chunks of bounded size, after which the rows outside the zone's
   main class are compared with all its rows in blocks. No link is left out and
   no task ever holds more than two chunks.
4. Confirmed links are contracted to connected components.

Sets are compared as sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from . import arrowtext as at
from .components import components
from .workspace import Workspace

HASHES = 72
ORDERS = 24
DEPTH = 3
DEEPEST = 7
#: Rows of a region that all meet each other; beyond it the region is parted by one more hash.
REGION = 8
#: Nearest neighbours that meet whatever the depth.
NEIGHBOURS = 2
#: Forest rows of one range partition, at least: a border between two of them parts neighbours in one order only.
PART_ROWS = 1 << 16
MOST_PARTS = 8192
#: Of 64 two-bit sketches, so many must agree: six deviations below the mean at 0.8.
AGREE = 37
CHUNK = 256
DEALS = 3
_COLUMNS = 4096
_BLOCK = 8192
_U = np.uint64
_SCALE = at.constants(31, HASHES) | _U(1)
_SHIFT = at.constants(32, HASHES)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    raw, off = at.utf8(batch.column("text"))
    for a, b in at.slices(off):
        hashes, mark = at.words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
        for i in range(b - a):
            yield np.unique(at.shingles(hashes[mark[i] : mark[i + 1]], width))


def _signature(x: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, ~_U(0), np.uint64)
    for a in range(0, len(x), _BLOCK):
        part = x[a : a + _BLOCK]
        np.minimum(out, (_SCALE[:, None] * part[None, :] + _SHIFT[:, None]).min(axis=1), out=out)
    return (out >> _U(32)).astype(np.uint32)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            size, one, two = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            signatures = np.zeros((n, HASHES), np.uint32)
            for i, x in enumerate(_sets(batch, width)):
                if len(x):
                    size[i], one[i], two[i] = len(x), at.mix64(x).sum(), at.mix64(x ^ _U(0xA5A5A5A5A5A5A5A5)).sum()
                    signatures[i] = _signature(x)
            packed = pa.Array.from_buffers(pa.binary(HASHES * 4), n, [None, pa.py_buffer(signatures.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(at.signed(one)), pa.array(at.signed(two)), packed], names=["doc_id", "n_shingles", "d1", "d2", "signature"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per class and order: region, the rest of the order's prefix, sketches."""
    for batch in batches:
        for part in (batch.slice(a, 2048) for a in range(0, batch.num_rows, 2048)):
            n = part.num_rows
            s = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint32).reshape(n, HASHES).astype(np.uint64)
            bit = np.arange(64, dtype=np.uint64)
            low = ((s[:, :64] & _U(1)) << bit).sum(axis=1, dtype=np.uint64)
            high = (((s[:, :64] >> _U(1)) & _U(1)) << bit).sum(axis=1, dtype=np.uint64)
            doc = part.column("doc_id").to_numpy(zero_copy_only=False)
            region, rest = np.zeros((n, ORDERS), np.uint64), np.zeros((n, ORDERS), np.uint64)
            for t in range(ORDERS):
                order = [(t * DEPTH + k) % HASHES for k in range(DEEPEST)]
                key = np.full(n, t, np.uint64)
                for k in order[:DEPTH]:
                    key = at.mix64(key + s[:, k])
                region[:, t] = key
                for place, k in enumerate(order[DEPTH:]):
                    rest[:, t] |= (s[:, k] & _U(0xFFFF)) << _U(16 * (3 - place))
            each = lambda x: np.repeat(x, ORDERS)
            yield pa.RecordBatch.from_arrays([pa.array(at.signed(region.ravel())), pa.array(at.signed(rest.ravel())), pa.array(each(doc)), pa.array(at.signed(each(low))), pa.array(at.signed(each(high)))], names=["region", "rest", "doc_id", "low", "high"])


def prefix_lengths(region: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Longest common prefix, in hashes, of each row and the next one in sorted order; 0 across regions."""
    differ = (rest[:-1] ^ rest[1:]).view(np.uint64)
    more = np.full(len(differ), DEEPEST - DEPTH)
    for place in range(DEEPEST - DEPTH - 1, -1, -1):
        # The hash at this place is the first of those checked so far that differs.
        more[(differ >> _U(16 * (DEEPEST - DEPTH - 1 - place))) & _U(0xFFFF) != 0] = place
    return np.where(region[:-1] == region[1:], DEPTH + more, 0)


def reaches(lcp: np.ndarray) -> np.ndarray:
    """For each row, how many following rows it meets: to the end of its region at the depth that fits, or its neighbours."""
    n = len(lcp) + 1
    reach = np.zeros(n, np.int64)
    done = np.zeros(n, bool)
    row = np.arange(n)
    for depth in range(DEPTH, DEEPEST + 1):
        new = np.append(True, lcp < depth)
        first = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        end = np.append(first[1:], n)[which]
        fits = ~done & (end - first[which] <= REGION)
        reach[fits] = (end - 1 - row)[fits]
        done |= fits
    shared = np.append(lcp >= DEPTH, False)
    near = np.zeros(n, np.int64)
    going = np.ones(n, bool)
    for step in range(NEIGHBOURS):
        going &= np.append(shared[step:], np.zeros(step, bool))
        near += going
    return np.maximum(reach, near)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates among rows sorted by (region, rest); a partition is read in blocks with the open region's last rows carried over."""
    carried = None
    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "rest", "doc_id", "low", "high")]
        fresh = 0
        if carried is not None:
            fresh = len(carried[0])
            now = [np.concatenate(x) for x in zip(carried, now, strict=True)]
        region, rest, doc, low, high = now
        if len(doc) == 0:
            continue
        reach = reaches(prefix_lengths(region, rest))
        found = []
        for step in range(1, max(REGION - 1, NEIGHBOURS) + 1):
            i = np.arange(max(0, fresh - step), len(doc) - step)
            i = i[(reach[i] >= step) & (doc[i] != doc[i + step])]
            differ = (low[i] ^ low[i + step]) | (high[i] ^ high[i + step])
            i = i[64 - np.bitwise_count(differ.view(np.uint64)).astype(np.int64) >= AGREE]
            found.append(np.stack([np.minimum(doc[i], doc[i + step]), np.maximum(doc[i], doc[i + step])]))
        pairs = np.concatenate(found, axis=1)
        carried = [x[-max(REGION - 1, NEIGHBOURS) :] for x in now]
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["u", "v"])


def _overlap(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of every left with every right set, by blocks of a 0/1 matrix product."""
    out = np.zeros((len(left), len(right)), np.float64)
    if not left or not right:
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    where = []
    for values, row in zip((a, b), rows, strict=True):
        at_ = np.searchsorted(shared, values)
        hit = (at_ < len(shared)) & (shared[np.minimum(at_, len(shared) - 1)] == values) if len(shared) else np.zeros(len(values), bool)
        order = np.argsort(at_[hit], kind="stable")
        where.append((at_[hit][order], row[hit][order]))
    for start in range(0, len(shared), _COLUMNS):
        x, y = (np.zeros((len(s), _COLUMNS), np.float32) for s in (left, right))
        for m, (column, row) in ((x, where[0]), (y, where[1])):
            lo, hi = np.searchsorted(column, [start, start + _COLUMNS])
            m[row[lo:hi], column[lo:hi] - start] = 1
        out += x @ y.T
    return out


def _linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    inter = _overlap(left, right)
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return 100 * inter >= percent * (sizes - inter)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Groups of consecutive rows with equal keys, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _read_sets(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in t.column("members").to_pylist()]


def _within(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["zone", "chunk"]):
            doc = t.column("doc_id").to_numpy()
            sets = _read_sets(t)
            link = _linked(sets, sets, percent)
            label = np.arange(len(doc))
            while True:
                lower = np.where(link, label[None, :], len(doc)).min(axis=1)
                if (lower == label).all():
                    break
                label = lower
            moved = np.flatnonzero(label != np.arange(len(doc)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(doc[moved]), pa.array(doc[label[moved]])], names=["u", "v"])

    return run


def _across(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["zone", "i", "j"]):
            doc, side, comp = (t.column(c).to_numpy() for c in ("doc_id", "side", "component"))
            sets = _read_sets(t)
            few, all_ = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            link = _linked([sets[k] for k in few], [sets[k] for k in all_], percent)
            r, c = np.nonzero(link & (comp[few][:, None] != comp[all_][None, :]))
            if len(r):
                _, first = np.unique(np.stack([comp[few[r]], comp[all_[c]]]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(doc[few[r[first]]]), pa.array(doc[all_[c[first]]])], names=["u", "v"])

    return run


def _with_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = pa.array([x.tobytes() for x in _sets(batch, width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("zone"), batch.column("chunks"), members], names=["doc_id", "zone", "chunks", "members"])

    return run


def _confirm(docs: DataFrame, zones: DataFrame, work: Workspace, width: int, percent: int) -> DataFrame:
    """Exact links (u, v) inside zones, enough of them to connect all that is linked."""
    n = zones.count()
    size = work.keep(zones.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "zone-size", rows=n)
    named = zones.join(size, "component").select(F.col("node").alias("doc_id"), F.col("component").alias("zone"), "chunks")
    sets = work.keep(docs.join(named, "doc_id").mapInArrow(_with_sets(width), "doc_id long, zone long, chunks int, members binary"), "zone-sets")
    wide = sets.where("chunks > 1")
    links = None
    for deal in range(DEALS):
        rows = (sets if deal == 0 else wide).withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(deal)), "chunks").cast("int"))
        found = rows.select("zone", "chunk", "doc_id", "members").repartition("zone", "chunk").sortWithinPartitions("zone", "chunk", "doc_id").mapInArrow(_within(percent), "u long, v long")
        found = work.keep(found, f"links-{deal}", rows=n, per_file=8 * CHUNK)
        links = found if links is None else links.unionByName(found)
        if deal == 0 and wide.isEmpty():
            return links
    joined = components(links, work, "dealt")
    rows = wide.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = work.keep(rows, "wide-rows")
    weight = rows.groupBy("zone", "component").agg(F.count("*").alias("n"))
    main = work.keep(weight.groupBy("zone").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.ceil((F.sum("n") - F.max("n")) / CHUNK).cast("int").alias("rest_chunks")).where("rest_chunks > 0"), "zone-main")
    rows = rows.join(main, "zone")
    deal_i = F.pmod(F.xxhash64("doc_id", F.lit(101)), "rest_chunks").cast("int")
    deal_j = F.pmod(F.xxhash64("doc_id", F.lit(102)), "chunks").cast("int")
    few = rows.where("component <> main").select("zone", deal_i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.lit(0).alias("side"), "doc_id", "component", "members")
    every = rows.select("zone", F.explode(F.sequence(F.lit(0), F.col("rest_chunks") - 1)).alias("i"), deal_j.alias("j"), F.lit(1).alias("side"), "doc_id", "component", "members")
    cells = few.unionByName(every).repartition("zone", "i", "j").sortWithinPartitions("zone", "i", "j", "side", "doc_id")
    return links.unionByName(work.keep(cells.mapInArrow(_across(percent), "u long, v long"), "links-rest"))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id: one row per input row.

    ``width``-word shingles, linked where 100 * |A and B| >= percent * |A or B|;
    ``component_id`` is the least id reachable over links, ``kept`` says that it
    is the row's own id, ``class_id`` is the least id with an equal shingle set.
    Texts without words (null, empty, blank) have no shingles and no links.
    Fewer words than ``width`` form one shingle. Rows that repeat an id share its
    links; a null id gets a null component and stays. Ids may be of any type that
    orders: those that are no whole numbers are numbered by a 64-bit hash inside, and
    the least of a component is found among the ids themselves. Other columns are
    ignored. Candidate search is tuned for percent >= 80.
    """
    work = Workspace(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(base.schema["doc_id"].dataType, IntegralType):
        return _numbered(base.withColumn("doc_id", F.col("doc_id").cast("long")), work, width, percent)
    number = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    out = work.keep(_numbered(base.select(number.alias("doc_id"), "text"), work, width, percent), "by-number")
    names = work.keep(base.where("doc_id is not null").select(number.alias("number"), F.col("doc_id").alias("name")).distinct(), "names")
    own = out.join(names.hint("merge"), F.col("doc_id") == F.col("number"), "left")
    least = lambda c, to: own.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("name").alias(to))
    named = own.join(least("component_id", "component").hint("merge"), "component_id", "left").join(least("class_id", "class").hint("merge"), "class_id", "left")
    kept = F.coalesce(F.col("name") == F.col("component"), F.lit(True)).alias("kept")
    return named.select(F.col("name").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept, F.col("class").alias("class_id"))


def _numbered(base: DataFrame, work: Workspace, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, text) with long ids."""
    prints = work.keep(base.mapInArrow(_fingerprints(width), "doc_id long, n_shingles long, d1 long, d2 long, signature binary"), "prints")
    usable = prints.where("n_shingles > 0 and doc_id is not null")
    classes = work.keep(usable.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes", rows=prints.count())
    named = usable.select("doc_id", "signature").join(classes.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi")
    forest = named.mapInArrow(_forest, "region long, rest long, doc_id long, low long, high long")
    parts = max(1, min(MOST_PARTS, ORDERS * classes.count() // PART_ROWS))
    nearby = forest.repartitionByRange(parts, "region", "rest", "doc_id").sortWithinPartitions("region", "rest", "doc_id").mapInArrow(_neighbours, "u long, v long")
    candidates = work.keep(nearby.distinct(), "candidates")
    zones = components(candidates, work, "zones")
    links = _confirm(base, zones, work, width, percent)
    final = components(links, work, "final")
    known = classes.join(final.withColumnRenamed("node", "class_id"), "class_id", "left").where("n > 1 or component is not null")
    known = work.keep(known.select("d1", "d2", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component")), "known", rows=classes.count())
    out = prints.select("doc_id", "n_shingles", "d1", "d2").join(known, ["d1", "d2", "n_shingles"], "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
