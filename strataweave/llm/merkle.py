"""Document fingerprints: a Merkle tree over sections, paragraphs and short pieces.

Sections end at blank lines, paragraphs at line ends, pieces at sentence ends or
after ``PIECE`` characters. The pieces of a text join to the text itself, so equal
roots mean equal texts; below a differing root, differing branches locate edits.
A fingerprint is ``root|section;section;...``, a section ``hash:paragraph,...``,
a paragraph its pieces' codes of ``CODE`` hex digits, one after another.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .workspace import Workspace

PIECE = 32
#: Hex digits of a piece's code in a fingerprint. Different pieces share a code once in 16 million, so likeness counts
#: about n * m / 16 million pairs too many for texts of n and m pieces; roots, which test equality, have 128 bits.
CODE = 6
MOST_PARTS = 8192
_SECTION = re.compile(r"(?<=\n)(?:[ \t\r]*\n)+")
_PIECES = re.compile(rf"[^.!?\n]{{1,{PIECE}}}[.!?]*[ \t\r]*\n?|[.!?]+[ \t\r]*\n?|\n")


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def fingerprint(text: str | None) -> str:
    """The serialised tree of a text; null counts as empty."""
    text = text or ""
    cuts = [0, *[m.end() for m in _SECTION.finditer(text)]]
    if cuts[-1] != len(text) or len(cuts) == 1:
        cuts.append(len(text))
    roots, sections = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        lines, line = [], []
        digests, whole = [], []
        for piece in _PIECES.findall(text[a:b]):
            d = _hash(piece.encode("utf-8", "surrogatepass"))
            line.append(d)
            if piece[-1] == "\n":
                lines.append(line)
                line = []
        if line:
            lines.append(line)
        for pieces in lines:
            digests.append(_hash(b"p" + b"".join(pieces)))
            whole.append("".join([d[: CODE // 2].hex() for d in pieces]))
        root = _hash(b"s" + b"".join(digests))
        roots.append(root)
        sections.append(f"{root[: CODE // 2].hex()}:{','.join(whole)}")
    return f"{_hash(b'r' + b''.join(roots)).hex()}|{';'.join(sections)}"


def _codes(print_: str) -> Counter:
    found: list[str] = []
    for section in print_.partition("|")[2].split(";"):
        for line in section.partition(":")[2].split(","):
            found.extend([line[i : i + CODE] for i in range(0, len(line), CODE)])
    return Counter(found)


def likeness(a: str, b: str) -> float:
    """Jaccard likeness of the trees' pieces as multisets; 1 exactly if the roots are equal."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return 1.0
    x, y = _codes(a), _codes(b)
    if len(x) > len(y):
        x, y = y, x
    both = sum([min(n, y[k]) for k, n in x.items() if k in y])
    return min(both / max(1, x.total() + y.total() - both), 1 - 1e-9)


def edited_branches(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) positions at which two trees differ; equal branches are skipped whole."""
    if a.partition("|")[0] == b.partition("|")[0]:
        return []
    out = []
    left, right = (x.partition("|")[2].split(";") for x in (a, b))
    for s in range(max(len(left), len(right))):
        p, q = (x[s] if s < len(x) else ":" for x in (left, right))
        if p == q:
            continue
        p, q = (x.partition(":")[2].split(",") for x in (p, q))
        out += [(s, i) for i in range(max(len(p), len(q))) if (p[i] if i < len(p) else None) != (q[i] if i < len(q) else None)]
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n] if n else text


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: str, following: str, next_print: str) -> tuple:
    changed = edited(text, following)
    print_ = own if changed == text else fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own, print_, likeness(own, print_), likeness(own, next_print)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_COLUMNS)


def _alike(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
    return low


#: Of a fingerprint: its root and the bar.
_ROOT = 33


def _thin(row: tuple) -> tuple[tuple, int]:
    """A finished row whose edited fingerprint leaves out what it shares with the own one behind the roots."""
    own, changed = row[3], row[4]
    same = _alike(own[_ROOT:], changed[_ROOT:])
    return (*row[:4], changed[:_ROOT] + changed[_ROOT + same :], *row[5:]), same


def _part_batch(kind: int, rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """Rows (doc_id, text) at an end of this task's range."""
    ids, texts = zip(*rows, strict=True)
    body = _batch([], id_type).schema
    columns = [pa.array([TaskContext.get().partitionId()] * len(rows), pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array(texts, pa.string()), pa.array(ids, id_type)]
    empty = [pa.nulls(len(rows), f.type) for f in body if f.name != "doc_id"]
    return pa.RecordBatch.from_arrays([*columns, *empty], names=["part", "kind", "text", *_COLUMNS])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as deflated bytes: the one shuffle of all texts moves less than half of them."""
    for batch in batches:
        packed = [zlib.compress((x.as_py() or "").encode("utf-8", "surrogatepass"), 1) for x in batch.column("text")]
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(packed, pa.binary())], names=[*rest.schema.names, "packed"])


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range partition in order: all but the last meet their next one here (kind 0; part: what ``_thin`` left out).

    The partition's first row (kind 1) and its last (kind 2) leave as they are, to meet those of other partitions.
    """
    held = id_type = None
    for whole in batches:
        id_type = whole.column("doc_id").type
        for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
            rows = []
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                text = zlib.decompress(packed).decode("utf-8", "surrogatepass")
                own = fingerprint(text)
                if held:
                    rows.append(_row(*held, text, own))
                else:
                    yield _part_batch(1, [(doc_id, text)], id_type)
                held = doc_id, text, own
            thin = [_thin(r) for r in rows]
            done = _batch([r for r, _ in thin], id_type)
            front = [pa.array([same for _, same in thin], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.nulls(len(rows), pa.string())]
            yield pa.RecordBatch.from_arrays([*front, *done.columns], names=["part", "kind", "text", *_COLUMNS])
    if held:
        yield _part_batch(2, [held[:2]], id_type)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in (whole.slice(a, 64) for a in range(0, whole.num_rows, 64)):
            rows = []
            for doc_id, text, following in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True):
                text, following = text or "", following or ""
                rows.append(_row(doc_id, text, fingerprint(text), following, fingerprint(following)))
            yield _batch(rows, whole.column("doc_id").type)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: one row per input row.

    Rows are range-partitioned by id and meet their next row where they stand;
    only each partition's first and last row cross to another one, and which
    partition follows which is told by their numbers alone. Ranges are cut anew
    whenever a job runs, so one job writes both the finished rows and the ends,
    and everything later reads what it wrote. The row after
    the last is the first. Ids may be of any type that orders. Null text is empty; null ids come first; rows that
    repeat an id follow each other by a hash of their texts, and rows equal in
    both are alike, so they may be parted over tasks. Other columns are ignored,
    an empty table gives no rows, and a lone row follows itself.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    parts = min(MOST_PARTS, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = _SCHEMA.format(id=kind)
    packed = base.mapInArrow(_pack, f"doc_id {kind}, h long, row long, packed binary")
    ranged = packed.repartitionByRange(parts, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row").select("doc_id", "packed")
    walked = work.keep(ranged.mapInArrow(_along, f"part int, kind int, text string, {schema}"), "walked", compression="zstd")
    ends = work.keep(walked.where("kind > 0").select("part", "kind", "doc_id", "text"), "ends")
    # One number a partition: the next one that has rows, and after the last the first.
    order = W.orderBy("part")
    numbers = ends.where("kind = 1").select("part")
    turn = numbers.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("next_part"))
    first = ends.where("kind = 1").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    last = ends.where("kind = 2").join(turn, "part").join(first, "next_part").select("doc_id", "text", "next_text")
    whole = F.expr(f"concat(substring(edited_fingerprint, 1, {_ROOT}), substring(fingerprint, {_ROOT + 1}, part), substring(edited_fingerprint, {_ROOT + 1}))")
    inner = walked.where("kind = 0").withColumn("edited_fingerprint", whole).select(*_COLUMNS)
    return inner.unionByName(last.mapInArrow(_pairs, schema))
