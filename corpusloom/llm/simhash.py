"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has 64 bits; bit b is set if it is set in more than half of the
XXH64 values of the text's word shingles. With a budget of t differing bits and
m segments on a ring, two fingerprints within t have a segment from which every
chain of l consecutive segments differs in at most l * t / m bits. For t < m the
first segment of that chain must agree, so (position, value) of a segment is the
join key; the chain test then prunes pairs before the whole Hamming distance.

Only distinct fingerprints are compared. A key that more than ``block``
fingerprints share is dealt out as pairs of blocks, so no task holds a hot key,
and within a task links already connected aren't emitted again: what leaves it
is a forest with the same components, never all pairs of a group.

A null or wordless text has fingerprint 0, linked like any other. Repeated rows
share a fingerprint. Fewer words than a shingle: the whole word sequence is the
one shingle. Long texts are read whole; memory is bounded by the longest. A bit set
in exactly half of the shingles is 0; a component is named by its smallest id. Rows
with a null id keep a row in ``near_duplicates``; they name their group only if no
other id does. An empty table gives an empty result; other columns, whatever their
names, are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import common
from corpusloom.llm.components import components

BLOCK = 4096
#: Texts are near copies from this Jaccard similarity of their shingle sets on, as a fraction.
ALIKE = (4, 5)
#: Classes, and shingles of theirs, that are compared as one block.
TOGETHER, SHINGLES = 512, 1 << 20
WIDE = ["w0", "w1", "w2", "w3"]
#: Bands of least hashes, and hashes a band: at a similarity of 0.8 all bands differ in 3 of 100,000 pairs.
BANDS, DEEP = 20, 4
_ODD = common.mixed(np.arange(1, BANDS * DEEP + 1, dtype=np.uint64)) | common.U(1)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_SALTS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]


def _majority(digests: np.ndarray) -> int:
    """digests: rows of 8 big-endian bytes."""
    if len(digests) == 0:
        return 0
    counts = np.concatenate([np.bincount(digests[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big")


def _digests(words: list[bytes], size: int) -> np.ndarray:
    if not words:
        return np.zeros((0, 8), dtype=np.uint8)
    hashed = xxhash.xxh64_digest
    if size == 1:
        parts = [hashed(w, 42) for w in words]
    elif len(words) <= size:
        parts = [hashed(b" ".join(words), 42)]
    else:
        parts = [hashed(b" ".join(s), 42) for s in zip(*(words[k:] for k in range(size)), strict=False)]
    return np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, 8)


def fingerprint(text: str, size: int = 3) -> int:
    """The unsigned fingerprint of a text over shingles of ``size`` words, A-Z lower-cased."""
    return _majority(_digests(text.encode().lower().split(), size))


def wide_fingerprint(text: str, size: int = 5) -> list[int]:
    """256 bits: the fingerprint and three more, of the shingle hashes mixed with fixed salts."""
    d = _digests(text.encode().lower().split(), size)
    h = d.copy().view(">u8").astype(np.uint64).ravel()
    return [_majority(d)] + [_majority(common.mixed(h ^ common.U(s)).astype(">u8").view(np.uint8).reshape(-1, 8)) for s in _SALTS]


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: ``doc_id`` and ``fp`` (signed)."""
    kept = common.text_of(docs, docs[id_col].cast("long").alias("doc_id"), text_col=text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, size) for t in b.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return common.map_rows(kept, run, "doc_id long, fp long")


def shingle_set(text: str, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(_digests(text.encode().lower().split(), words).copy().view(">u8").astype(np.uint64).ravel())


def bands(shingles: np.ndarray) -> np.ndarray:
    """A hash of each band's least shingle hashes: a share J ** DEEP of the bands agrees between sets of Jaccard similarity J."""
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (_ODD[:, None] * shingles[None, at : at + 1024]).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, DEEP).T:
        out = common.mixed(out ^ column)
    return out


def _sketches(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs: ``doc_id``, ``body`` (hash of the text), ``node`` (hash of its shingle set), ``size`` of the set, ``fp`` over single words, w0..w3 over shingles and ``bands``."""
    kept = common.text_of(docs, docs[id_col].cast("long").alias("doc_id"), _body(docs, text_col), text_col=text_col)
    names = ["node", "size", "fp", *WIDE]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, least = [], []
        for t in b.column("text").to_pylist():
            shingles = shingle_set(t, words)
            least.append(bands(shingles).view(np.int64))
            rows.append((xxhash.xxh64_intdigest(shingles.tobytes()), len(shingles), fingerprint(t, 1), *wide_fingerprint(t, words)))
        table = np.array(rows, dtype=np.uint64).reshape(-1, len(names)).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body"), *(pa.array(np.ascontiguousarray(c)) for c in table.T), pa.array(least, pa.list_(pa.int64()))], ["doc_id", "body", *names, "bands"])

    return common.map_rows(kept, run, "doc_id long, body long, " + ", ".join(f"{n} long" for n in names) + ", bands array<long>")


def _body(docs: DataFrame, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))).alias("body")


class _Forest:
    """Union-find whose finished roots are looked up as an array."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flatten(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                break
            p = q
        self.parent = p
        return p

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """a, b: few enough after the joined ones have been dropped."""
        p = self.parent
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            while p[x] != x:
                x = p[x]
            while p[y] != y:
                y = p[y]
            if x != y:
                p[max(x, y)] = min(x, y)
        self.flatten()


def _masks(bits: int, most: int) -> list[int]:
    """All values of ``bits`` bits with at most ``most`` of them set."""
    return [0, *(sum(1 << b for b in c) for n in range(1, most + 1) for c in itertools.combinations(range(bits), n))]


def _links(key: np.ndarray, start: np.ndarray, fp: np.ndarray, wide: np.ndarray | None, budget: int, segments: int, wide_budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges among rows of equal key, as row numbers (wide) or fingerprints.

    The chain of two says how far the second segments of a pair may differ, so each row only meets the rows of its key
    whose second segment is within that distance of its own; chains of three and more prune those further.
    """
    nodes, local = np.unique(fp, return_inverse=True)
    if wide is not None:  # rows of one class recur under other keys
        _, nodes, local = np.unique(np.column_stack([fp.view(np.int64), wide.view(np.int64)]), axis=0, return_index=True, return_inverse=True)
    local = local.ravel()
    forest = _Forest(len(nodes))
    edges = np.append(segment_edges(segments), 64)
    size = np.diff(edges)
    turn = edges[start].astype(np.uint64)
    ring = np.where(turn > 0, (fp << turn) | (fp >> ((common.U(64) - turn) & common.U(63))), fp)  # the chain's first segment comes first
    second = size[(start + 1) % segments]
    code = (key << 32) | ((ring << size[start].astype(np.uint64)) >> (64 - second).astype(np.uint64)).astype(np.int64)
    order = np.argsort(code, kind="stable")
    code, local, ring, start, second = code[order], local[order], ring[order], start[order], second[order]
    wide = wide[order] if wide is not None else None
    codes, first, count = np.unique(code, return_index=True, return_counts=True)
    # bits in chains of l segments, by their first
    spans = np.array([[size[(s + np.arange(n)) % segments].sum() for n in range(segments + 1)] for s in range(segments)])
    for mask in _masks(int(size.max()), 2 * budget // segments):
        if mask:  # each pair once: from the row whose lowest differing bit is 0
            rows = np.flatnonzero((code & (mask & -mask) == 0) & (mask >> second == 0))
            at = np.searchsorted(codes, code[rows] ^ mask)
            hit = codes[np.minimum(at, len(codes) - 1)] == code[rows] ^ mask
            rows, at = rows[hit], at[hit]
            to, end = first[at], first[at] + count[at]
        else:
            rows = np.arange(len(code))
            at = np.searchsorted(codes, code)
            to, end = rows + 1, first[at] + count[at]
        while len(rows):
            more = to < end
            rows, to, end = rows[more], to[more], end[more]
            a, b = local[rows], local[to]
            open_ = forest.parent[a] != forest.parent[b]
            r, t, a, b = rows[open_], to[open_], a[open_], b[open_]
            x = ring[r] ^ ring[t]
            for length in range(3, segments + 1):
                ok = np.bitwise_count(x >> (64 - spans[start[r], length]).astype(np.uint64)) <= length * budget // segments
                r, t, a, b, x = r[ok], t[ok], a[ok], b[ok], x[ok]
                if not len(r):
                    break
            if len(r) and wide is not None:
                ok = np.bitwise_count(wide[r] ^ wide[t]).sum(axis=1) <= wide_budget
                a, b = a[ok], b[ok]
            if len(r) and len(a):
                forest.join(a, b)
            to = to + 1
    roots = forest.flatten()
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return nodes[moved], nodes[roots[moved]]


def segment_edges(segments: int) -> np.ndarray:
    """The first bit, from the high end, of each segment."""
    return np.array([64 * k // segments for k in range(segments)], dtype=np.int64)


def linked(distinct: DataFrame, budget: int, segments: int, wide_budget: int | None = None, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between node ids of a table (node, fp[, w0..w3]) of distinct fingerprints, enough for their components."""
    if budget >= segments:
        raise ValueError("the first segment of a chain agrees only if there are more segments than differing bits")
    spark = distinct.sparkSession
    edges = [*segment_edges(segments).tolist(), 64]
    value = lambda k: F.expr(f"shiftrightunsigned(shiftleft(fp, {edges[k]}), {64 - (edges[k + 1] - edges[k])})")
    wide = WIDE if wide_budget is not None else []
    keyed = distinct.select("node", "fp", *wide, F.explode(F.array(*[F.struct(F.lit(k).alias("start"), value(k).alias("value")) for k in range(segments)])).alias("s")).select("node", "fp", *wide, "s.start", "s.value")
    # At most segments * 2 ** (64 / segments) keys exist, and only those of over ``block`` rows are kept: the size is bounded.
    hot = keyed.groupBy("start", "value").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    dealt = keyed.join(F.broadcast(hot), ["start", "value"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("rows") / block), F.lit(1)).cast("int"))
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    grouped = dealt.select("start", "value", "low", "high", "node", "fp", *wide).repartition(parts, "start", "value", "low", "high").sortWithinPartitions("start", "value", "low", "high", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        names = ["start", "value", "low", "high", "node", "fp", *wide]

        def work(t: np.ndarray) -> pa.RecordBatch:
            change = np.any(t[1:, :4] != t[:-1, :4], axis=1)
            key = np.concatenate(([0], np.cumsum(change)))
            u, v = _links(key, t[:, 0], t[:, 5].view(np.uint64), np.ascontiguousarray(t[:, 6:]).view(np.uint64) if wide else None, budget, segments, wide_budget or 0)
            if wide:  # rows, not fingerprints
                u, v = t[u, 4], t[v, 4]
            else:
                u, v = u.view(np.int64), v.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for b in batches:
            held.append(np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in names]))
            if sum(map(len, held)) >= 100_000:
                t = np.concatenate(held)
                cut = np.flatnonzero(np.any(t[1:, :4] != t[:-1, :4], axis=1))
                cut = int(cut[-1]) + 1 if len(cut) else 0
                if cut:
                    yield work(t[:cut])
                held = [t[cut:]]
        if held and sum(map(len, held)):
            yield work(np.concatenate(held))

    return grouped.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 3, budget: int = 3, segments: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row of docs: ``doc_id``, ``fp`` (signed) and ``component_id``, the smallest id reachable over links of at most ``budget`` differing bits."""
    prints = common.written(fingerprints(docs, size, id_col, text_col), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked(classes.select(F.col("fp").alias("node"), "fp"), budget, segments, block=block))
    placed = common.written(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = common.written(_placed(placed, named, "root").select("fp", "component_id"), "classes")
    return _placed(prints, by_print, "fp").select("doc_id", "fp", "component_id")


def _placed(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """Rows with what their class is given; all the copies of a text needn't meet in one task."""
    hot = common.hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), [key], "n", rows.count())
    return common.spread_join(rows, classes, [key], hot)


def _alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges among sets, as their positions, with the components of all pairs of Jaccard similarity ``ALIKE`` or more."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    flat, start = flat.ravel(), np.concatenate(([0], np.cumsum(size)))
    forest, marked = _Forest(len(sets)), np.zeros(len(values), dtype=bool)
    top, bottom = ALIKE
    for i in range(len(sets) - 1):
        p = forest.parent
        open_ = p[i + 1 :] != p[i]
        open_ &= bottom * np.minimum(size[i], size[i + 1 :]) >= top * np.maximum(size[i], size[i + 1 :])
        if not open_.any():
            continue
        mine = flat[start[i] : start[i + 1]]
        marked[mine] = True
        rows = np.flatnonzero(open_) + i + 1
        if len(rows) < 32:
            both = np.array([np.count_nonzero(marked[flat[start[r] : start[r + 1]]]) for r in rows])
        else:
            both = np.bincount(owner[start[i + 1] :], weights=marked[flat[start[i + 1] :]], minlength=len(sets))[rows].astype(np.int64)
        marked[mine] = False
        to = rows[bottom * both >= top * (size[i] + size[rows] - both)]
        if len(to):
            forest.join(np.full(len(to), i), to)
    roots = forest.flatten()
    moved = np.flatnonzero(roots != np.arange(len(roots)))
    return moved, roots[moved]


def confirmed(docs: DataFrame, classes: DataFrame, members: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (u, v) between the classes (node, least, body, size) that share a key of members (key, node) and whose shingle sets have a Jaccard similarity of ``ALIKE`` or more, enough for their components.

    The sets are made anew from one text a class, only of classes that are members. Keys with the same classes are
    settled once; a key of more than ``TOGETHER`` classes, or ``SHINGLES`` of their shingles, is dealt out as pairs of blocks.
    """
    members = common.written(members.join(classes.select("node", "size"), "node").select("key", "node", "size"), "members")
    keys = members.groupBy("key").agg(F.count("*").alias("rows"), F.sum("size").alias("sizes"), F.bit_xor(F.xxhash64("node")).alias("who")).where("rows > 1")
    keys = keys.groupBy("rows", "sizes", "who").agg(F.min("key").alias("key"))
    keys = keys.select("key", F.greatest(F.ceil(F.col("rows") / TOGETHER), F.ceil(F.col("sizes") / SHINGLES)).cast("int").alias("blocks"))
    met = common.written(members.join(keys, "key").select("key", "node", "blocks"), "met")
    wanted = met.select("node").distinct().join(classes, "node").select("node", "least", F.col("body").alias("of"))
    texts = common.text_of(docs, docs[id_col].cast("long").alias("doc_id"), _body(docs, text_col), text_col=text_col)
    texts = texts.join(wanted, (F.col("body") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least"))).dropDuplicates(["node"]).select("node", "text")

    def shingled(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t, words).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["node", "shingles"])

    sets = common.written(common.map_rows(texts, shingled, "node long, shingles binary"), "shingles")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int")
    dealt = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node")
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["key", "low", "high"]
    grouped = dealt.join(sets, "node").select(*order, "node", "shingles").repartition(parts, *order).sortWithinPartitions(*order, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, held = None, [], []

        def work() -> pa.RecordBatch:
            u, v = _alike(held) if len(held) > 1 else (np.zeros(0, dtype=np.int64),) * 2
            at = np.array(nodes, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(at[u]), pa.array(at[v])], ["u", "v"])

        for b in batches:
            for *group, node, shingles in zip(*(b.column(n).to_pylist() for n in order), b.column("node").to_pylist(), b.column("shingles"), strict=True):
                if group != now:
                    if nodes:
                        yield work()
                    now, nodes, held = group, [], []
                nodes.append(node)
                held.append(np.frombuffer(shingles.as_py(), dtype=np.uint64))
        if nodes:
            yield work()

    return grouped.mapInArrow(run, "u long, v long")


def near_duplicate_groups(docs: DataFrame, words: int = 5, budget: int = 5, segments: int = 6, wide_budget: int = 50, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Groups of similar texts for filtering: ``doc_id``, ``component_id`` and ``component_body`` per row of docs, the last two being the id (nulls last) and text hash of the group's first document.

    Texts are linked whose sets of shingles of ``words`` words have a Jaccard
    similarity of ``ALIKE`` or more, counted exactly. Candidates are texts that
    agree in one of their ``BANDS``, which also finds cut-off and added blocks,
    and texts whose fingerprints over single words (with repeats) differ in at
    most ``budget`` bits, found by the pigeonring, and whose 256-bit fingerprints
    over shingles differ in at most ``wide_budget`` bits.
    """
    prints = common.written(_sketches(docs, words, id_col, text_col), "prints")
    shape = ["fp", *WIDE]
    classes = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("least"), "body")).alias("first"), F.first("size").alias("size"), F.min(F.struct(*shape)).alias("shape"), F.first("bands").alias("bands"))
    classes = common.written(classes.select("node", "first.least", "first.body", "size", "shape.*", "bands"), "classes")
    pairs = linked(classes.select("node", *shape), budget, segments, wide_budget, block).distinct()
    members = classes.where("size > 0").select(F.explode("bands").alias("key"), "node").union(pairs.select(F.xxhash64("u", "v").alias("key"), F.explode(F.array("u", "v")).alias("node")))
    roots = components(confirmed(docs, classes, members, words, id_col, text_col))
    placed = common.written(classes.select("node", "least", "body").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    named = placed.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), F.col("least").alias("component_id"), F.col("body").alias("component_body"))).alias("first")).select("root", "first.component_id", "first.component_body")
    by_node = common.written(_placed(placed, named, "root").select("node", "component_id", "component_body"), "placed")
    return _placed(prints, by_node, "node").select("doc_id", "component_id", "component_body")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the rows of docs whose id and text name a group, a row and its repetitions once. A row with a null id stays only where its group has no other id.

    Ids and text hashes decide; only rows that a bitmap of the doubtful ones (not the first of their group, or repeated) may mean are shuffled.
    """
    names = groups.select("component_id", "component_body").distinct()
    plain, name = common.numbered(docs)
    id_col, text_col = name[id_col], name[text_col]
    keyed = plain.select(plain[id_col].cast("long").alias("id"), _body(plain, text_col), *plain.columns)
    keyed = keyed.withColumn("slot", common.slot(F.col("id").isNull(), F.coalesce("id", F.lit(0)), "body"))
    same = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("body") == F.col("component_body"))
    counted = keyed.groupBy("id", "body", "slot").agg(F.count("*").alias("rows")).join(names.withColumn("named", F.lit(True)), same, "left")
    keyed = common.marked(keyed, common.written(counted.where("rows > 1 OR named IS NULL").select("slot").distinct(), "doubtful"), "slot", "doubtful")
    order = Window.partitionBy("id", "body").orderBy(F.xxhash64(*[c for c in plain.columns if c != text_col]))
    checked = keyed.where("doubtful").join(names, same, "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
    return keyed.where("NOT doubtful").select(*plain.columns).union(checked.select(*plain.columns)).toDF(*docs.columns)
