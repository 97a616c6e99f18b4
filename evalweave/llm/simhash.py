"""Near duplicates by SimHash, compared in bit slices.

A document's 128-bit SimHash is the majority, bit by bit, over the hashes of
its distinct words. Equal fingerprints fall together first. Distinct ones meet
in the buckets of hash tables keyed by random choices of bits; the number of
tables follows from the bits a key has, so that a pair at RADIUS bits meets with
probability RECALL (closer pairs more surely), at every size. Keys have as many
bits as leave about BUCKET fingerprints to a bucket, where comparing a
fingerprint with its bucket costs about as much as sending it there.
Inside a bucket nothing is skipped: fingerprints are turned into bit planes, 64
of them to a word, and carry-save adders count differing bits of 64 pairs at a
time; blocks in which every pair is beyond the radius are abandoned. Groups are
the connected components of pairs within the radius.

Cases: null, empty and blank texts have no fingerprint and no near duplicates;
equal texts are near duplicates. ``drop_near`` decides by row: of a group's rows
the one with the lowest doc_id stays (a null doc_id is above all others; rows of
one doc_id go by their texts' hashes; of rows that repeat both, one stays), so a
doc_id that comes with several texts loses only those that are near others.
``find_near`` names documents: one that repeats its own doc_id isn't its own
duplicate, one without a doc_id comes with a null, and a group without any
doc_id has no row. doc_id may be of any type that can be ordered (integers come
back as long); an empty table gives an empty result; further columns pass
through ``drop_near`` whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import fresh, materialise, quoted, read, remove, sized, written
from .kernels import give_back, mix, slices, words

NBITS = 128
RADIUS = 24
REFERENCE_DISTANCE = RADIUS
RECALL = 0.92
#: Fingerprints that a bucket holds on the average, at most.
BUCKET = 512
#: Buckets of more fingerprints than this are searched breadth first, leaving out pairs that are already connected.
ALL_PAIRS = 8 * BUCKET

_ONES = ~np.uint64(0)
_SPREAD = np.zeros(256, dtype=np.uint64)
for _i in range(8):
    _SPREAD |= ((np.arange(256, dtype=np.uint64) >> np.uint64(7 - _i)) & np.uint64(1)) << np.uint64(8 * _i)


def fingerprints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the two halves of its SimHash (uint64, n x 2), and whether it has any word."""
    n = len(column)
    out, has = np.zeros((n, 2), dtype=np.uint64), np.zeros(n, dtype=bool)
    for s in slices(column):
        w = words(s)
        if not len(w.hash):
            continue
        # Distinct words of each row: sorted by row and hash.
        row = w.row
        order = np.lexsort((w.hash, row))
        h, row = w.hash[order], row[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        at = np.searchsorted(row, np.arange(s.rows + 1))
        size = np.diff(at)
        full = np.flatnonzero(size)
        # Runs of up to 255 words, so that eight counters of a byte each share one word of 64 bits.
        cut = np.unique(np.concatenate([at[full]] + [np.arange(at[r], at[r + 1], 255) for r in full[size[full] > 255]]))
        run_row = row[cut]
        first = np.searchsorted(run_row, full)
        majority = np.zeros((len(full), NBITS), dtype=np.uint8)
        for half, x in enumerate((h, mix(h ^ np.uint64(0x5851F42D4C957F2D)))):
            by = x.view(np.uint8).reshape(-1, 8)
            for b in range(8):
                lanes = np.add.reduceat(_SPREAD[by[:, b]], cut)
                counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int32), first, axis=0)
                at_bit = half * 64 + b * 8
                majority[:, at_bit : at_bit + 8] = counts * 2 > size[full, None]
        packed = np.packbits(majority, axis=1).view(np.uint64).reshape(-1, 2)
        out[s.first + full] = packed
        has[s.first + full] = True
    return out, has


def key_bits(n: int) -> int:
    """Bits of a table's key for n fingerprints: buckets keep their size as n grows."""
    return min(48, max(0, math.ceil(math.log2(max(n, 2) / BUCKET))))


def tables_for(bits: int) -> int:
    """Tables in which a pair at the reference distance meets with probability RECALL."""
    meet = math.prod((NBITS - REFERENCE_DISTANCE - i) / (NBITS - i) for i in range(bits))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - meet)) if bits else 1


def _choices(bits: int) -> np.ndarray:
    rng = np.random.default_rng(20)
    return np.array([rng.choice(NBITS, bits, replace=False) for _ in range(tables_for(bits))])


def _unpack(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), 16), axis=1)


def planes_of(bits: np.ndarray) -> np.ndarray:
    """n x NBITS bits as NBITS x ceil(n / 64) words: bit l of word j of a plane belongs to row 64 j + l."""
    blocks = (len(bits) + 63) // 64
    wide = np.zeros((blocks * 64, NBITS), dtype=np.uint8)
    wide[: len(bits)] = bits
    packed = np.packbits(wide.reshape(blocks, 64, NBITS), axis=1, bitorder="little")
    return np.ascontiguousarray(packed.transpose(2, 0, 1)).view(np.uint64).reshape(NBITS, blocks)


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _beyond(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter (lowest plane first) exceeds radius."""
    gt, eq = np.zeros_like(counter[0]), np.full_like(counter[0], _ONES)
    for i in range(len(counter) - 1, -1, -1):
        if not (radius >> i) & 1:
            gt |= eq & counter[i]
            eq &= ~counter[i]
        else:
            eq &= counter[i]
    return gt


def within(planes: np.ndarray, block: np.ndarray, query: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compares query bits (P x NBITS) with the 64 lanes of planes[:, block]: indices into P, and the lanes, of pairs within radius.

    valid: the lanes of each of the P comparisons that count.
    """
    where = np.arange(len(block))
    zero = np.zeros(len(block), dtype=np.uint64)
    counter = [zero.copy() for _ in range(8)]
    for base in range(0, NBITS, 16):
        part = query[where, base : base + 16].T.astype(np.uint64)
        d = planes[base : base + 16][:, block[where]] ^ (np.uint64(0) - part)
        one, two, four, eight = counter[:4]
        eights = []
        for h in (0, 8):
            fours = []
            for q in (0, 4):
                one, a = _full_add(one, d[h + q], d[h + q + 1])
                one, b = _full_add(one, d[h + q + 2], d[h + q + 3])
                two, f = _full_add(two, a, b)
                fours.append(f)
            four, e = _full_add(four, *fours)
            eights.append(e)
        eight, carry = _full_add(eight, *eights)
        counter[:4] = one, two, four, eight
        for i in range(4, 8):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        if base + 16 > radius:
            alive = ~_beyond(counter, radius) & valid[where]
            keep = np.flatnonzero(alive)
            if len(keep) < len(where):
                where = where[keep]
                counter = [c[keep] for c in counter]
            if not len(where):
                return where, where
    alive = ~_beyond(counter, radius) & valid[where]
    lanes = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    p, lane = np.nonzero(lanes)
    return where[p], lane


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _links_all(bits: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Component links (member, least member) of many small buckets at once; bucket k is rows start[k] : start[k] + size[k]."""
    blocks = (size + 63) // 64
    head = np.concatenate([[0], np.cumsum(blocks)])
    n = int(size.sum())
    bucket = np.repeat(np.arange(len(size)), size)
    local = np.arange(n) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    rows = np.repeat(start, size) + local
    slot = head[bucket] * 64 + local
    wide = np.zeros((head[-1] * 64, NBITS), dtype=np.uint8)
    wide[slot] = bits[rows]
    planes = planes_of(wide)
    filled = np.zeros(head[-1] * 64, dtype=np.uint8)
    filled[slot] = 1
    lanes = np.packbits(filled.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).reshape(-1)
    row_of = np.zeros(head[-1] * 64, dtype=np.int64)
    row_of[slot] = np.arange(n)
    # Every row against its own block and the later ones of its bucket.
    own = local // 64
    many = blocks[bucket] - own
    q = np.repeat(np.arange(n), many)
    block = head[bucket[q]] + own[q] + (np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many))
    valid = lanes[block].copy()
    mine = block == head[bucket[q]] + own[q]
    # In a row's own block only the lanes after it.
    shift = (local[q[mine]] % 64).astype(np.uint64)
    valid[mine] &= (_ONES << shift) << np.uint64(1)
    some = np.flatnonzero(valid)
    q, block, valid = q[some], block[some], valid[some]
    # Pairs become links to the least member as they come, so a bucket of like fingerprints doesn't hold its square.
    label = np.arange(n)
    member = np.zeros(0, np.int64)
    for lo in range(0, len(q), 1 << 15):
        part = slice(lo, lo + (1 << 15))
        p, lane = within(planes, block[part], bits[rows[q[part]]], valid[part], radius)
        if len(p):
            label = _components(n, np.concatenate([member, q[part][p]]), np.concatenate([label[member], row_of[block[part][p] * 64 + lane]]))
            member = np.flatnonzero(label != np.arange(n))
    return rows[member], rows[label[member]]


def _links_search(bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one large bucket: breadth-first search, in which a row meets only rows not yet reached."""
    n = len(bits)
    label = np.full(n, -1)
    left = np.arange(n)
    planes, members = planes_of(bits), left
    alive = np.ones(n, dtype=bool)
    for seed in range(n):
        if not alive[seed]:
            continue
        alive[seed] = False
        label[seed] = seed
        queue = [seed]
        while queue:
            now, queue = queue[:32], queue[32:]
            if alive[members].sum() * 2 < len(members):
                members = members[alive[members]]
                planes = planes_of(bits[members])
            if not len(members):
                break
            lanes = np.zeros(planes.shape[1] * 64, dtype=np.uint8)
            lanes[: len(members)] = alive[members]
            lanes = np.packbits(lanes.reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).reshape(-1)
            live = np.flatnonzero(lanes)
            if not len(live):
                break
            for row in now:
                where, lane = within(planes, live, np.broadcast_to(bits[row], (len(live), NBITS)), lanes[live], radius)
                found = members[live[where] * 64 + lane]
                found = found[alive[found]]
                alive[found] = False
                label[found] = seed
                queue.extend(found.tolist())
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _pairs_in_buckets(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def links(key: np.ndarray, fp: np.ndarray, ident: np.ndarray) -> Iterator[pa.RecordBatch]:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([first, [len(key)]]))
            small = (size > 1) & (size <= ALL_PAIRS)
            out = []
            if small.any():
                take = np.flatnonzero(np.repeat(small, size))
                bits = _unpack(fp[take])
                start = np.concatenate([[0], np.cumsum(size[small])[:-1]])
                m, root = _links_all(bits, start, size[small], radius)
                out.append((ident[take[m]], ident[take[root]]))
            for k in np.flatnonzero(size > ALL_PAIRS):
                span = slice(first[k], first[k] + size[k])
                m, root = _links_search(_unpack(fp[span]), radius)
                out.append((ident[span][m], ident[span][root]))
            for a, b in out:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Works on all whole buckets that are held; the last one may go on in the next batch."""
            nonlocal held
            if not held:
                return
            key, hi, lo, ident = (np.concatenate(x) for x in zip(*held, strict=True))
            end = len(key)
            if not last:
                end = int(np.searchsorted(key, key[-1]))
            if end:
                yield from links(key[:end], np.stack([hi[:end], lo[:end]], axis=1), ident[:end])
            held = [[key[end:], hi[end:], lo[end:], ident[end:]]] if end < len(key) else []

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(0).to_numpy()] + [batch.column(i).to_numpy().view(np.uint64) for i in (1, 2)] + [batch.column(3).to_numpy()])
                if sum(len(x[0]) for x in held) >= 20_000:
                    yield from flush(False)
        yield from flush(True)
        give_back()

    return run


def _bucket_rows(bits: int):
    choice = _choices(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hi, lo, ident = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            n = len(hi)
            if not n:
                continue
            b = _unpack(np.stack([hi, lo], axis=1).view(np.uint64)).astype(np.int64)
            keys = np.zeros((len(choice), n), dtype=np.int64)
            for t, c in enumerate(choice):
                for i in c:
                    keys[t] = (keys[t] << 1) | b[:, i]
                keys[t] |= t << bits
            for t in range(len(choice)):
                yield pa.RecordBatch.from_arrays([pa.array(keys[t]), batch.column(0), batch.column(1), ident], names=["key", "hi", "lo", "ident"])

    return run


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp, has = fingerprints(batch.column(2))
        at = np.flatnonzero(has)
        take = pa.array(at)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(fp[at, 0].view(np.int64)), pa.array(fp[at, 1].view(np.int64))], names=["doc_id", "th", "hi", "lo"])
    give_back()


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b) with a > b that isn't its component's least one; large and small stars by turns."""
    edges, _, path = written(links.distinct())
    before = None
    while True:
        tally = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tally == before or not tally["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tally
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = Window.partitionBy("a")
        least = F.least(F.min("b").over(around), F.col("a"))
        large = both.select(F.col("b").alias("a"), least.alias("b"), F.col("a").alias("u")).where("a > u and a > b").select("a", "b").distinct()
        lowest = large.select("a", F.col("b").alias("v"), F.min("b").over(around).alias("m"))
        small = lowest.select("a", F.col("m").alias("b")).unionByName(lowest.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))).distinct()
        edges, _, newer = written(small)
        remove(links.sparkSession, path)
        path = newer


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, th (the text's hash), keep: for each row with a fingerprint the struct (unnamed, doc_id, th) of the row that stays of its group."""
    doc_id = F.col("doc_id").cast("long") if isinstance(docs.schema["doc_id"].dataType, IntegralType) else F.col("doc_id")
    texts = docs.where("text is not null").select(doc_id.alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    prints, _ = materialise(texts.mapInArrow(_print_rows, f"doc_id {kind}, th long, hi long, lo long"))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "th")
    distinct, _ = materialise(prints.groupBy("hi", "lo").agg(F.min(row).alias("least")).withColumn("ident", F.monotonically_increasing_id()))
    bits = key_bits(distinct.count())
    rows = distinct.select("hi", "lo", "ident").mapInArrow(_bucket_rows(bits), "key long, hi long, lo long, ident long")
    links = rows.repartition("key").sortWithinPartitions("key", "ident").mapInArrow(_pairs_in_buckets(radius), "a long, b long")
    roots = components(links)
    nodes = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    members = distinct.join(nodes, F.col("ident") == F.col("node")).select("hi", "lo", "root", F.min("least").over(Window.partitionBy("root")).alias("group"))
    linked, size = materialise(members.select(F.col("hi").alias("g_hi"), F.col("lo").alias("g_lo"), "group"))
    own = F.min(row).over(Window.partitionBy("hi", "lo"))
    whole = prints.withColumn("own", own).join(sized(linked, size), (F.col("hi") == F.col("g_hi")) & (F.col("lo") == F.col("g_lo")), "left")
    return whole.select("doc_id", "th", F.coalesce("group", "own").alias("keep"))


def find_near(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, keep_id: a row for each document that has a near duplicate of lower doc_id in its group; keep_id is the group's lowest."""
    other = _grouped(docs, radius).select("doc_id", F.col("keep.doc_id").alias("keep_id")).where("keep_id is not null and not (doc_id <=> keep_id)")
    return other.distinct()


def drop_near(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of near duplicates; rows without a fingerprint stay."""
    rank, th, key, gone, gone_th = (fresh(docs.columns, n) for n in ("rank", "th", "key", "gone", "gone_th"))
    grouped = _grouped(docs, radius)
    pairs = grouped.groupBy("doc_id", "th").agg(F.min(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("th") == F.col("keep.th")))).alias("goes"), F.count(F.lit(1)).alias("n"))
    # Rows that repeat doc_id and text are few: one of each such set stays, if any.
    told, size = materialise(pairs.where("goes or n > 1").select(F.col("doc_id").alias(gone), F.col("th").alias(gone_th), "goes"))
    doc_id = docs["doc_id"].cast(told.schema[gone].dataType)
    marked = docs.withColumns({key: doc_id, th: F.xxhash64("text")})
    here = F.col(key).eqNullSafe(F.col(gone)) & (F.col(th) == F.col(gone_th)) & F.col("text").isNotNull()
    once = marked.join(sized(told.drop("goes"), size), here, "left_anti")
    more = marked.join(sized(told.where("not goes").drop("goes"), size), here, "left_semi")
    more = more.withColumn(rank, F.row_number().over(Window.partitionBy(key, th).orderBy(F.lit(1)))).where(F.col(rank) == 1).drop(rank)
    return once.unionByName(more).select(*[quoted(c) for c in docs.columns])


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_near(read(spark, sf_dir, "documents"))
