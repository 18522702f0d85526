"""N-gram Jaccard join (10): blocked sparse product of documents by n-gram incidence.

The columns of the incidence matrix (64-bit hashes of word shingles) are dealt
into blocks, and a pair is discarded as soon as a size-derived bound rules it
out:

* Two sets of at most s elements with Jaccard similarity t or more differ in
  at most ``2 s (1 - t) / (1 + t)`` columns.  With one block more than that, a
  linked pair has a block whose columns are equal; with spare blocks beyond
  that it has so many equal blocks more.  Sizes fall into classes a factor 1/t
  apart, so linked documents share a class label and its blocks.
* Columns that very many documents have (passages that go round) are left out
  of the blocks: linked sets differ in no more columns without them, so the
  bound holds, and a passage alone makes no candidates.  How common a column is
  comes from a sketch of all documents, of a fixed size; it decides only what
  is compared with what, never what is linked.
* Each document sends one hash per filled block.  Documents that share none
  can't be linked: they are discarded before any product.  A block that is
  empty in both says little, but a document with no more empty blocks than
  there are spare ones has a filled block in common with every document it is
  linked with.  One with more (short texts, or mostly common columns) also sends
  its prefix, the rarest columns, of which any linked pair shares one.  So a
  document of n shingles sends O(n) hashes.
* Documents that share a block hash form candidate groups (connected by stars,
  so a group of m sends m links, not m * m).  Within a group the product is
  accumulated exactly, one document against all that are not settled yet, and
  stops once all unsettled documents are in one component: pairs inside a
  component need no product.

Equal sets are collapsed first; a group too large for one task is multiplied
in rounds over all tasks, a bounded block of its documents at a time.

Defined cases: a text without words is empty and linked with nothing; a null
id keeps its set size and gets a null component; rows that repeat an id are
one vertex; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .._fs import scratch_dir
from .graph import components
from .kernels import U, VISIBLE, Words, as_bytes, mix, per_text, pieces
from .registry import read, register

#: Shingles of a candidate group that one task multiplies alone; larger groups go round by round.
GROUP_SHINGLES = 2_000_000
#: Documents of one large group that a round multiplies with the whole group, and the shingles that end a round sooner.
ROUND, ROUND_SHINGLES = 4096, 1_000_000
#: Slices of a large group among which the documents of a round are chosen.
SALTS = 32
#: Parts in which block hashes meet, at least.  A pair is linked once in every part where it shares a hash, so small tables get
#: as many parts as large ones: links then follow the documents, not the shuffle partitions.
PARTS = 256
#: Two-byte counters of the frequency sketch, as a power of two, and the ranges in which tasks' sketches are summed.
SKETCH_BITS, RANGES = 23, 64


class Threshold:
    """Link when q * intersection >= p * union; everything below is exact integer arithmetic."""

    def __init__(self, p: int = 90, q: int = 100):
        self.p, self.q = p, q
        self.bounds = [1]
        # Spare blocks, in thousandths of the set size: twice the blocks that stay empty in the class's smallest sets.
        d, t = 2 * (q - p) / (q + p), p / q
        self.spare = next((x for x in range(5, 305, 5) if x >= 2 * (1000 * d + x) * np.exp(-t / (d + x / 1000))), 0)

    def grow(self, n: int) -> np.ndarray:
        """Class starts b0 < b1 < ... beyond n and two more; linked sizes lie in the same or the next class."""
        while len(self.bounds) < 4 or self.bounds[-4] <= n:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, (b - 1) * self.q // self.p + 1))
        return np.array(self.bounds)

    def blocks(self, largest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(blocks, spare ones): two linked sets of at most ``largest`` elements share at least one more than the spare ones."""
        differ = 2 * largest * (self.q - self.p) // (self.q + self.p)
        spare = np.where(differ > 0, largest * self.spare // 1000, 0)
        return differ + 1 + spare, spare

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-n * self.p // self.q) + 1

    def linked(self, both, n, m):
        return self.q * both >= self.p * (n + m - both)


def shingle_sets(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(columns, first): the sorted distinct shingle hashes of text i are columns[first[i]:first[i+1]]."""
    w = Words(texts, VISIBLE)
    at, h = w.grams(k)
    own = w.owner()[at]
    for n in range(1, k):  # fewer words: the whole sequence is one shingle
        short = np.flatnonzero(w.count == n)
        if len(short):
            a, g = w.grams(n)
            starts = np.searchsorted(a, w.first[short])
            h, own = np.concatenate([h, g[starts]]), np.concatenate([own, short])
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    h, own = h[new], own[new]
    return h, np.searchsorted(own, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of uint64 values by group, exact through 32-bit halves."""
    low = np.bincount(groups, weights=(values & U(0xFFFFFFFF)).astype(np.float64), minlength=n)
    high = np.bincount(groups, weights=(values >> U(32)).astype(np.float64), minlength=n)
    return low.astype(np.int64).astype(U) + (high.astype(np.int64).astype(U) << U(32))


class Frequencies:
    """How many documents have a column, by hash bucket; counters stop at 65 535."""

    def __init__(self, counts: np.ndarray):
        self.counts, mean = counts, float(counts.mean())
        # Above what chance puts into a bucket.
        self.common = mean + 6 * np.sqrt(mean) + 8

    def of(self, h: np.ndarray) -> np.ndarray:
        return self.counts[h >> U(64 - SKETCH_BITS)]


def column_frequencies(docs: DataFrame, text_col: str, k: int) -> np.ndarray:
    """The counters of ``Frequencies`` over all documents: each task sends its own, compressed, and ranges are summed as they come."""
    def count(batches):
        seen, c = np.zeros(1 << SKETCH_BITS, np.uint16), zstandard.ZstdCompressor(level=1)
        for b in batches:
            texts = as_bytes(b.column(0))
            for lo, hi in pieces(texts):
                at, n = np.unique(shingle_sets(texts[lo:hi], k)[0] >> U(64 - SKETCH_BITS), return_counts=True)
                seen[at] = np.minimum(seen[at] + n, 65535)
        parts = [(i, c.compress(x.tobytes())) for i, x in enumerate(np.split(seen, RANGES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([z for _, z in parts], pa.binary())],
                                         ["part", "z"])

    def add(batches):
        total, c = {}, zstandard.ZstdCompressor(level=1)
        for b in batches:
            for i, z in zip(b.column(0).to_pylist(), _unpack(b.column(1))):
                x = np.frombuffer(z, np.uint16)
                total[i] = np.minimum(total.get(i, np.uint32(0)) + x.astype(np.uint32), 65535).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()),
                                          pa.array([c.compress(x.tobytes()) for x in total.values()], pa.binary())], ["part", "z"])

    sent = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "part int, z binary")
    out = np.zeros((RANGES, (1 << SKETCH_BITS) // RANGES), np.uint16)
    for part, z in sent.repartition(RANGES, "part").mapInArrow(add, "part int, z binary").collect():  # 16 MB at most
        out[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(z)), np.uint16)
    return out.reshape(-1)


def block_hashes(h: np.ndarray, first: np.ndarray, t: Threshold, known: Frequencies) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every filled block of both class labels, and of the prefix where empty blocks outnumber the spare ones."""
    n = np.diff(first)
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, U)
    bounds = t.grow(int(n.max()))
    own, kind = np.repeat(np.arange(len(n)), n), np.searchsorted(bounds, n, side="right") - 1
    out_i, out_h = [], []
    spread, weight = mix(h ^ U(0x5851F42D4C957F2D)), mix(h + U(0x14057B7EF767814F))
    often = known.of(h)
    rare, rarest = often <= known.common, h[np.lexsort((h, often, own))]
    for label in (kind, kind + 1):
        k, spare = t.blocks(bounds[label + 1] - 1)
        k = np.where(n > 0, k, 0)
        k[k == 1] = 0  # linked means equal: the set key has them
        base = np.concatenate([[0], np.cumsum(k)])
        total = int(base[-1])
        if not total:
            continue
        sel = (k[own] > 0) & rare
        g = base[own[sel]] + (spread[sel] % k[own[sel]].astype(U)).astype(np.int64)
        filled, sums = np.bincount(g, minlength=total) > 0, _sums(weight[sel], g, total)
        who = np.repeat(np.arange(len(n)), k)
        name = label[who].astype(U) * U(0x2545F4914F6CDD1D) + (np.arange(total) - base[who]).astype(U) * U(0x9E6C63D0876A9A47)
        out_i.append(who[filled])
        out_h.append(mix(sums + name)[filled])
        bare = np.flatnonzero(np.bincount(who[~filled], minlength=len(n)) > spare)
        if len(bare):
            size = t.prefix(n)[bare]
            each = np.repeat(bare, size)
            rank = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            out_i.append(each)
            out_h.append(mix(mix(rarest[first[each] + rank] ^ U(0xD1342543DE82EF95)) + label[each].astype(U) * U(0x2545F4914F6CDD1D)))
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, U)
    return np.concatenate(out_i), np.concatenate(out_h)


def _sets_of(texts: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of many texts, a piece at a time."""
    cols, sizes = [np.empty(0, U)], [np.zeros(1, np.int64)]
    for lo, hi in pieces(texts):
        h, first = shingle_sets(texts[lo:hi], k)
        cols.append(h)
        sizes.append(np.diff(first))
    return np.concatenate(cols), np.cumsum(np.concatenate(sizes))


def _group_components(columns: np.ndarray, first: np.ndarray, t: Threshold) -> np.ndarray:
    """Component label of each set of one group.

    One set at a time is multiplied with the unsettled sets whose sizes allow a
    link, and is settled then.  The next one is taken from outside the component
    that has most unsettled sets; the group is done when only that one has any."""
    size = np.diff(first)
    order = np.argsort(size, kind="stable")
    n, label = size[order], np.arange(len(size))
    names, ids = np.unique(columns, return_inverse=True)
    ids = ids[np.repeat(first[order] - (np.cumsum(n) - n), n) + np.arange(len(ids))]
    begin = np.concatenate([[0], np.cumsum(n)])
    left, left_ids, left_begin, since = np.arange(len(n)), ids, begin, 0
    open_ = np.ones(len(n), dtype=bool)
    while True:
        labels, todo = np.unique(label[open_], return_counts=True)
        if len(labels) < 2:
            break
        x = int(np.argmax(open_ & (label != labels[np.argmax(todo)])))
        lo = np.searchsorted(n[left], -(-n[x] * t.p // t.q), side="left")
        hi = np.searchsorted(n[left], n[x] * t.q // t.p, side="right")
        flag = np.zeros(len(names), dtype=np.int32)
        flag[ids[begin[x]:begin[x + 1]]] = 1
        a, z = left_begin[lo], left_begin[hi]
        both = per_text(flag[left_ids[a:z]], left_begin[lo:hi + 1] - a)
        hit = left[lo:hi][t.linked(both, n[x], n[left[lo:hi]])]
        if len(hit) > 1:
            label[np.isin(label, label[hit])] = label[hit].min()
        open_[x], since = False, since + 1
        if 2 * since > len(left):
            keep = open_[left]
            left_ids = left_ids[np.repeat(keep, n[left])]
            left, since = left[keep], 0
            left_begin = np.concatenate([[0], np.cumsum(n[left])])
    out = np.empty(len(n), np.int64)
    out[order] = label
    return out


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))


def set_keys(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, k1, k2): the set size and a 128-bit key of the set."""
    def keys(batches):
        for b in batches:
            texts, cols = as_bytes(b.column(1)), [[], [], []]
            for lo, hi in pieces(texts):
                h, first = shingle_sets(texts[lo:hi], k)
                own, m = np.repeat(np.arange(hi - lo), np.diff(first)), hi - lo
                cols[0].append(np.diff(first))
                cols[1].append(_sums(mix(h + U(0x632BE59BD9B4E019)), own, m).view(np.int64))
                cols[2].append(_sums(mix(h ^ U(0x8CB92BA72F3D8DD7)), own, m).view(np.int64))
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in flat]], ["id", "n", "k1", "k2"])
    return _plain(docs, id_col, text_col).mapInArrow(keys, "id bigint, n bigint, k1 bigint, k2 bigint")


def spanned(links: np.ndarray) -> np.ndarray:
    """One link from the smallest id of every connected component of ``links`` to each other one: n - 1 links tie n ids."""
    ids, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    label = np.arange(len(ids))
    while (label[a] != label[b]).any():
        low, last = np.minimum(label[a], label[b]), label
        label = label.copy()
        np.minimum.at(label, last[a], low)
        np.minimum.at(label, last[b], low)
        while (label[label] != label).any():
            label = label[label]
    rest = np.flatnonzero(label != np.arange(len(ids)))
    return np.stack([ids[label[rest]], ids[rest]], axis=1)


def candidate_links(docs: DataFrame, id_col: str, text_col: str, k: int, t: Threshold, parts: int) -> DataFrame:
    """(a, b): links that connect the documents that share a block hash, directly or over others.

    A batch sends its block hashes as sorted arrays, one row per part; equal
    hashes within a batch become a local star and travel once.  Only what is
    connected counts, so a part keeps one star a component: documents that
    share many hashes with ever other ones would else make links with the
    square of their number."""
    shift = U(40)
    counters = docs.sparkSession.sparkContext.broadcast(column_frequencies(docs, text_col, k))

    def send(batches):
        known = Frequencies(counters.value)
        for b in batches:
            ids_all, texts = b.column(0).to_numpy(zero_copy_only=False), as_bytes(b.column(1))
            for lo, hi in pieces(texts, 1 << 22):
                h, first = shingle_sets(texts[lo:hi], k)
                who, code = block_hashes(h, first, t, known)
                ids = ids_all[lo:hi].astype(np.int64)[who]
                part = (code >> shift) % U(parts)
                order = np.lexsort((ids, code, part))
                code, ids, part = code[order], ids[order], part[order].astype(np.int64)
                head = np.ones(len(code), dtype=bool)
                head[1:] = code[1:] != code[:-1]
                lead = np.flatnonzero(head)
                star = ids[lead][np.cumsum(head) - 1]
                local = spanned(np.stack([star[~head], ids[~head]], axis=1))
                ends = np.flatnonzero(np.diff(part[lead], append=-1)) + 1
                rows, at = [], 0
                for e in ends if len(lead) else ():
                    s = lead[at:e]
                    rows.append((int(part[s[0]]), code[s].tobytes(), ids[s].tobytes()))
                    at = e
                if len(local):
                    rows.append((int(local[0, 0]) % parts, b"", local.astype(np.int64).tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                     pa.array([r[2] for r in rows], pa.binary())], ["part", "codes", "ids"])

    def meet(table):
        codes, ids, links = [], [], [np.empty((0, 2), np.int64)]
        for c, i in zip(table.column("codes").to_pylist(), table.column("ids").to_pylist()):
            if c:
                codes.append(np.frombuffer(c, U))
                ids.append(np.frombuffer(i, np.int64))
            else:
                links.append(np.frombuffer(i, np.int64).reshape(-1, 2))
        if codes:
            code, own = np.concatenate(codes), np.concatenate(ids)
            order = np.lexsort((own, code))
            code, own = code[order], own[order]
            head = np.ones(len(code), dtype=bool)
            head[1:] = code[1:] != code[:-1]
            star = own[np.flatnonzero(head)][np.cumsum(head) - 1]
            links.append(np.stack([star[~head], own[~head]], axis=1))
        e = spanned(np.concatenate(links))
        return pa.table({"a": pa.array(e[:, 0], pa.int64()), "b": pa.array(e[:, 1], pa.int64())})

    sent = _plain(docs.filter(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(send, "part int, codes binary, ids binary")
    return sent.groupBy("part").applyInArrow(meet, "a bigint, b bigint").distinct()


def _packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, z): texts compressed, so that fetching candidates moves few bytes."""
    def pack(batches):
        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress(x) for x in as_bytes(b.column(1))], pa.binary())],
                                             ["id", "z"])
    return _plain(docs, id_col, text_col).mapInArrow(pack, "id bigint, z binary")


def _unpack(column) -> list:
    d = zstandard.ZstdDecompressor()
    return [d.decompress(x) for x in column.to_pylist()]


def _stacked(column) -> tuple[np.ndarray, np.ndarray]:
    """(columns, first) of sets that arrive as bytes."""
    sets = [np.frombuffer(x, U) for x in column.to_pylist()]
    return np.concatenate(sets), np.cumsum([0] + [len(x) for x in sets])


def _small_groups(members: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(v, root) of the groups that one task can multiply."""
    def multiply(table):
        ids = table.column("id").to_numpy()
        label = _group_components(*_sets_of(_unpack(table.column("z")), k), t)
        root = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(root, label, ids)
        return pa.table({"v": pa.array(ids, pa.int64()), "root": pa.array(root[label], pa.int64())})
    return members.groupBy("gid").applyInArrow(multiply, "v bigint, root bigint")


def _large_groups(members: DataFrame, k: int, t: Threshold, store: str, block: int) -> DataFrame:
    """(v, root) of the groups beyond one task: a bounded block of each against the whole group, round by round.

    A round takes unsettled documents outside the component that has most of
    them; a group is finished when all unsettled documents are in one component."""
    spark = members.sparkSession

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store}/{name}")

    def to_sets(batches):
        for b in batches:
            out = []
            for z in b.column("z").to_pylist():
                out.append(_sets_of(_unpack(pa.array([z])), k)[0].tobytes())
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("salts"), b.column("id"), pa.array(out, pa.binary())],
                                             ["gid", "salts", "id", "h"])

    def products(mine, lead):
        links = np.empty((0, 2), np.int64)
        if mine.num_rows and lead.num_rows:
            (h, first), (g, begin) = _stacked(mine.column("h")), _stacked(lead.column("h"))
            names, g = np.unique(g, return_inverse=True)
            at = np.searchsorted(names, h)
            at[at == len(names)] = 0
            own = np.repeat(np.arange(len(first) - 1), np.diff(first))[names[at] == h]
            at, n, found = at[names[at] == h], np.diff(first), []
            first = np.searchsorted(own, np.arange(len(n) + 1))
            roots = mine.column("root").to_numpy()
            for i, root in enumerate(lead.column("root").to_pylist()):
                flag = np.zeros(len(names), dtype=np.int32)
                flag[g[begin[i]:begin[i + 1]]] = 1
                hit = t.linked(per_text(flag[at], first), begin[i + 1] - begin[i], n) & (roots != root)
                found.append(np.stack([roots[hit], np.full(int(hit.sum()), root)], axis=1))
            links = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(links[:, 0], pa.int64()), "b": pa.array(links[:, 1], pa.int64())})

    sets = keep(members.mapInArrow(to_sets, "gid bigint, salts int, id bigint, h binary"), "sets")
    state = sets.groupBy("gid", "id").agg(F.sum(F.length("h") / 8).cast("bigint").alias("size"))
    state = keep(state.select("gid", "id", F.col("id").alias("root"), F.lit(False).alias("settled"), "size"), "state0")
    rounds = 0
    while True:
        todo = state.filter(~F.col("settled")).groupBy("gid", "root").agg(F.count("*").alias("n"))
        per = todo.groupBy("gid").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("n", "root")).alias("most")).filter("roots > 1")
        # Salted by id before the cut, so that no task ranks a whole group.
        waiting = state.filter(~F.col("settled")).join(per, "gid").filter(F.col("root") != F.col("most"))
        salted = Window.partitionBy("gid", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(F.xxhash64("id"), "id")
        waiting = waiting.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= block)
        ranked = Window.partitionBy("gid").orderBy("r", "id")
        before = F.coalesce(F.sum("size").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        waiting = waiting.withColumn("before", before).withColumn("r", F.row_number().over(ranked))
        lead = keep(waiting.filter((F.col("r") <= block) & (F.col("before") < ROUND_SHINGLES)).select("gid", "id", "root"),
                    f"lead{rounds}")
        if lead.isEmpty():
            return state.select(F.col("id").alias("v"), "root")
        # A group's rows are dealt to as many salts as its size asks for; each meets the round's bounded block.
        salts = sets.select("gid", "salts").distinct()
        packed = keep(lead.join(sets.drop("salts"), ["gid", "id"]).join(salts, "gid")
                      .select("gid", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "root", "h"), f"block{rounds}")
        each = (state.join(sets, ["gid", "id"])
                .select("gid", F.pmod(F.xxhash64("id"), "salts").cast("int").alias("salt"), "root", "h"))
        links = each.groupBy("gid", "salt").cogroup(packed.groupBy("gid", "salt")).applyInArrow(products, "a bigint, b bigint")
        links = keep(links.distinct(), f"links{rounds}")
        rounds += 1
        merged = components(links, store, f"round{rounds}").toDF("root", "new")
        done = lead.select("gid", "id", F.lit(True).alias("now"))
        state = keep(state.join(merged, "root", "left").join(done, ["gid", "id"], "left")
                     .select("gid", "id", F.coalesce("new", "root").alias("root"),
                             (F.col("settled") | F.col("now").isNotNull()).alias("settled"), "size"), f"state{rounds}")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, p: int = 90, q: int = 100,
                       group_shingles: int = GROUP_SHINGLES, block: int = ROUND) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    spark, t = docs.sparkSession, Threshold(p, q)
    store = scratch_dir(spark, "jaccard")
    parts = max(PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{store}/{name}")
        return spark.read.schema(df.schema).parquet(f"{store}/{name}")

    rows = keep(set_keys(docs, id_col, text_col, k), "rows")
    known = rows.filter("id is not null and n > 0")
    classes = known.groupBy("n", "k1", "k2").agg(F.min("id").alias("rep"))
    reps = keep(known.join(classes, ["n", "k1", "k2"]).select("id", "rep", "n"), "reps")
    links = candidate_links(docs, id_col, text_col, k, t, parts)
    one, two = reps.select(F.col("id").alias("a"), F.col("rep").alias("x")), reps.select(F.col("id").alias("b"), F.col("rep").alias("y"))
    links = keep(links.join(one, "a").join(two, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
                 .distinct(), "links")
    groups = components(links, store, "groups").toDF("id", "gid")
    groups = keep(groups.join(reps.filter("id = rep").select("id", "n").distinct(), "id"), "members")
    weight = groups.groupBy("gid").agg(F.ceil(F.sum("n") / F.lit(group_shingles)).cast("int").alias("salts"))
    groups = keep(groups.join(weight, "gid").select("id", "gid", "salts", (F.col("salts") > 1).alias("large")), "groups")
    texts = keep(_packed(docs, id_col, text_col).join(groups.hint("merge"), "id"), "texts")
    found = _small_groups(texts.filter("not large").select("gid", "id", "z"), k, t)
    if not groups.filter("large").isEmpty():
        found = found.unionByName(_large_groups(texts.filter("large").select("gid", "salts", "id", "z"), k, t, store, block))
    same = found.groupBy("v").agg(F.min("root").alias("root"))
    # Ids that several rows share can tie classes together: one more pass over (id, class) links.
    tie = reps.groupBy("id").agg(F.count_distinct("rep").alias("c")).filter("c > 1")
    if not tie.isEmpty():
        extra = reps.select(F.col("id").alias("a"), F.col("rep").alias("b")).unionByName(same.toDF("a", "b"))
        same = components(extra, store, "ties").toDF("v", "root")
    roots = keep(reps.select("id", "rep").distinct().join(same, F.col("rep") == F.col("v"), "left")
                 .groupBy("id").agg(F.min(F.coalesce("root", "rep")).alias("root")), "roots")
    return (rows.join(roots, "id", "left")
            .select("id", F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents whose id is their component's smallest (and those without an id), with the columns of ``docs``."""
    got = jaccard_components(docs, id_col, text_col, **options)
    drop = got.filter(F.col("id") != F.col("component_id")).select(F.col("id").alias("__id")).distinct()
    return docs.join(drop, F.col(id_col) == F.col("__id"), "left_anti")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * i >= 90 * (na.n + nb.n - i)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM (SELECT v AS doc_id, min(c) AS c FROM r GROUP BY v) LEFT JOIN n USING (doc_id)
"""


@register("op10_ngram_jaccard", SQL)
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
