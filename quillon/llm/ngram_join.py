"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word n-grams, ordered by how common they are in
the whole corpus, rarest first. With threshold t, two documents that agree
must share grams in their prefixes of n - ceil(t n) + l grams, at least l of
them. Each document lengthens its own prefix: it takes the l, of 1 to
`longest`, whose estimated cost (grams to ship, postings to scan, candidates
to verify) is least. For documents of p and q prefix grams out of n and m the
join then asks for

    t / (1 + t) (n + m) - max(n - p, m - q)

shared prefix grams before it looks at a pair; with equal l this is never less
than l, and for long documents much more, so hardly a pair is verified in vain.

How it runs:

1. one pass counts grams into a fixed-size sketch, which gives the order (any
   order gives the same result; a better one gives less work);
2. one pass emits prefixes, packed by target partition;
3. each posting list gives a star around its least document, so that a group
   of k copies costs k and not k * k; pairs with enough matches make groups;
4. posting lists that hold documents of several groups give all pairs across
   the groups, counted in full, so no pair can be missed;
5. inside a group, exact overlaps of all pairs come from products of 0/1
   matrices over blocks of documents.

`near_duplicate_classes` makes a row for each document of what it finds, its
class and its number of links, so that the result grows with the documents and
not with the pairs; `ngram_jaccard_join` gives the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._bitmap import has, sized
from quillon.llm._graph import components
from quillon.llm._text import ROWS, U64, Words, chunks, lean, mix, ranges, release, span_hash
from quillon.session import Scratch, partitions, ship

SLICES = 16
BLOCK_DOCS, BLOCK_GRAMS = 2048, 1 << 21
_LOW47 = U64((1 << 47) - 1)


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sizes): per text its distinct n-gram hashes of 47 bits, ascending, and how many.

    A text of fewer than n words has one gram, all its words; one without words has none.
    More than 65,536 texts at a time, which `chunks` never gives, are an error.
    """
    if len(column) > ROWS:
        raise ValueError(f"{len(column)} texts; the limit is {ROWS}")
    w = Words(column)
    per = np.where(w.counts > 0, np.maximum(w.counts - n + 1, 1), 0)
    starts = ranges(w.bounds[:-1], per)
    owner = np.repeat(np.arange(len(per)), per)
    grams = span_hash(w.hash, starts, np.minimum(starts + n, w.bounds[1:][owner]))
    keys = np.sort((owner.astype(U64) << U64(47)) | (grams >> U64(17)))
    if len(keys):
        keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    sizes = np.bincount((keys >> U64(47)).astype(np.int64), minlength=len(per))
    return keys & _LOW47, sizes


def sketch_slots(rows: int) -> int:
    """Four for each document, of 2^20 to 2^24; with more documents than that only common grams stand out."""
    return 1 << min(max((4 * rows - 1).bit_length(), 20), 24)


def _slots(grams: np.ndarray, slots: int) -> np.ndarray:
    return (grams & U64(slots - 1)).astype(np.int64)


def _ordered(grams: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The grams of each document, rarest first."""
    owner = np.repeat(np.arange(len(sizes)), sizes).astype(U64)
    level = np.minimum(np.log2(np.maximum(weight[_slots(grams, len(weight))], 1)) * 6, 255).astype(U64)
    order = np.argsort((owner << U64(47)) | (level << U64(39)) | (grams >> U64(8)), kind="stable")
    return grams[order]


def prefix_lengths(grams: np.ndarray, sizes: np.ndarray, df: np.ndarray, t: float, longest: int) -> np.ndarray:
    """Per document, the prefix length of least estimated cost; df: estimated postings of each ordered gram."""
    need = np.ceil(t * sizes - 1e-9).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    total = np.concatenate(([0.0], np.cumsum(df)))
    best = np.full(len(sizes), np.inf)
    out = np.zeros(len(sizes), dtype=np.int64)
    for more in range(1, longest + 1):
        p = np.where(sizes > 0, sizes - need + more, 0)
        ok = (more <= need) & (sizes > 0)
        p = np.minimum(p, sizes)
        scan = total[base + p] - total[base]
        cost = 4.0 * p + scan + 50.0 * (scan - p) / more
        better = ok & (cost < best)
        out[better], best[better] = p[better], cost[better]
    return out


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unplanes(b: memoryview, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, n).T).reshape(-1).view(kind)


def _sketcher(n: int, slots: int):
    def run(batches):
        total = np.zeros(slots, dtype=np.uint32)
        for b in batches:
            for i, k in chunks(b.column(0)):
                grams, _ = gram_sets(b.column(0).slice(i, k), n)
                at, count = np.unique(_slots(grams, slots), return_counts=True)
                total[at] += count.astype(np.uint32)
        each = slots // SLICES
        parts = [total[s * each : (s + 1) * each].astype("<u4").tobytes() for s in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], names=["slice", "counts"])

    return run


def _add_slices(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_buffer(), dtype="<u4").astype(np.float64) for x in table.column("counts"))
    return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.astype("<f4").tobytes()], pa.binary())})


def gram_sketch(docs: DataFrame, n: int, slots: int) -> np.ndarray:
    """Over all documents, how many hold the grams of each slot."""
    rows = docs.select("text").mapInArrow(lean(_sketcher(n, slots)), "slice int, counts binary").groupBy("slice").applyInArrow(_add_slices, "slice int, counts binary").collect()
    out = np.zeros(slots, dtype=np.float32)
    each = slots // SLICES
    for r in rows:
        out[r["slice"] * each : (r["slice"] + 1) * each] = np.frombuffer(r["counts"], dtype="<f4")
    return out


def _set_names(grams: np.ndarray, sizes: np.ndarray, salt: U64) -> np.ndarray:
    """A hash of each document's set."""
    cut = np.concatenate(([0], np.cumsum(sizes)))
    total = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix(grams ^ salt))))
    return total[cut[1:]] - total[cut[:-1]]


def _keys(ids: np.ndarray, grams: np.ndarray, sizes: np.ndarray, several: np.ndarray) -> np.ndarray:
    """What stands for each row until its pairs are known: its id or, where an id may have several texts, a hash of the id and the set."""
    held = mix(mix(ids.view(U64)) ^ _set_names(grams, sizes, U64(0x452821E638D01377))).view(np.int64)
    return np.where(has(several, ids), held, ids)


def _emitter(n: int, t: float, longest: int, parts: int, sketch, repeated):
    def run(batches):
        several = repeated.value
        weight = np.frombuffer(sketch.value, dtype=np.float32)
        noise = float(np.median(weight))
        for b in batches:
            b = b.filter(b.column(0).is_valid())
            for i, k in chunks(b.column(1)):
                ids = b.column(0).slice(i, k).to_numpy(zero_copy_only=False).astype(np.int64)
                grams, sizes = gram_sets(b.column(1).slice(i, k), n)
                ids = _keys(ids, grams, sizes, several)
                grams = _ordered(grams, sizes, weight)
                p = prefix_lengths(grams, sizes, np.maximum(weight[_slots(grams, len(weight))] - noise, 1.0), t, longest)
                at = ranges(np.concatenate(([0], np.cumsum(sizes)))[:-1], p)
                h = mix(grams[at])
                doc = np.repeat(ids, p)
                part = ((h >> U64(32)) % U64(parts)).astype(np.int64)
                order = np.argsort(part.astype(np.int16 if parts < 32768 else np.int32), kind="stable")
                tok, doc, cut = (h & U64(0xFFFFFFFF)).astype(np.uint32)[order], doc[order], np.searchsorted(part[order], np.arange(parts + 1))
                blobs, to = [], []
                for j in range(parts):
                    x, y = cut[j], cut[j + 1]
                    if y > x:
                        to.append(j)
                        blobs.append(_planes(tok[x:y]) + _planes(doc[x:y]))
                some = sizes > 0
                facts = np.concatenate((ids[some], sizes[some].astype(np.int64), p[some])).tobytes()
                to.append(int(mix(np.array([ids[0] if len(ids) else 0], dtype=np.int64).view(U64))[0] % U64(parts)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([False] * len(blobs) + [True], pa.bool_()), pa.array([*blobs, facts], pa.binary())], names=["part", "facts", "blob"])

    return run


_POSTED = "kind int, a long, b long, c long"


def _rows(kind: int, a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, dtype=np.int32)), pa.array(a), pa.array(b), pa.array(c)], names=["kind", "a", "b", "c"])


def _poster(batches):
    """kind 0: documents (id, size, prefix); 1: star pairs (a, b, matches); 2: postings (gram, document) of several documents."""
    tok, doc, part = [], [], 0
    for b in batches:
        for part, facts, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = memoryview(blob.as_buffer())
            if facts:
                a = np.frombuffer(raw, dtype=np.int64).reshape(3, -1)
                yield _rows(0, a[0], a[1], a[2])
            else:
                k = len(raw) // 12
                tok.append(_unplanes(raw[: 4 * k], np.uint32, k))
                doc.append(_unplanes(raw[4 * k :], np.int64, k))
    if not tok:
        return
    tok, doc = np.concatenate(tok), np.concatenate(doc)
    order = np.lexsort((doc, tok))
    tok, doc = tok[order], doc[order]
    keep = np.concatenate(([True], (tok[1:] != tok[:-1]) | (doc[1:] != doc[:-1])))
    tok, doc = tok[keep], doc[keep]
    first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
    count = np.diff(np.append(first, len(tok)))
    many = ranges(first[count > 1], count[count > 1])
    if not len(many):
        return
    head = np.repeat(doc[first[count > 1]], count[count > 1])
    tok, doc = tok[many].astype(np.int64) | np.int64(part << 32), doc[many]
    for i in range(0, len(tok), 1 << 18):
        yield _rows(2, tok[i : i + (1 << 18)], doc[i : i + (1 << 18)], np.zeros(len(tok[i : i + (1 << 18)]), dtype=np.int64))
    other = doc != head
    head, doc = head[other], doc[other]
    order = np.lexsort((doc, head))
    head, doc = head[order], doc[order]
    first = np.flatnonzero(np.concatenate(([True], (head[1:] != head[:-1]) | (doc[1:] != doc[:-1]))))
    yield _rows(1, head[first], doc[first], np.diff(np.append(first, len(head))))


def _enough(pairs: DataFrame, facts: DataFrame, t: float) -> DataFrame:
    """Of (a, b, c), those with as many matches as their sizes and prefixes ask for."""
    side = lambda s: facts.select(F.col("doc").alias(s), F.col("n").alias(f"n{s}"), F.col("p").alias(f"p{s}"))
    need = F.greatest(F.lit(1), F.ceil(F.lit(t / (1 + t)) * (F.col("na") + F.col("nb")) - 1e-9) - F.greatest(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")))
    return pairs.join(side("a"), "a").join(side("b"), "b").where((F.least("na", "nb") >= F.lit(t) * F.greatest("na", "nb") - 1e-9) & (F.col("c") >= need)).select("a", "b")


def _crossing(t: float):
    """(a, b, matches, matches needed) for documents of different groups in each posting list, of sizes that can agree.

    Rows are (tok, doc, comp, n, p); a partition holds whole lists.
    """

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        tok, doc, comp, n, p = (table.column(c).to_numpy() for c in ("tok", "doc", "comp", "n", "p"))
        order = np.lexsort((doc, comp, tok))
        tok, doc, comp, n, p = tok[order], doc[order], comp[order], n[order], p[order]
        first = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1])))
        end = np.append(first[1:], len(tok))
        group = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (comp[1:] != comp[:-1]))))
        stop = np.append(group[1:], len(tok))
        a_of = np.repeat(stop, stop - group)  # a row pairs with all rows of its list behind its own group
        list_end = np.repeat(end, end - first)
        many = list_end - a_of
        budget = np.cumsum(many)
        i = 0
        while i < len(tok):
            j = max(i + 1, int(np.searchsorted(budget, (budget[i - 1] if i else 0) + (1 << 20), side="right")))
            x, y = np.repeat(np.arange(i, j), many[i:j]), ranges(a_of[i:j], many[i:j])
            fit = np.minimum(n[x], n[y]) >= t * np.maximum(n[x], n[y]) - 1e-9
            x, y = x[fit], y[fit]
            swap = doc[x] > doc[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            order = np.lexsort((doc[y], doc[x]))
            x, y = x[order], y[order]
            if len(x):
                f = np.flatnonzero(np.concatenate(([True], (doc[x[1:]] != doc[x[:-1]]) | (doc[y[1:]] != doc[y[:-1]]))))
                u, v = x[f], y[f]
                need = np.ceil(t / (1 + t) * (n[u] + n[v]) - 1e-9).astype(np.int64) - np.maximum(n[u] - p[u], n[v] - p[v])
                yield pa.RecordBatch.from_arrays([pa.array(doc[u]), pa.array(doc[v]), pa.array(np.diff(np.append(f, len(x)))), pa.array(np.maximum(need, 1))], names=["a", "b", "c", "need"])
            i = j

    return run


def _setter(n: int, shared, repeated):
    """(doc, sig, key, n, k1, k2, grams) of the documents that may be in a group; k1 and k2 name the set."""

    def run(batches):
        bits, several = shared.value, repeated.value
        for b in batches:
            b = b.filter(b.column("doc").is_valid())
            ids = b.column("doc").to_numpy()
            b = b.filter(pa.array(has(bits, ids) | has(several, ids)))
            for i, k in chunks(b.column("text")):
                part = b.slice(i, k)
                grams, sizes = gram_sets(part.column("text"), n)
                cut = np.concatenate(([0], np.cumsum(sizes)))
                names = [pa.array(_set_names(grams, sizes, salt).view(np.int64)) for salt in (U64(0x243F6A8885A308D3), U64(0x13198A2E03707344))]
                keys = _keys(part.column("doc").to_numpy(), grams, sizes, several)
                flat = np.ascontiguousarray(grams.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                sets = pa.array([flat[6 * cut[r] : 6 * cut[r + 1]] for r in range(k)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("sig"), pa.array(keys), pa.array(sizes, pa.int64()), *names, sets], names=["doc", "sig", "key", "n", "k1", "k2", "grams"])

    return run


def _set_of(x: pa.Scalar) -> np.ndarray:
    raw = np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view(U64)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, from products of 0/1 matrices, 4,096 grams at a time."""
    same = left is right
    a = np.concatenate(left)
    b = a if same else np.concatenate(right)
    both = np.unique(a) if same else np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)

    def cells(x: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(both, x)
        hit = (at < len(both)) & (both[np.minimum(at, max(len(both) - 1, 0))] == x) if len(both) else np.zeros(len(x), dtype=bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit]
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[order]

    ca, ra = cells(a, left)
    cb, rb = (ca, ra) if same else cells(b, right)
    del a, b
    for lo in range(0, len(both), 4096):
        width = min(4096, len(both) - lo)
        mats = []
        for c, r, m in ((ca, ra, len(left)), (cb, rb, len(right)))[: 1 if same else 2]:
            x, y = np.searchsorted(c, (lo, lo + width))
            mat = np.zeros((m, width), dtype=np.float32)
            mat[r[x:y], c[x:y] - lo] = 1
            mats.append(mat)
        out += mats[0] @ mats[-1].T
    return out


def _block_pair(key: tuple[pa.Scalar, ...], table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(rows of the first block, of the second, sets of the table's rows, their sizes)."""
    sets = [_set_of(x) for x in table.column("grams")]
    block = table.column("block").to_numpy()
    return np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py()), sets, np.array([len(s) for s in sets], dtype=np.float64)


def _similar(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], size: np.ndarray, same: bool):
    """(first row, Jaccard similarities) of 256 rows of a block with all of another, in turn."""
    left = [sets[k] for k in x]
    shared = overlaps(left, left if same else [sets[k] for k in y])
    for lo in range(0, len(x), 256):
        part = shared[lo : lo + 256].astype(np.float64)
        yield lo, part / (size[x[lo : lo + 256]][:, None] + size[y][None, :] - part)


def _pairs(t: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y, sets, size = _block_pair(key, table)
        ids, same = table.column("doc").to_numpy(), key[1].equals(key[2])
        out_a, out_b, out_s = [], [], []
        if len(x) and len(y):
            for lo, jac in _similar(x, y, sets, size, same):
                r, c = np.nonzero(jac >= t - 1e-12)
                a, b = ids[x[lo + r]], ids[y[c]]
                keep = (a < b) if same else (a != b)
                out_a.append(np.minimum(a, b)[keep])
                out_b.append(np.maximum(a, b)[keep])
                out_s.append(jac[r, c][keep])
            if len(sets) > 256:
                del sets
                release()
        out_a, out_b, out_s = (np.concatenate([*v, np.zeros(0, dtype=k)]) for v, k in ((out_a, np.int64), (out_b, np.int64), (out_s, np.float64)))
        return pa.table({"doc_a": pa.array(out_a, pa.int64()), "doc_b": pa.array(out_b, pa.int64()), "jaccard": pa.array(out_s, pa.float64())})

    return run


def _links(t: float):
    """(head, other, links, best) of the sets of a block pair that have a similar one: the least name that is reached from it in the pair, how many documents it is linked to, and the best similarity."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y, sets, size = _block_pair(key, table)
        name, many, same = table.column("k1").to_numpy(), table.column("m").to_numpy(), key[1].equals(key[2])
        links, best, label = np.zeros(len(name), dtype=np.int64), np.zeros(len(name)), name.copy()
        if len(x) and len(y):
            hit = np.zeros((len(x), len(y)), dtype=bool)
            for lo, jac in _similar(x, y, sets, size, same):
                near = jac >= t - 1e-12
                if same:
                    near[np.arange(len(near)), lo + np.arange(len(near))] = False
                hit[lo : lo + 256] = near
                jac[~near] = 0
                rows = x[lo : lo + 256]
                links[rows] += near @ many[y]
                best[rows] = np.maximum(best[rows], jac.max(axis=1))
                if not same:
                    links[y] += many[rows] @ near
                    best[y] = np.maximum(best[y], jac.max(axis=0))
            _reach(hit, label, x, y)
            if len(sets) > 256:
                del sets, hit
                release()
        some = np.flatnonzero(links)
        return pa.table({"head": pa.array(name[some]), "other": pa.array(label[some]), "links": pa.array(links[some]), "best": pa.array(best[some])})

    return run


def _reach(hit: np.ndarray, label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Gives each row the least label that it is connected to by hits of rows x with rows y."""
    top = np.int64(2**63 - 1)
    while True:
        before = label.copy()
        for lo in range(0, len(x), 256):
            near = hit[lo : lo + 256]
            rows = x[lo : lo + 256]
            label[rows] = np.minimum(label[rows], np.where(near, label[y][None, :], top).min(axis=1))
            label[y] = np.minimum(label[y], np.where(near, label[rows][:, None], top).min(axis=0))
        if (before == label).all():
            return


class _Groups:
    """What the first steps find: candidate groups, exactly those whose members may be similar.

    units: (comp, k1, k2, doc, sig), the documents of each set; heads: (comp, k1,
    k2, uid, doc, n, m), each set once, with its least document and how many have
    it; spread: (comp, i, j, block, doc, k1, m, grams), the sets for each pair of blocks.
    """

    def __init__(self, docs: DataFrame, n: int, threshold: float, longest: int) -> None:
        spark: SparkSession = docs.sparkSession
        ship(spark)
        self.scratch, parts = Scratch(spark), partitions(spark)
        scratch, send = self.scratch, spark.sparkContext.broadcast
        docs = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
        shared = send(gram_sketch(docs, n, sketch_slots(docs.count())).tobytes())
        several = scratch.save(docs.where("doc is not null and text is not null").groupBy("doc").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y")).where("x <> y").select("doc"))
        repeated = send(sized(several, "doc", several.count()))
        packed = docs.mapInArrow(lean(_emitter(n, threshold, longest, parts, shared, repeated)), "part int, facts boolean, blob binary")
        posted = scratch.save(packed.repartitionById(parts, "part").mapInArrow(lean(_poster), _POSTED), by="kind", codec="zstd")
        scratch.sweep(posted)
        facts = posted.where("kind = 0").select(F.col("a").alias("doc"), F.col("b").alias("n"), F.col("c").alias("p")).groupBy("doc").agg(F.max("n").alias("n"), F.max("p").alias("p"))
        stars = scratch.save(_enough(posted.where("kind = 1").groupBy("a", "b").agg(F.sum("c").alias("c")), facts, threshold))
        groups = scratch.save(components(stars, scratch))
        postings = posted.where("kind = 2").select(F.col("a").alias("tok"), F.col("b").alias("doc"))
        who = facts.join(groups.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("comp", "doc").alias("comp"), "n", "p")
        # written between its two shuffles, so that the files of one are gone before those of the other are there
        placed = scratch.save(postings.join(who, "doc").select("tok", "doc", "comp", "n", "p"), codec="zstd")
        scratch.drop(posted)
        mixed = placed.repartition(parts, "tok").mapInArrow(lean(_crossing(threshold)), "a long, b long, c long, need long").groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("need").alias("need"))
        crossing = scratch.save(mixed.where("c >= need").select("a", "b"))
        scratch.sweep(placed)
        found = scratch.save(components(groups.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(crossing), scratch))
        scratch.drop(placed, stars, crossing, groups, several)
        grouped = send(sized(found, "node", found.count()))
        rows = docs.where("text is not null").withColumn("sig", F.xxhash64("text"))
        sets = rows.mapInArrow(lean(_setter(n, grouped, repeated)), "doc long, sig long, key long, n long, k1 long, k2 long, grams binary").where("n > 0")
        self.sets = sets = scratch.save(sets.withColumn("uid", F.monotonically_increasing_id()))
        keys = sets.select("doc", "sig", "key", "n", "k1", "k2", "uid").join(found.withColumnRenamed("node", "key"), "key")
        self.units = scratch.save(keys.groupBy("comp", "k1", "k2", "doc", "sig").agg(F.min("uid").alias("uid"), F.first("n").alias("n")))
        one = self.units.groupBy("comp", "k1", "k2", "doc").agg(F.min("uid").alias("uid"), F.first("n").alias("n"))
        least = F.min(F.struct("doc", "uid")).alias("of")
        self.heads = scratch.save(one.groupBy("comp", "k1", "k2").agg(least, F.first("n").alias("n"), F.count("*").alias("m")).select("comp", "k1", "k2", "of.doc", "of.uid", "n", "m"))
        many = F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_GRAMS)).cast("int")
        sizes = self.heads.groupBy("comp").agg(many.alias("blocks"), F.count("*").alias("heads")).where("heads > 1")
        blocks = self.heads.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("k1"), F.col("blocks").cast("long")).cast("int"))
        spread = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("comp", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "uid", "doc", "k1", "m")
        self.spread = spread.join(sets.select("uid", "grams"), "uid").select("comp", "i", "j", "block", "doc", "k1", "m", "grams")


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.5, longest: int = 4) -> DataFrame:
    """(doc_a, doc_b, jaccard) for the documents whose sets of word n-grams have a Jaccard similarity of threshold or more.

    doc_a < doc_b. Documents with one and the same set are copies: each copy is
    paired with the least id of its set, similarity 1, and that one id stands
    for all of them in the other pairs; `expand` gives the pairs of the copies
    too. Reads doc_id and text alone.

    Rows without an id take part in nothing. Null, empty and wordless texts
    have no grams and no partner. Rows that repeat an id are one document: if
    their texts differ, the pair counts that the best of its texts has. An
    empty table gives an empty result.
    """
    g = _Groups(docs, n, threshold, longest)
    copies = g.units.join(g.heads.select("comp", "k1", "k2", F.col("doc").alias("doc_a")), ["comp", "k1", "k2"]).where("doc_a <> doc").select("doc_a", F.col("doc").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    pairs = g.spread.groupBy("comp", "i", "j").applyInArrow(_pairs(threshold), "doc_a long, doc_b long, jaccard double")
    return copies.union(pairs).groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def _classes(docs: DataFrame, n: int, threshold: float, longest: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """(units with class, links and best similarity, classes, scratch)."""
    g = _Groups(docs, n, threshold, longest)
    found = g.scratch.save(g.spread.groupBy("comp", "i", "j").applyInArrow(_links(threshold), "head long, other long, links long, best double"))
    g.scratch.sweep(g.sets)
    g.scratch.drop(g.sets)
    comps = g.scratch.save(components(found.select(F.col("head").alias("a"), F.col("other").alias("b")), g.scratch))
    of = found.groupBy(F.col("head").alias("k1")).agg(F.sum("links").alias("links"), F.max("best").alias("best"))
    heads = g.heads.join(comps.select(F.col("node").alias("k1"), F.col("comp").alias("class")), "k1", "left").join(of, "k1", "left").where("m > 1 or links > 0")
    heads = heads.select("comp", "k1", "k2", "doc", F.coalesce("class", "k1").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("links"), F.when(F.col("m") > 1, 1.0).otherwise(F.col("best")).alias("best"))
    heads = g.scratch.save(heads)
    first = heads.groupBy("class").agg(F.min(F.struct("doc", "k1", "k2")).alias("first"))
    rows = g.units.join(heads.drop("doc"), ["comp", "k1", "k2"]).join(first, "class")
    g.scratch.drop(found, comps)
    return rows, first, g.scratch


def near_duplicate_classes(docs: DataFrame, n: int = 3, threshold: float = 0.5, longest: int = 4) -> DataFrame:
    """(doc_id, class_id, n_links, jaccard): a row for each document whose set of word n-grams has a Jaccard similarity of threshold or more with another's.

    n_links is the number of documents it is that similar to, copies counted
    each, and jaccard the highest similarity; class_id is the least id of all
    that links connect, directly or not. Reads doc_id and text alone.

    Rows without an id take part in nothing. Null, empty and wordless texts
    have no grams and no link. Rows that repeat an id and a set of n-grams are
    one document; an id that comes with other sets names several documents,
    each with its links and its row. Ties don't matter: all links count. Texts
    of any length are read whole. Other columns may have any name. An empty
    table gives an empty result.
    """
    rows, _, _ = _classes(docs, n, threshold, longest)
    return rows.groupBy("k1", "k2", F.col("doc").alias("doc_id")).agg(F.first("first.doc").alias("class_id"), F.first("links").alias("n_links"), F.first("best").alias("jaccard")).select("doc_id", "class_id", "n_links", "jaccard")


def expand(pairs: DataFrame) -> DataFrame:
    """(doc_a, doc_b, jaccard) for all pairs of a join's result (doc_a, doc_b, jaccard), those of the copies too; as many rows as there are pairs.

    Where an id has several texts, a star of one of them is not told apart from
    the others', so pairs may be added that don't exist. Rows with a null are
    no pairs, repeated ones count once, with the best similarity. An empty
    result gives an empty one; other columns are left out.
    """
    star = pairs.where("jaccard = 1").select(F.col("doc_a").alias("h"), F.col("doc_b").alias("m"))
    star = star.union(pairs.select(F.explode(F.array("doc_a", "doc_b")).alias("h")).select("h", F.col("h").alias("m")).distinct()).distinct()
    a, b = star.toDF("doc_a", "a"), star.toDF("doc_b", "b")
    across = pairs.join(a, "doc_a").join(b, "doc_b").select("a", "b", "jaccard")
    within = a.alias("x").join(a.toDF("h", "b").alias("y"), F.expr("x.doc_a = y.h and x.a < y.b")).select("a", "b", F.lit(1.0).alias("jaccard"))
    out = across.union(within).where("a <> b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")
    return out.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def drop_near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5) -> DataFrame:
    """Keeps one document of each class of near duplicates, the one with the least id; all columns stay.

    Documents that resemble nothing, or that have no id or no words, stay. Rows
    that repeat an id and a set of n-grams are copies of a row: they stay or go
    together. An id that comes with other texts names several documents; of
    those in one class with the least id, one stays. An empty table gives an
    empty result; other columns may have any name.
    """
    rows, _, scratch = _classes(docs, n, threshold, 4)
    gone = scratch.save(rows.where("doc <> first.doc or k1 <> first.k1 or k2 <> first.k2").select(F.col("doc").alias("__gone"), F.col("sig").alias("__sig")).distinct())
    return docs.join(gone, (docs["doc_id"].cast("long") == gone["__gone"]) & (F.xxhash64(docs["text"].cast("string")) == gone["__sig"]), "left_anti")
