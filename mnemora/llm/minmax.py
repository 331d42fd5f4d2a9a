"""Operator 9: near-duplicates by min-max hashing.

A document's set holds its distinct word shingles.  Each permutation gives both
its minimum and its maximum, so half as many permutations serve a signature.
Bands of three permutations (six values) send sets to buckets; of short sets,
whose minimum and maximum depend on each other, shorter bands do.  Documents of
equal sets are one class that goes on as one row with a number of its own.

Buckets never give all their pairs.  First every class is held against its
bucket's pivot, the class that meets most others; what links there forms
components.  Buckets that still span several components then give the pairs
across components that were not compared yet.  A signature that rules out the
threshold by `deviations` standard deviations ends a pair early (None: no pair;
pairs with a short set never end so); all other pairs are compared on full sets.

Defined results: a null text, one without a word and one without a doc_id has or
counts as an empty set, links with nothing and is kept; fewer words than a
shingle make one shingle; equal sets are one component; the kept one is the
smallest doc_id; rows of one doc_id with different texts are separate documents,
told apart by text_hash, and wholly repeated rows are all kept or none; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora.llm.components import components
from mnemora.llm.runtime import BROADCAST_IDS, give_back, join_hot, only, row_blocks, written

WORDS_AT_ONCE = 1 << 14
#: Pairs whose two texts a worker holds as strings at a time.
PAIRS_AT_ONCE = 128
#: A pivot's text goes to so many pairs at a time.
PAIRS_OF_A_PIVOT = 256
#: Rows and bytes of text in a block of a bucket or of its strays.
BLOCK_ROWS, BLOCK_BYTES = 256, 8 << 20
#: Sets up to this many shingles have short bands; those a quarter larger have both.
SHORT_SET = 32
SIGNATURES = "doc_id long, text_hash long, n_bytes long, n_shingles long, digest binary, bands array<long>, sketch binary"
_MIX, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str, size: int) -> np.ndarray:
    """The set's 64-bit hashes, rising.  Words are what stands between ASCII white space; A-Z count as a-z."""
    from xxhash import xxh3_64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _MIX + h[i : len(h) - k + 1 + i])
    return np.unique(out)


class MinMax:
    """permutations x 2 values of a set, in bands of band_permutations x 2."""

    def __init__(self, bands: int, band_permutations: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, band_permutations
        n = bands * band_permutations
        self.a = rng.integers(0, 2**64, n, np.uint64, endpoint=False) | np.uint64(1)
        self.b = rng.integers(0, 2**64, n, np.uint64, endpoint=False)

    def values(self, s: np.ndarray) -> np.ndarray:
        low = high = None
        for i in range(0, len(s), WORDS_AT_ONCE):
            v = s[None, i : i + WORDS_AT_ONCE] * self.a[:, None]
            v += self.b[:, None]
            lo, hi = v.min(1), v.max(1)
            low, high = (lo, hi) if low is None else (np.minimum(low, lo), np.maximum(high, hi))
        return np.stack([low, high], 1)

    def _keys(self, values: np.ndarray, rows: int) -> np.ndarray:
        v = values.reshape(-1, rows * 2)
        key = np.arange(1, len(v) + 1, dtype=np.uint64) + np.uint64(rows << 32)
        for i in range(v.shape[1]):
            key = _mix(key * _MIX + v[:, i])
        return key.view(np.int64)

    def keys(self, values: np.ndarray, n: int) -> np.ndarray:
        """The buckets of a set of n shingles."""
        short, usual = n <= SHORT_SET * 5 // 4, n > SHORT_SET
        some = len(values) // 2 * 2
        return np.concatenate([*[self._keys(values[:some], 2)] * short, *[self._keys(values, self.rows)] * usual])

    def sketch(self, values: np.ndarray) -> bytes:
        """A byte of each value."""
        return (_mix(values.ravel()) >> np.uint64(56)).astype(np.uint8).tobytes()


def signatures(docs: DataFrame, size: int, hashing: MinMax, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in row_blocks(batches):
            n, digest, bands, sketch = [], [], [], []
            for t in texts:
                s = shingles(t, size)
                n.append(len(s))
                if not len(s):
                    digest.append(None), bands.append(None), sketch.append(None)
                    continue
                v = hashing.values(s)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                bands.append(hashing.keys(v, len(s)))
                sketch.append(hashing.sketch(v))
            yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", "text_hash", "n_bytes")], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["doc_id", "text_hash", "n_bytes", "n_shingles", "digest", "bands", "sketch"])

    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, SIGNATURES)


def _sizes_allow(percent: int):
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def _bound(values: int, percent: int, deviations: float | None) -> float:
    """So many equal values of two signatures leave the threshold possible."""
    share = percent / 100
    return -1.0 if deviations is None else values * share - deviations * np.sqrt(values * share * (1 - share))


def _dealt(pairs: DataFrame) -> DataFrame:
    """a, b, part: the pairs of one b in parts that each hold no more than a task should."""
    of = written(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("m")), "pivots")
    sized = join_hot(pairs, of, "b", "m", pairs.count())
    return written(sized.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("m") / PAIRS_OF_A_PIVOT)).cast("int").alias("part")), "dealt")


def _beside(dealt: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """The pairs with both sides' values (cid, column) as x and y: a pivot's value once for each of its parts."""
    parts = dealt.select("b", "part").distinct()
    of_b = parts.join(values.select(F.col("cid").alias("b"), F.col(column).alias("y")), "b")
    return dealt.join(values.select(F.col("cid").alias("a"), F.col(column).alias("x")), "a").join(of_b, ["b", "part"])


def _likely(dealt: DataFrame, classes: DataFrame, percent: int, deviations: float | None) -> DataFrame:
    """Pairs whose sketches don't rule out the threshold, or with a short set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not len(rows):
                continue
            x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(len(rows), -1) for c in ("x", "y"))
            enough = ((x == y).sum(1) >= _bound(x.shape[1], percent, deviations)) | (rows.column("n").to_numpy() <= SHORT_SET)
            yield rows.select(["a", "b", "part"]).filter(pa.array(enough))

    both = _beside(dealt, classes, "sketch").join(classes.select(F.col("cid").alias("a"), "n"), "a")
    return both.select("a", "b", "part", "n", "x", "y").mapInArrow(run, "a long, b long, part int")


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cid, text of the classes with these cids: the text that stands for the class."""
    wanted = written(ids.join(classes.select("cid", "rep.doc_id", "rep.text_hash"), "cid"), "wanted")
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    few = wanted.count() <= BROADCAST_IDS
    return written(hashed.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_hash"]).groupBy("cid").agg(F.first("text").alias("text")), "near-texts")


def _linked(dealt: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (written table) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def of(i: int, text: str) -> np.ndarray:
            if i not in held:
                if len(held) >= 64:  # pairs come by pivot
                    held.clear()
                held[i] = shingles(text, size)
            return held[i]

        give_back()
        for rows in (b.slice(i, PAIRS_AT_ONCE) for b in batches for i in range(0, len(b), PAIRS_AT_ONCE)):
            keep = []
            for a, b, x, y in zip(*[rows.column(c).to_pylist() for c in ("a", "b", "x", "y")], strict=True):
                p, q = of(a, x), of(b, y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = _texts(dealt.select(F.col("a").alias("cid")).unionByName(dealt.select(F.col("b").alias("cid"))).distinct(), classes, docs)
    return _beside(dealt, texts, "text").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _first_shared(keys: list[list[int]], key: int) -> np.ndarray:
    """Membership in buckets before `key`: rows whose product is above 0 met there already."""
    before = {k: c for c, k in enumerate(sorted({k for own in keys for k in own if k < key}))}
    member = np.zeros((len(keys), len(before)), np.float32)
    for r, own in enumerate(keys):
        member[r, [before[k] for k in own if k < key]] = 1
    return member


def _cross(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """The strays of a block, each with the block's other rows to hold it against: of other components, of a fitting size, first met here."""
    key, role = t.column("key")[0].as_py(), t.column("stray").to_numpy(zero_copy_only=False)
    cid, n, comp, usual = (t.column(c).to_numpy() for c in ("cid", "n", "c", "usual"))
    member = _first_shared(t.column("keys").to_pylist(), key)
    among = np.flatnonzero(~role)
    odd = comp[among] != usual[among]
    for r in np.flatnonzero(role):
        ok = (comp[among] != comp[r]) & ~(odd & (cid[among] < cid[r])) & (100 * np.minimum(n[among], n[r]) >= percent * np.maximum(n[among], n[r]))  # a pair of two strays comes once
        cand = among[ok]
        if member.shape[1] and len(cand):
            cand = cand[member[cand] @ member[r] == 0]
        if len(cand):
            yield int(r), cand


def _across(shared: DataFrame, found: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int, deviations: float | None) -> DataFrame:
    """Components once the pairs across components, in buckets that span several, are compared too.

    Strays are the rows of a bucket outside its largest component: only they meet
    others.  Blocks of the bucket meet blocks of its strays: first their sketches,
    then the full sets of rows that a sketch doesn't rule out.  So a bucket of R
    rows with few strays is dealt as about R rows.
    """
    placed = written(shared.where(F.col("m") > 2).join(found.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", "n", "n_bytes", F.coalesce("component", "cid").alias("c"), F.col("least.cid").alias("pivot")), "placed")
    parts = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("rows"), F.sum("n_bytes").alias("bytes"))
    of_key = parts.groupBy("key").agg(F.max(F.struct("rows", "bytes", "c")).alias("most"), F.sum("rows").alias("m"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("cs")).where("cs > 1")
    cut = lambda rows, size: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    span = written(of_key.select("key", "m", F.col("most.c").alias("usual"), cut(F.col("m"), F.col("bytes")).alias("blocks"), cut(F.col("m") - F.col("most.rows"), F.col("bytes") - F.col("most.bytes")).alias("odd_blocks")), "span")
    if span.isEmpty():
        return found
    rows = written(join_hot(placed.where(F.col("cid") != F.col("pivot")).drop("pivot", "n_bytes"), span, "key", "m", placed.count()).drop("m"), "rows")
    own = rows.groupBy("cid").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # at most one a band
    keyed = rows.join(own, "cid").withColumn("h", F.xxhash64("cid"))
    every = keyed.withColumn("i", F.pmod("h", "blocks").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1))).withColumn("stray", F.lit(False))
    strays = keyed.where(F.col("c") != F.col("usual")).withColumn("j", F.pmod("h", "odd_blocks").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("stray", F.lit(True))
    columns = ["key", "i", "j", "stray", "cid", "n", "c", "usual", "keys"]
    dealt = written(every.select(columns).unionByName(strays.select(columns)), "spanning")

    def likely(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), -1)
        bound, short = _bound(x.shape[1], percent, deviations), t.column("n").to_numpy() <= SHORT_SET
        keep = np.zeros(len(t), bool)
        for r, cand in _cross(t, percent):
            cand = cand[short[r] | short[cand] | ((x[cand] == x[r]).sum(1) >= bound)]
            keep[cand] = True
            keep[r] |= len(cand) > 0
        return t.select(["key", "i", "j", "cid", "stray"]).filter(pa.array(keep))

    def linked(t: pa.Table) -> pa.Table:
        sets = [shingles(x, size) for x in t.column("text").to_pylist()]
        flat, place = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum([0, *map(len, sets)])[:-1]
        sizes = np.array([len(s) for s in sets])
        cid, comp = t.column("cid").to_pylist(), t.column("c").to_numpy()
        mark, out = np.zeros(len(flat), np.int64), []
        for r, cand in _cross(t, percent):
            mine = place[starts[r] : starts[r] + sizes[r]]
            mark[mine] = 1
            both = np.add.reduceat(mark[place], starts)[cand]
            mark[mine] = 0
            hit = cand[100 * both >= percent * (sizes[cand] + sizes[r] - both)]
            _, one = np.unique(comp[hit], return_index=True)  # a link to each component is enough
            out += [(cid[r], cid[h]) for h in hit[one]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    block = ["key", "i", "j"]
    sketched = dealt.join(classes.select("cid", "sketch"), "cid")
    open_rows = written(sketched.groupBy(*block).applyInArrow(likely, "key long, i int, j int, cid long, stray boolean"), "open")
    if open_rows.isEmpty():
        return found
    texts = _texts(open_rows.select("cid").distinct(), classes, docs)
    full = dealt.join(open_rows, [*block, "cid", "stray"]).join(texts, "cid")
    late = full.groupBy(*block).applyInArrow(linked, "a long, b long")
    return written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late)), "components")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 28, band_permutations: int = 3, deviations: float | None = 6.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash."""
    docs = only(docs, doc_id=id_col, text=text_col)
    hashing = MinMax(bands, band_permutations)
    sig = written(signatures(docs, size, hashing), "signatures")
    full = sig.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    per_class = full.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(per_class.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = classes.select("cid", "n", "n_bytes", F.explode("bands").alias("key"))
    # one row a bucket; counts and pivots meet before the shuffle
    crowds = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > 1), "crowds")
    met_in = crowds.agg(F.sum("m")).first()[0] or 0
    crowded = written(join_hot(rows, crowds, "key", "m", met_in), "crowded")
    # of a bucket the class that meets others most, as the text that others were made from does
    central = crowded.groupBy("cid").agg(F.sum("m").alias("met"))
    met = written(crowded.join(central, "cid").select("key", "cid", "n", "n_bytes", "m", (-F.col("met")).alias("order")), "met")
    pivots = written(met.groupBy("key").agg(F.min(F.struct("order", "cid", "n")).alias("least"), F.max("m").alias("m")), "least")
    shared = written(join_hot(met.drop("order", "m"), pivots, "key", "m", met_in), "buckets")
    first = shared.where(F.col("cid") != F.col("least.cid")).select(F.col("cid").alias("a"), F.col("least.cid").alias("b"), F.col("n").alias("n_a"), F.col("least.n").alias("n_b")).where(_sizes_allow(percent)).select("a", "b").distinct()
    tested = written(_likely(_dealt(written(first, "first")), classes, percent, deviations), "pairs")
    found = written(components(_linked(tested, classes, docs, size, percent)), "components")

    found = _across(shared, found, classes, docs, size, percent, deviations)
    smallest = found.join(classes.select(F.col("cid").alias("node"), F.col("rep.doc_id").alias("rep")), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_linked = found.join(smallest, "component").select(F.col("node").alias("cid"), "component_id")
    of_class = written(classes.select("digest", "copies", "cid", F.col("rep.doc_id").alias("rep")).join(of_linked, "cid", "left").select("digest", "copies", F.coalesce("component_id", "rep").alias("component_id")), "of-class")
    linked = join_hot(sig.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "n_shingles", "text_hash", "digest"), of_class, "digest", "copies", of_class.agg(F.sum("copies")).first()[0] or 0)
    alone = sig.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", "text_hash", F.col("doc_id").alias("component_id"))
    out = linked.select("doc_id", "n_shingles", "text_hash", "component_id").unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
