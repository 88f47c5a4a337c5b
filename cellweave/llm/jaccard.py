"""N-gram Jaccard join by parity sketches.

A document is its set of distinct hashed word shingles. XOR-ing one bit per shingle gives a parity sketch: the
sketches of A and B differ in at most |A symmetric-difference B| bits. A Jaccard similarity of t bounds that
difference by d = (|A|+|B|)(1-t)/(1+t). Sets fall in size bands; in a band with limit d, the sketch is cut into
more than d words, so that two linked sets agree in a whole word (pigeonhole). Grouping by (band, word number,
word) therefore finds every link; candidates are verified on the sets themselves.

Within a bucket, members first meet one leader. Buckets that this leaves in several components are merged where
they overlap and compared block by block, on short parity sketches: a first pass proposes a forest of likely links,
which unites what is alike; in a second one, sets are fetched for those only that still have a likely partner in
another component, and compared. Every pair that shares a key is thus in one component or has been compared:
components are exact.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Memo, as_bytes, connected_components, discard, materialize, mix, release, slices, unused, windows

WORDS = Memo(xxhash.xxh3_64_intdigest)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased, words parted by ASCII white space."""
    words = text.lower().split()
    hashes = np.fromiter(map(WORDS.__getitem__, words), dtype=U64, count=len(words))
    return np.unique(windows(hashes, k))


def _shingled(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sets of a batch's texts. A function of the module, for nested ones would trim a copy of the memo."""
    Memo.focus(WORDS)
    sets = [shingles(text, k) for text in as_bytes(batch.column("text"))]
    WORDS.trim()
    return sets


class Band:
    """Sizes lo..hi. Linked sets of which the larger lies here differ in at most d words out of m."""

    def __init__(self, number: int, lo: int, hi: int, num: int, den: int):
        self.number, self.lo, self.hi = number, lo, hi
        self.d = 2 * hi * (den - num) // (den + num)
        self.m = (self.d + 1) * 5 // 4 + 1


class Bands:
    """Size bands for a similarity of num/den."""

    def __init__(self, num: int, den: int, ratio: float = 1.25):
        self.num, self.den, self.ratio, self.bands = num, den, ratio, [Band(0, 1, 1, num, den)]

    def of(self, size: int) -> list[Band]:
        """The band of the size, and those in which a larger partner may lie. Where d is 0, only equal sets link."""
        largest = size * self.den // self.num
        while self.bands[-1].hi < largest:
            lo = self.bands[-1].hi + 1
            self.bands.append(Band(len(self.bands), lo, max(lo, int(lo * self.ratio)), self.num, self.den))
        first = bisect.bisect_left(self.bands, size, key=lambda b: b.hi)
        last = bisect.bisect_left(self.bands, largest, key=lambda b: b.hi)
        return [b for b in self.bands[first : last + 1] if b.d]


def sketch_keys(tokens: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of the d + 1 words that hold most tokens, for each band. Two linked sets have one in common.

    A word is a parity sketch, held as its linear fingerprint: XOR of one random number per member. The number follows all
    64 bits of the member's hash: with a few thousand values, words of one member would meet by chance in a share of all
    sets that grows with their number, and what is fetched and compared would grow with its square.
    Order words by tokens, then place. At most d words hold a token in which two linked sets differ; among the others,
    which both sets order alike, the first has at most d words before it in either set, so both emit it. Words of many
    tokens rarely collide by chance, so the fullest come first.
    """
    out = [np.empty(0, U64)]
    t = mix(tokens)
    with np.errstate(over="ignore"):
        spot = mix(t + U64(1))
        for band in bands.of(len(tokens)):
            block = ((t >> U64(32)) * U64(band.m) >> U64(32)).astype(np.int64)
            words = np.zeros(band.m, U64)
            np.bitwise_xor.at(words, block, spot)
            fullest = np.argsort(-np.bincount(block, minlength=band.m), kind="stable")[: band.d + 1]
            place = mix((U64(band.number) << U64(32)) + fullest.astype(U64))
            out.append(mix(words[fullest] * U64(0xD6E8FEB86659FD93) + place))
    return np.concatenate(out)


def set_node(tokens: np.ndarray) -> int:
    """A 64-bit name of a set; equal sets have equal names, different ones but for a chance of 2**-64."""
    with np.errstate(over="ignore"):
        x = mix(np.array([tokens.sum(dtype=U64) * U64(3) + np.bitwise_xor.reduce(tokens) + U64(len(tokens))], dtype=U64))
    return int(x.view(np.int64)[0])


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = _shingled(batch, k)
            sizes, nodes = [len(x) for x in sets], [set_node(x) if len(x) else None for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("rid"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], ["doc", "rid", "n", "node"])

    return run


HOT, SALTS = 32, 256


def _keys(k: int, num: int, den: int):
    """Rows (bucket, node, key). A key that HOT sets of one slice share goes to one of SALTS buckets, its least node also to the key's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num, den)
        for batch in slices(batches, "text"):
            sets = {set_node(x): x for x in _shingled(batch, k) if len(x)}
            lists = [sketch_keys(x, bands) for x in sets.values()]
            key = np.concatenate([np.empty(0, U64), *lists])
            node = np.repeat(np.fromiter(sets, np.int64, len(sets)), [len(x) for x in lists])
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            hot = counts[inverse] >= HOT
            bucket = key.copy()
            if hot.any():
                with np.errstate(over="ignore"):
                    bucket[hot] = mix(key[hot] + U64(1 + int(node.min()) % SALTS))
                order = np.lexsort((node[hot], key[hot]))
                first = np.flatnonzero(hot)[order][np.unique(key[hot][order], return_index=True)[1]]
                key, node, bucket, hot = (np.concatenate([x, y]) for x, y in ((key, key[first]), (node, node[first]), (bucket, key[first]), (hot, np.zeros(len(first), bool))))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(node), pa.array(key.view(np.int64), mask=~hot)], ["bucket", "node", "key"])

    return run


def parity_sketch(tokens: np.ndarray) -> np.ndarray:
    """A set's parity bits, two to four times as many as it has members; halves XOR-ed give the sketch of half the bits."""
    words = 1 << max(3, (2 * len(tokens) - 1).bit_length() - 6)
    out = np.zeros(words, U64)
    np.bitwise_xor.at(out, ((tokens >> U64(8)) & U64(words - 1)).astype(np.int64), U64(1) << (tokens & U64(63)))
    return out


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [x for x in _shingled(batch, k) if len(x)]
            columns = [pa.array([set_node(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
            columns += [pa.array([f(x).tobytes() for x in sets], pa.binary()) for f in (parity_sketch, lambda x: x)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "sketch", "tokens"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.focus()
        for batch in slices(batches, "tokens"):
            keep = []
            for a, b in zip(batch.column("tokens").to_pylist(), batch.column("tokens_b").to_pylist()):
                a, b = np.frombuffer(a, U64), np.frombuffer(b, U64)
                both = np.sort(np.concatenate([a, b]))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * same >= num * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _allowed(num: int, den: int):
    """The pairs whose parity sketches, folded to the shorter one's bits, allow them to be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        Memo.focus()
        for batch in slices(batches, "s_a"):
            keep = []
            for n, m, a, b in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b"))):
                least = min(len(a), len(b)) >> 3
                a, b = (np.bitwise_xor.reduce(np.frombuffer(x, U64).reshape(-1, least), axis=0) for x in (a, b))
                keep.append(int(np.bitwise_count(a ^ b).sum(dtype=np.int64)) * (num + den) <= (n + m) * (den - num))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """A table of the pairs (src, dst) whose sets are similar enough. Sketches meet first, and sets only for pairs that these allow.

    Pairs are written before each join, so that Spark broadcasts them where they are few, by their true size, and no
    set is shuffled then. Where they are many, a bitmap leaves those sets to shuffle that are in a pair.
    """
    pairs = materialize(pairs.select("src", "dst").distinct())
    a = sets.select(F.col("node").alias("src"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    b = sets.select(F.col("node").alias("dst"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    sized = pairs.join(a, "src").join(b, "dst").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    near = materialize(sized.select("src", "dst", "n_a", "n_b", "s_a", "s_b").mapInArrow(_allowed(num, den), "src long, dst long"))
    a = _held(sets, "node", near, "src").select(F.col("node").alias("src"), "tokens")
    b = _held(sets, "node", near, "dst").select(F.col("node").alias("dst"), F.col("tokens").alias("tokens_b"))
    both = near.join(a, "src").join(b, "dst").select("src", "dst", "tokens", "tokens_b")
    out = materialize(both.mapInArrow(_verify(num, den), "src long, dst long"))
    discard(pairs, near)
    return out


#: A bitmap of 64 times so many bits is what the rows of candidates are found by; it doesn't grow with the data.
MARKS = 1 << 18


def _held(rows: DataFrame, column: str, keys: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows whose column is among the keys, and a few others, by a broadcast bitmap; with left_anti, only rows that aren't among them."""
    place = lambda c: (f"shiftrightunsigned(`{c}`, 6) & {MARKS - 1}L", f"shiftleft(1L, cast(`{c}` & 63 as int))")
    (word, bit), (own, own_bit) = place(key), place(column)
    name, bits = unused(rows, "word", "bits")
    marks = keys.groupBy(F.expr(word).alias(name)).agg(F.expr(f"bit_or({bit})").alias(bits))
    return rows.join(F.broadcast(marks), F.expr(f"`{name}` = ({own}) and ({own_bit} & `{bits}`) <> 0"), how)


def _marked(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """Rows of docs whose rid is in the table rids. A bitmap lets few others through, so that the exact join, where it can't broadcast, shuffles few texts."""
    return _held(docs, "rid", rids, "rid").join(rids, "rid", "left_semi")


def similarity_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of the graph that links documents with den * |A and B| >= num * |A or B| over k-word shingles.

    Returns one row per input row: doc (the id), rid (a hash of id and text), n (size of its set) and comp (a
    component's number; null for a document without words, which links with nothing). Null ids and texts,
    repeated rows, ties, extra columns, very long texts and empty tables are fine: rows are told apart by id and
    text, null text counts as empty, and equal rows share all results.
    """
    docs = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("rid"))
    ids = docs.schema["doc"].dataType.simpleString()
    sig = materialize(docs.mapInArrow(_signatures(k), f"doc {ids}, rid long, n long, node long"))
    keyed = docs.select("text").mapInArrow(_keys(k, num, den), "bucket long, node long, key long")
    bucket = Window.partitionBy("bucket")
    met = keyed.withColumns({"lead": F.min("node").over(bucket), "last": F.max("node").over(bucket)}).where("lead <> last or key is not null")
    members = materialize(met.select(F.coalesce("key", "bucket").alias("key"), "node", "lead"))
    names = members.select("node").distinct()
    rids = materialize(sig.join(names, "node", "left_semi").groupBy("node").agg(F.min("rid").alias("rid")).select("rid"))
    texts = _marked(docs.select("rid", "text"), rids).select("text").mapInArrow(_sets(k), "node long, n long, sketch binary, tokens binary")
    sets = materialize(texts)
    if sets.groupBy("node").count().where("count > 1").head(1):  # the same row more than once
        once = materialize(sets.dropDuplicates(["node"]))
        discard(sets)
        sets = once
    links = _linked(members.where("node <> lead").select(F.col("node").alias("src"), F.col("lead").alias("dst")), sets, num, den)
    labels = _settle(members, links, sets, num, den)
    discard(members, rids, sets, links)
    return sig.select("doc", "rid", "n", "node").join(labels, "node", "left").select("doc", "rid", "n", F.coalesce("label", "node").alias("comp"))


def _likely(num: int, den: int, forest: bool):
    """Pairs of a group's two blocks (of one, if they are the same) from different components that their sketches allow.

    forest: only pairs (src, dst) that unite components, each taken for a link once it is proposed. Else the nodes
    (cluster, i, j, block, node) of all such pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        Memo.focus()
        node, block, comp, size = (table.column(c).to_numpy() for c in ("node", "block", "comp", "n"))
        comp, i, j = comp.copy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        sketches = table.column("sketch").to_pylist()
        width = np.array([len(x) >> 3 for x in sketches])
        classes = {}  # by words of a sketch: rows in order of size, their sizes, and their sketches
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            rows = rows[np.argsort(size[rows], kind="stable")]
            classes[w] = rows, size[rows], np.frombuffer(b"".join(sketches[r] for r in rows), U64).reshape(len(rows), w)
        sketches = None
        pairs, hit = [], np.zeros(len(node), bool)
        for w, (rows, _, own) in classes.items():
            for a, sketch in zip(rows.tolist(), own):
                least, v = -(-int(size[a]) * num // den), w
                while True:  # partners no larger than a, of this class and of shorter sketches
                    if v in classes:
                        others, sizes, theirs = classes[v]
                        lo, hi = np.searchsorted(sizes, [least, size[a] + 1])
                        near = np.arange(lo, hi)
                        b = others[lo:hi]
                        ok = (comp[b] != comp[a]) & ((block[b] != block[a]) if i != j else True) & ((size[b] < size[a]) | (b < a))
                        near, b = near[ok], b[ok]
                        if len(b):
                            far = np.bitwise_count(theirs[near] ^ sketch).sum(axis=1, dtype=np.int64)
                            b = b[far * (num + den) <= (size[b] + size[a]) * (den - num)]
                        if not forest:
                            hit[b] = True
                            hit[a] |= len(b) > 0
                        else:
                            for c in b.tolist():
                                if comp[c] != comp[a]:
                                    pairs.append((int(node[a]), int(node[c])))
                                    comp[comp == comp[c]] = comp[a]
                    if v <= 8 or least > 16 * v:
                        break
                    v >>= 1
                    sketch = sketch[:v] ^ sketch[v:]
        if forest:
            return pa.table({"src": pa.array([x for x, _ in pairs], pa.int64()), "dst": pa.array([x for _, x in pairs], pa.int64())})
        return table.select(["cluster", "i", "j", "block", "node", "comp"]).filter(pa.array(hit))

    return run


def _compare(num: int, den: int):
    """Pairs of different components of a group's two blocks, compared on their sets; edges that join components."""

    def run(table: pa.Table) -> pa.Table:
        Memo.focus()
        if table.nbytes > 16 << 20:
            release()
        sets = [np.frombuffer(x, U64) for x in table.column("tokens").to_pylist()]
        node, block, comp = (table.column(c).to_numpy() for c in ("node", "block", "comp"))
        comp, size, own = comp.copy(), np.array([len(x) for x in sets]), table.column("i")[0].as_py() == table.column("j")[0].as_py()
        sketch = [parity_sketch(x) for x in sets]
        least = min(map(len, sketch))
        sketch = np.array([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in sketch])
        edges = []
        for a in np.argsort(-size, kind="stable").tolist():
            right = np.flatnonzero((comp != comp[a]) & (size <= size[a]) & (size * den >= size[a] * num) & ((block != block[a]) | own))
            far = np.bitwise_count(sketch[right] ^ sketch[a]).sum(axis=1, dtype=np.int64)
            for b in right[far * (num + den) <= (size[right] + size[a]) * (den - num)].tolist():
                if comp[a] != comp[b]:
                    same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                    if den * same >= num * (size[a] + size[b] - same):
                        edges.append((int(node[a]), int(node[b])))
                        comp[comp == comp[b]] = comp[a]
        return pa.table({"src": pa.array([x for x, _ in edges], pa.int64()), "dst": pa.array([x for _, x in edges], pa.int64())})

    return run


BLOCK_ROWS, BLOCK_BYTES, TASK_ROWS, FEW_BLOCKS = 4096, 1 << 20, 256, 12


def _pairs_of_blocks(rows: DataFrame) -> DataFrame:
    """Rows (cluster, node, comp, n, sketch) of clusters with several components, dealt into blocks of bounded rows and bytes; one group for each pair of blocks."""
    open_ = rows.groupBy("cluster").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.count("*").alias("rows"), F.sum(F.length("sketch")).alias("bytes")).where("c <> d")
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("rows") / TASK_ROWS), F.lit(FEW_BLOCKS)))
    open_ = materialize(open_.select("cluster", blocks.cast("long").alias("blocks")))
    dealt = rows.join(open_, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp", "n", "sketch")
    return dealt.repartition("cluster", "i", "j")  # else a cluster would stay where its rows met their number of blocks


def _settle(members: DataFrame, links: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Labels (node, label) once every bucket's pairs of different components have been compared.

    Buckets that their leader didn't unite are merged into clusters where they share members. A cluster is dealt
    into blocks of bounded bytes, and each pair of blocks is one group, so that no task sees more than two blocks.
    What is copied to each pair is a sketch, a sixteenth or less of a set.
    """
    labels = connected_components(links)
    placed = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"), "lead")
    other = F.when(F.col("node") != F.col("lead"), F.col("node"))
    shape = placed.groupBy("key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min("node").alias("head"), F.max(other).alias("top"), F.min(other).alias("low"))
    open_ = shape.where("c <> d and low <> top").select("key", "head")
    loose = materialize(placed.join(open_, "key").select("node", "comp", "head").distinct())
    if not loose.head(1):
        discard(loose)
        return labels
    cluster = connected_components(loose.select(F.col("node").alias("src"), F.col("head").alias("dst")))
    rows = materialize(loose.select("node", "comp").distinct().join(cluster, "node").select("node", "comp", F.col("label").alias("cluster")).join(sets.select("node", "n", "sketch"), "node"))
    tree = _pairs_of_blocks(rows).groupBy("cluster", "i", "j").applyInArrow(_likely(num, den, True), "src long, dst long")
    found = _linked(tree, sets, num, den)
    links = links.unionByName(found)
    labels = connected_components(links)
    united = rows.join(labels, "node", "left").select("cluster", "node", F.coalesce("label", "node").alias("comp"), "n", "sketch")
    kinds = "cluster long, i long, j long, block long, node long, comp long"
    open_nodes = materialize(_pairs_of_blocks(united).groupBy("cluster", "i", "j").applyInArrow(_likely(num, den, False), kinds))
    if open_nodes.head(1):
        met = open_nodes.join(_held(sets, "node", open_nodes, "node").select("node", "tokens"), "node").repartition("cluster", "i", "j")
        last = met.groupBy("cluster", "i", "j").applyInArrow(_compare(num, den), "src long, dst long")
        more = materialize(last)
        labels = connected_components(links.unionByName(more))
        discard(more)
    discard(loose, rows, found, open_nodes)
    return labels


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id, the least id that links reach, for each row; see similarity_components."""
    rows = materialize(similarity_components(df, id_col, text_col, k, num, den))
    # A table of its own, so that Spark may split a large component's rows in the join.
    least = materialize(rows.where("comp is not null").groupBy("comp").agg(F.min("doc").alias("least"), F.count("*").alias("rows")).where("rows > 1").select("comp", "least"))
    return rows.join(least, "comp", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("least", "doc").alias("component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of df without near duplicates: of each component the row with the least id stays, one of equal rows.

    Rows with a null id come after all others of a component. Documents without words, null texts among them, link
    with nothing and all stay. Columns are those of df, whatever their names. Only rows that
    a bitmap of the numbers of those that go, or occur twice, lets through are joined with these numbers; no other text
    is shuffled, however many go.
    """
    rows = materialize(similarity_components(df, id_col, text_col, k, num, den))
    (rid,) = unused(df, "rid")
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "rid")).alias("first")
    stay = rows.where("comp is not null").groupBy("comp").agg(first, F.count("*").alias("rows")).where("rows > 1").select("comp", F.col("first.rid").alias("stays"))
    lost = materialize(rows.join(materialize(stay), "comp").where("rid <> stays").select(F.col("rid").alias(rid)).distinct())
    twice = materialize(rows.where("comp is not null").groupBy("rid").count().where("count > 1").select(F.col("rid").alias(rid)))
    every, doubt = df.withColumn(rid, F.xxhash64(F.col(id_col), F.col(text_col))), lost.union(twice)
    left = _held(every, rid, doubt, rid).join(lost, rid, "left_anti")
    if twice.head(1):
        left = left.join(twice, rid, "left_anti").unionByName(left.join(twice, rid, "left_semi").dropDuplicates([rid]))
    return _held(every, rid, doubt, rid, "left_anti").unionByName(left).select(*map(_quoted, df.columns))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
