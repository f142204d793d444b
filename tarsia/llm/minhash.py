"""Near-duplicate components by MinHash: universal hash minima, banding, verification, stars.

A set of shingles has ``BANDS * ROWS`` minima under as many universal hash functions, 16 bits
of each. Sets that agree on all minima of a band meet in a bucket: of two sets at 0.8 that
happens with a probability of 1 - (1 - 0.8^4)^32, so one such pair in twenty million is missed, as the
comparison of whole signatures misses one in ten million. Links are confirmed on the sets.

Buckets of many members are never paired off. First a few bands link each member with one of
its bucket, which joins what is plainly alike. Then only different components need to meet:

* all pairs of a bucket of up to ``FEW`` members;
* in larger buckets of up to ``FEW`` components, the components, each pair of them once
  however many buckets they share: their signatures are compared in blocks;
* larger buckets whose documents fill up to ``PIECES`` blocks: their signatures are compared in
  blocks at once, which takes fewer rows than new signatures would;
* what meets in still larger buckets gets new, longer signatures (level 2), which part what is
  less alike. If there are such buckets again, their signatures are compared in blocks.

Blocks hold the sets as well: pairs whose signatures agree are confirmed there, the most alike
first, unless their components are joined by then. Only links that join components leave a
block, so what is emitted is linear, and nothing is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import EDGES, batches_of, components, mix, save, scratch, slices

U = np.uint64
#: Hash functions of the two levels: bands, and minima in each band.
BANDS, ROWS = 32, 4
BANDS_2, ROWS_2 = 128, 8
#: Bands that link first.
SKETCH = 6
#: Members, or components, of a bucket whose pairs are taken one by one.
FEW = 16
#: Of the first level's minima, so many must agree at a similarity of 0.8.
AGREE = 77
#: Documents of a block, and their shingles.
BLOCK, BLOCK_SHINGLES = 1000, 2_000_000
#: Blocks that a document of a large bucket goes to at most before longer signatures are made: in all
#: buckets together it makes no more rows than level 2 has bands.
PIECES = BANDS_2 // BANDS
#: Shingles hashed at once, bytes of texts at once, ids (two longs each) that are broadcast at most.
CHUNK, SMALL, BROADCAST_IDS = 4096, 8 << 20, 500_000


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    each = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(each)
    if not n:
        return np.empty(0, U)
    code = np.fromiter(map(xxh3_64_intdigest, each), U, n)
    size = min(words, n)
    h = np.full(n - size + 1, U(size))
    for i in range(size):
        h = mix(h) + code[i : n - size + 1 + i]
    return np.unique(mix(h))


def functions(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and summands of the universal functions of a level."""
    n = BANDS * ROWS if level == 1 else BANDS_2 * ROWS_2
    a, b = np.random.default_rng(level).integers(0, 2**64, (2, n), U, endpoint=False)
    return (a | U(1))[:, None], b[:, None]


def signature(s: np.ndarray, fns: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of the minimum of each function; the highest bits decide, the ones below are kept."""
    a, b = fns
    low = np.full(len(a), np.iinfo(U).max)
    for i in range(0, len(s), CHUNK):
        h = a * s[None, i : i + CHUNK]
        h += b
        np.minimum(low, h.min(1), out=low)
    return (low >> U(32)).astype(np.uint16)


def _keys(s: np.ndarray) -> tuple[int, int]:
    """Two checks of a set, by which exact copies are known."""
    if not len(s):
        return 0, 0
    return int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U).view(np.int64)), int(np.bitwise_xor.reduce(s).view(np.int64))


def _prints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fns = functions(1)
    for whole in batches:
        for b in slices(whole, SMALL):
            rows = []
            for t in b.column(1):
                s = shingles(t.as_py(), words)
                rows.append((len(s), *_keys(s), signature(s, fns).tobytes() if len(s) else None))
            n, k1, k2, sig = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])


BUCKETS = "key long, doc long, n long, comp long"


def _matrix(column: pa.Array | pd.Series, kind: type) -> np.ndarray:
    raw = column.to_pylist() if isinstance(column, pa.Array) else list(column)
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def _banded(sig: np.ndarray, rows: int) -> np.ndarray:
    """Keys of the bands of each signature."""
    part = sig.view(U).reshape(len(sig), -1, rows // 4)
    key = np.zeros(part.shape[:2], U) + np.arange(1, part.shape[1] + 1, dtype=U) * U(0x9E3779B97F4A7C15)
    for i in range(part.shape[2]):
        key = mix(key + part[:, :, i])
    return key.view(np.int64)


def _rows(keys: np.ndarray, b: pa.RecordBatch) -> pa.RecordBatch:
    each = [pa.array(np.repeat(b.column(c).to_numpy(), keys.shape[1])) for c in ("doc", "n", "comp")]
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *each], ["key", "doc", "n", "comp"])


def _bands(bands: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield _rows(_banded(_matrix(b.column("sig"), np.uint16)[:, : bands * ROWS].copy(), ROWS), b)


def _sets(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[np.ndarray]]]:
    """Slices of documents with their sets; a row whose text isn't the one its id is known by has none."""
    for whole in batches:
        for b in slices(whole, SMALL):
            keep, sets = [], []
            for i, (t, k1) in enumerate(zip(b.column("text"), b.column("k1").to_pylist(), strict=True)):
                s = shingles(t.as_py(), words)
                if _keys(s)[0] == k1:
                    keep.append(i)
                    sets.append(s)
            if keep:
                yield b.take(pa.array(keep)), sets


def _longer(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fns = functions(2)
    for b, sets in _sets(words, batches):
        yield _rows(_banded(np.stack([signature(s, fns) for s in sets]), ROWS_2), b)


def _tokens(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, sets in _sets(words, batches):
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc", "tokens"])


# -- pairs ----------------------------------------------------------------------------------


def _sizes_do(percent: int, n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _agree(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in enough places."""
    for b in batches:
        if b.num_rows:
            x, y = (_matrix(b.column(c), np.uint16) for c in ("siga", "sigb"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(1) >= least))


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirmed(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [alike(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in zip(b.column("tokensa"), b.column("tokensb"), strict=True)]
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


class _Joined:
    """Which nodes the edges seen so far connect."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (above := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(above, above)
            x = above
        return x

    def add(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs of a partition, those that connect what the ones before them don't."""
    seen = _Joined()
    for b in batches:
        yield b.filter(pa.array([seen.add(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_()))
        if len(seen.up) > EDGES:
            seen = _Joined()


def _compared(percent: int, least: int, df: pd.DataFrame) -> pd.DataFrame:
    """Links between the sides of a block that join components, found by signatures, confirmed on the sets.

    The most alike come first; pairs whose components are joined by then need no look, nor
    those that meet under a smaller key of a large bucket.
    """
    here, key = bool(df["kind"].iat[0]), int(df["arena"].iat[0])
    alone = here and df["i"].iat[0] == df["j"].iat[0]
    side = df["piece"] == df["j"] if here else df["right"]
    left, right = (df, df) if alone else (df[~side], df[side])
    links: list[tuple[int, int]] = []
    if len(left) and len(right):
        x, y = _matrix(left["sig"], np.uint16), _matrix(right["sig"], np.uint16)
        ids, n, comp, keys = (right[c].to_numpy() for c in ("doc", "n", "comp", "keys"))
        own_ids, own_n, own_comp, own_keys = (left[c].to_numpy() for c in ("doc", "n", "comp", "keys"))
        a, b, agree = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i in range(len(left)):
            ok = (comp != own_comp[i]) & (100 * np.minimum(n, own_n[i]) >= percent * np.maximum(n, own_n[i]))
            ok = np.flatnonzero(ok & (ids > own_ids[i]) if alone else ok)
            same = (y[ok] == x[i]).sum(1)
            ok, same = ok[same >= least], same[same >= least]
            a.append(np.full(len(ok), i))
            b.append(ok)
            agree.append(same)
        a, b, agree = map(np.concatenate, (a, b, agree))
        sets = [[np.frombuffer(t, U) for t in side["tokens"]] for side in (left, right)]
        smaller = [[frozenset(k for k in ks if k < key) if here else () for ks in side] for side in (own_keys, keys)]
        seen = _Joined()
        for k in np.argsort(-agree, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            c, d = int(own_comp[i]), int(comp[j])
            if seen.root(c) != seen.root(d) and not (here and not smaller[0][i].isdisjoint(smaller[1][j])) and alike(sets[0][i], sets[1][j], percent):
                seen.add(c, d)
                links.append((int(own_ids[i]), int(ids[j])))
    return pd.DataFrame({"a": [min(p) for p in links], "b": [max(p) for p in links]}, dtype="int64")


# -- the search -----------------------------------------------------------------------------


class _Search:
    """Links confirmed so far, and what is needed to find more. sigs: doc, n, k1, sig of each distinct set."""

    def __init__(self, docs: DataFrame, sigs: DataFrame, path: str, words: int, percent: int, few: int, block: int) -> None:
        self.docs, self.sigs, self.path = docs, sigs, path
        self.words, self.percent, self.few, self.block = words, percent, few, block
        self.least = AGREE if percent >= 80 else AGREE * percent // 80 - 8
        self.spark = docs.sparkSession
        self.links: DataFrame | None = None
        self.sets: DataFrame | None = None
        #: (doc, n, comp): the component that each set is in by the links so far.
        self.members = sigs.select("doc", "n", F.col("doc").alias("comp"))
        self.steps = 0

    def texts_of(self, ids: DataFrame, name: str) -> DataFrame:
        """Documents of the ids (doc, and a few numbers), with k1, which tells rows that share an id apart."""
        ids = save(ids, f"{self.path}/ids-{name}")
        few = ids.count() <= BROADCAST_IDS
        return self.docs.join(F.broadcast(ids) if few else ids, self.docs.doc_id == ids.doc).drop("doc_id")

    def beside(self, pairs: DataFrame, what: DataFrame, column: str) -> DataFrame:
        """Written pairs (a, b) with a column of both sides. Few ids go to its table, so that only their rows are shuffled."""
        ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
        few = pairs.count() <= BROADCAST_IDS // 2
        what = (what.join(F.broadcast(ids), "doc", "left_semi") if few else what).select("doc", column)
        for side in "ab":
            pairs = pairs.join(what.select(F.col("doc").alias(side), F.col(column).alias(column + side)), side)
        return pairs

    def confirm(self, pairs: DataFrame) -> None:
        """Add the candidates (a, b) that truly link."""
        self.steps += 1
        path = f"{self.path}/step-{self.steps}"
        pairs = save(pairs.distinct(), f"{path}/pairs")
        if pairs.isEmpty():
            return
        near = save(self.beside(pairs, self.sigs, "sig").mapInArrow(partial(_agree, self.least), "a long, b long"), f"{path}/near")
        # a forest of the pairs first; of the others, those that it leaves apart
        tree = save(near.coalesce(max(1, -(-near.count() // EDGES))).mapInArrow(_forest, "a long, b long"), f"{path}/tree")
        self._exact(tree, f"{path}/1")
        rest = self.beside(save(near.join(tree, ["a", "b"], "left_anti"), f"{path}/others"), self.members, "comp")
        self._exact(save(rest.where("compa <> compb").select("a", "b"), f"{path}/rest"), f"{path}/2")

    def _exact(self, pairs: DataFrame, path: str) -> None:
        """Add those of the written pairs whose sets are similar."""
        if pairs.isEmpty():
            return
        self._know(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), path)
        with batches_of(self.spark, 250):
            links = save(self.beside(pairs, self.sets, "tokens").mapInArrow(partial(_confirmed, self.percent), "a long, b long"), f"{path}/links")
        self._add(links, path)

    def _know(self, ids: DataFrame, path: str) -> None:
        """Write the sets of documents (doc) that aren't known yet."""
        if self.sets is not None:
            ids = ids.join(self.sets.select("doc"), "doc", "left_anti")
        texts = self.texts_of(ids.join(self.sigs.select("doc", "k1"), "doc"), path.replace(self.path, "").replace("/", "-"))
        with batches_of(self.spark, 2000):
            new = save(texts.mapInArrow(partial(_tokens, self.words), "doc long, tokens binary"), f"{path}/sets")
        counts = new.agg(F.count("*"), F.count_distinct("doc")).first()
        if counts[0] != counts[1]:  # only tables that repeat rows pay for telling them apart
            new = save(new.dropDuplicates(["doc"]), f"{path}/sets-once")
        self.sets = new if self.sets is None else self.sets.union(new)

    def _add(self, links: DataFrame, path: str) -> None:
        if links.isEmpty():
            return
        self.links = links if self.links is None else self.links.union(links)
        found = components(self.links, f"{path}/components")
        joined = self.sigs.select("doc", "n").join(found, F.col("doc") == F.col("node"), "left")
        self.members = save(joined.select("doc", "n", F.coalesce("component", "doc").alias("comp")), f"{path}/members")

    def buckets(self, rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Confirm the pairs of small buckets; pairs of components (a, b), and rows, of the others."""
        path = f"{self.path}/buckets-{name}"
        apart = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).where("low <> high")
        apart = save(apart.select("key", "m"), f"{path}/apart")
        inside = save(rows.join(apart, "key"), f"{path}/inside")
        few = F.col("m") <= self.few
        lists = inside.where(few).groupBy("key").agg(F.collect_list(F.struct("doc", "n", "comp")).alias("l"))
        partners = lambda x: F.filter("l", lambda y: (x["doc"] < y["doc"]) & (x["comp"] != y["comp"]) & _sizes_do(self.percent, x["n"], y["n"]))
        pairs = F.flatten(F.transform("l", lambda x: F.transform(partners(x), lambda y: F.struct(x["doc"].alias("a"), y["doc"].alias("b")))))
        self.confirm(lists.select(F.inline(pairs)))
        per = inside.where(~few).groupBy("key", "comp").count()
        kinds = save(per.groupBy("key").agg(F.count("*").alias("c")), f"{path}/kinds")
        some = per.join(kinds.where(F.col("c") <= self.few), "key").groupBy("key").agg(F.sort_array(F.collect_list("comp")).alias("l"))
        pairs = F.flatten(F.transform("l", lambda x: F.transform(F.filter("l", lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
        meet = save(some.select(F.inline(pairs)).distinct(), f"{path}/meet")
        large = save(inside.join(kinds.where(F.col("c") > self.few), "key", "left_semi").select("key", "doc", "n"), f"{path}/large")
        return meet, large

    def parted(self, large: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Rows of large buckets: of those that fill few blocks, and of the others."""
        sizes = large.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("of"))
        fits = (F.col("m") <= PIECES * self.block) & (F.col("of") <= PIECES * BLOCK_SHINGLES)
        beyond = save(sizes.where(~fits).select("key"), f"{self.path}/buckets-{name}/beyond")
        return large.join(beyond, "key", "left_anti"), large.join(beyond, "key", "left_semi")

    def between(self, meet: DataFrame, large: DataFrame) -> None:
        """Compare components that met (a, b: by any of their members) and all documents of large buckets (key, doc)."""
        path = f"{self.path}/blocks"
        of = self.members.select("doc", "comp")
        pairs = self.beside(meet, of, "comp").where("compa <> compb").select(F.least("compa", "compb").alias("a"), F.greatest("compa", "compb").alias("b")).distinct()
        pairs = save(pairs, f"{path}/apart")
        if pairs.isEmpty() and large.isEmpty():
            return
        sizes = self.members.groupBy(F.col("comp").alias("doc")).agg(F.count("*").alias("size"))
        pairs = save(self.beside(pairs, sizes, "size"), f"{path}/pairs")
        first = F.col("sizea") >= F.col("sizeb")
        pairs = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("arena"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("guest"), (F.col("sizea") * F.col("sizeb") <= self.few**2).alias("little"))
        doc = lambda name, key: self.members.select(F.col("comp").alias(key), F.col("doc").alias(name), F.col("n").alias("n" + name))
        one_by_one = pairs.where("little").join(doc("x", "arena"), "arena").join(doc("y", "guest"), "guest").where(_sizes_do(self.percent, F.col("nx"), F.col("ny")))
        little = save(one_by_one.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), f"{path}/little")
        sides = pairs.where("not little").select(F.lit(0).alias("kind"), "arena", F.col("arena").alias("comp"), F.lit(False).alias("right")).distinct()
        sides = sides.union(pairs.where("not little").select(F.lit(0), "arena", "guest", F.lit(True))).join(self.members, "comp").select("kind", "arena", "right", "doc", "n")
        sides = save(sides.union(large.select(F.lit(1), "key", F.lit(False), "doc", "n")), f"{path}/sides")
        self.confirm(little)
        if sides.isEmpty():
            return
        docs = save(sides.select("doc").distinct(), f"{path}/docs")
        self._know(docs, path)
        many = lambda r: F.greatest(F.sum((F.col("right") == r).cast("int")) / self.block, F.sum(F.when(F.col("right") == r, F.col("n"))) / BLOCK_SHINGLES)
        blocks = sides.groupBy("kind", "arena").agg(*[F.ceil(many(r)).cast("int").alias(n) for n, r in (("lefts", False), ("rights", True))])
        rows = sides.join(blocks, ["kind", "arena"])
        own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
        # the pieces of a large bucket meet in pairs, those of two components each with all of the other's
        within = F.transform(every("lefts"), lambda o: cell(F.least(own("lefts"), o), F.greatest(own("lefts"), o)))
        across = F.when(F.col("right"), F.transform(every("lefts"), lambda i: cell(i, own("rights")))).otherwise(F.transform(every("rights"), lambda j: cell(own("lefts"), j)))
        rows = rows.select("kind", "arena", "right", own("lefts").alias("piece"), "doc", "n", F.inline(F.when(F.col("kind") == 1, within).otherwise(across)))
        # the keys of large buckets that a document is in: a few hundred at most, one for each band
        keys = large.groupBy("doc").agg(F.collect_set("key").alias("keys"))
        held = docs.join(self.members.select("doc", "comp"), "doc").join(self.sigs.select("doc", "sig"), "doc").join(self.sets, "doc").join(keys, "doc", "left")
        with batches_of(self.spark, 500):
            links = save(rows.join(held, "doc").groupBy("kind", "arena", "i", "j").applyInPandas(partial(_compared, self.percent, self.least), "a long, b long"), f"{path}/links")
        self._add(links, f"{path}/after")


def minhash_components(docs: DataFrame, words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", few: int = FEW, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Two documents link when their sets of distinct shingles of ``words`` words have a
    Jaccard similarity of ``percent`` hundredths or more; a text with fewer words is one
    shingle. component_id is the smallest doc_id that links reach, kept whether it is the
    document's own. Links are confirmed on whole sets; a pair at the threshold is missed with a
    probability below 1e-6, more alike ones less; percent below 80 compares more
    signatures. Null and empty texts have no shingles and are linked with nothing.

    Rows with a null id are returned with a null component and are kept. Repeated rows are
    returned as often as they come; of rows that share an id but not a text, each has its
    own n_shingles and all have the links of the one with the smallest set key. An empty
    table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch(spark, "minhash")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = save(docs.mapInArrow(partial(_prints, words), "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), f"{path}/prints")
    known = prints.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n_shingles", "sig")).alias("x"))
    known = save(known.select(F.col("doc_id").alias("doc"), "x.k1", "x.k2", F.col("x.n_shingles").alias("n"), "x.sig"), f"{path}/known")
    copies = known.groupBy("k1", "k2", "n").agg(F.min("doc").alias("one"))
    classes = save(known.join(copies, ["k1", "k2", "n"]).select("doc", "one"), f"{path}/classes")
    sigs = save(known.join(copies.select("one"), F.col("doc") == F.col("one"), "left_semi").select("doc", "n", "k1", "sig"), f"{path}/sigs")
    search = _Search(docs, sigs, path, words, percent, few, block)

    # plainly alike sets: each member of a bucket with one of it, another one in each bucket
    rows = sigs.withColumn("comp", F.col("doc")).mapInArrow(partial(_bands, SKETCH), BUCKETS)
    head = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc", "key").alias("chance"), F.col("doc").alias("head"), F.col("n").alias("m"))).alias("h"), F.count("*").alias("holders"))
    both = rows.join(head.where("holders > 1").select("key", "h.head", "h.m"), "key").where((F.col("doc") != F.col("head")) & _sizes_do(percent, F.col("n"), F.col("m")))
    search.confirm(both.select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")))

    of = search.members.select("doc", "comp")
    meet, large = search.buckets(sigs.join(of, "doc").mapInArrow(partial(_bands, BANDS), BUCKETS), "1")
    large, beyond = search.parted(large, "1")
    if not beyond.isEmpty():
        ids = beyond.select("doc").distinct().join(sigs.select("doc", "k1"), "doc").join(search.members, "doc")
        texts = search.texts_of(ids.select("doc", "k1", "n", "comp"), "longer")
        level2 = texts.mapInArrow(partial(_longer, words), BUCKETS).distinct()
        more, again = search.buckets(save(level2, f"{path}/level-2"), "2")
        meet = save(meet.union(more), f"{path}/meet")
        large = save(large.union(again), f"{path}/large")
    search.between(meet, large)

    of = classes.join(search.members.select(F.col("doc").alias("one"), "comp"), "one").select(F.col("doc").alias("id"), F.col("comp"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    out = prints.join(of, prints.doc_id == of.id, "left").select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
