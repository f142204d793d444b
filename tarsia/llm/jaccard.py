"""Exact set-similarity self-join on word shingles by universe partition.

Two sets of sizes l <= s with Jaccard similarity of at least 3/4 differ in at most
H = (l + s) // 7 tokens. Tokens are hashed into m segments, m fixed by the band that the
smaller size lies in. What each segment is worth (0: skip, 1: exact, 2: exact or one token
more or less) is allocated by cost; similar sets meet where the worth passes H:

* First the few smallest tokens of each set link what is plainly alike. This decides
  nothing, but from then on only sets of different components need to meet.
* Round 1 gives 1 to the first H + 1 + slack segments that aren't empty, in the order of
  their numbers, and 0 to the others. Of two similar sets, the one that stops first agrees
  with the other on slack + 1 of its segments or more. Segments held by many documents are
  frequent; a document is open if it has more of them than its slack.
* Round 2 takes open documents alone. Frequent segments get 0, the cheapest others get 2
  until the sum passes H again; one-deletion neighbourhoods are indexed.
* Round 3 takes the documents that round 2 could not settle. Each token is a segment of
  its own. Similar documents either share an infrequent token, or together have at most
  H infrequent tokens; those are compared across the components found until then.

Of frequent segments, one document of each component is joined to the head of the bucket,
so rows stay linear in the input. Every candidate is verified: first by a bitmap of token-count parities, which
bounds the symmetric difference from below, then on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import EDGES, batches_of, components, mix, partitions_for, save, scratch, slices

WORDS = 5
#: A bucket of more members is frequent.
FREQUENT = 16
#: Signatures that one partition handles at once, and that it has at least if there are several:
#: a document has a row for each partition in which it is marked or paired.
PARTITION_ROWS, PARTITION_LEAST = 1_500_000, 100_000
#: Smallest tokens by which plainly alike sets are linked first.
SKETCH = 6
U = np.uint64

#: Bands of sizes, each twice as wide as the one before: 3 to 5, 6 to 11, ...
LOW = 3 << np.arange(31, dtype=np.int64)
HIGH = 2 * LOW - 1
SEGMENTS = -(-HIGH * 45 // 100) + 6
SLACK = 2 + HIGH // 64


def band_of(size: int) -> int:
    return (size // 3).bit_length() - 1


def may_differ(size: int, band: int, lower: int) -> int:
    """By how many tokens a set may differ from a similar one whose smaller size lies in the band."""
    return (size + (min(size, int(HIGH[band])) if lower else 4 * size // 3)) // 7


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, U)
    code = np.fromiter(map(xxh3_64_intdigest, words), U, n)
    if n < WORDS:
        out = U(n)
        for c in code:
            out = mix(np.array([out], U))[0] ^ c
        return mix(np.array([out], U))
    h = np.zeros(n - WORDS + 1, U)
    for i in range(WORDS):
        h = h * U(0x9E3779B97F4A7C15) + code[i : n - WORDS + 1 + i]
    return np.unique(mix(h))


def _set_key(s: np.ndarray) -> int:
    return int((mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U) ^ U(len(s))).view(np.int64)) if len(s) else 0


# -- what is kept of each set -------------------------------------------------------------

PRINTS = "doc_id long, n_shingles long, k1 long, k2 long, sketch array<long>, bits binary"


def _parities(s: np.ndarray) -> bytes:
    wide = max(64, 1 << (len(s) - 1).bit_length())
    odd = np.bincount((s & U(wide - 1)).astype(np.int64), minlength=wide) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole):
            cols: list[list] = [[] for _ in range(5)]
            for t in b.column(1):
                s = shingles(t.as_py())
                check = int(np.bitwise_xor.reduce(s).view(np.int64)) if len(s) else 0
                for col, v in zip(cols, (len(s), _set_key(s), check, s[:SKETCH].view(np.int64), _parities(s) if len(s) > 2 else None), strict=True):
                    col.append(v)
            long = pa.int64()
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, long) for c in cols[:3]), pa.array(cols[3], pa.list_(long)), pa.array(cols[4], pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sketch", "bits"])


# -- round 1: signatures of segments ----------------------------------------------------------


def _parts(s: np.ndarray, band: int, most: int | None = None):
    """Number, start, token count and sum of token hashes of the (first) segments that aren't empty; the token hashes in segment order."""
    m = int(SEGMENTS[band])
    h = mix(s + U((band + 1) * 0x632BE59BD9B4E019 & (2**64 - 1)))
    seg = (h % U(m)).astype(np.uint16 if m < 65536 else np.uint32)
    order = np.argsort(seg, kind="stable")
    seg = seg[order]
    start = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    if most is not None and len(start) > most:
        order, seg, start = order[: start[most]], seg[: start[most]], start[:most]
    h = mix(h[order] ^ U(0xD6E8FEB86659FD93))
    return seg[start].astype(U), start, np.diff(np.r_[start, len(seg)]), np.add.reduceat(h, start), h


def _sign(total: np.ndarray, seg: np.ndarray, band: int) -> np.ndarray:
    return mix(total + seg * U(0x9E3779B97F4A7C15) + U(band * 0xC2B2AE3D27D4EB4F & (2**64 - 1)))


FOUND = "kind int, a long, b long, s binary"
FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("s", pa.binary())])
OUT = f"p int, data binary, {FOUND}"
OUT_ARROW = pa.schema([("p", pa.int32()), ("data", pa.binary()), *FOUND_ARROW])
#: PAIR: a and b may be similar. MARK: document a, role b, its frequent signatures s.
#: SHORT: document a, role and slack in b: it has fewer segments than it should.
PAIR, MARK, SHORT = 0, 1, 2
# flags of a signature
DELETION, LOWER, CHOSEN = 1, 2, 4


def _planes(x: np.ndarray) -> bytes:
    """The bytes of all values by significance, which compresses small and similar ones."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _values(raw: bytes, at: int, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()


class _Block:
    """The signatures of up to 8,000 documents, dealt to partitions as packed columns:
    signature (32 bits), document, distance from its component's name, size (logarithm), flags."""

    def __init__(self, parts: int) -> None:
        self.parts = parts
        self.clear()

    def clear(self) -> None:
        self.ids: list[int] = []
        self.comps: list[int] = []
        self.codes: list[int] = []
        self.sig: list[np.ndarray] = []
        self.idx: list[np.ndarray] = []
        self.flags: list[np.ndarray] = []
        self.rows = 0

    def place(self, doc: int, comp: int, size: int) -> None:
        self.ids.append(doc)
        self.comps.append(comp)
        self.codes.append(size_code(size))

    def add(self, sig: np.ndarray, flags: int) -> None:
        """Signatures of the document placed last."""
        self.sig.append(sig)
        self.idx.append(np.full(len(sig), len(self.ids) - 1, np.uint16))
        self.flags.append(np.full(len(sig), flags, np.uint8))
        self.rows += len(sig)

    def full(self) -> bool:
        return len(self.ids) >= 8000 or self.rows >= 2_000_000

    def flush(self, said: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if self.rows:
            sig, idx, flags = map(np.concatenate, (self.sig, self.idx, self.flags))
            part = ((sig >> U(40)) % U(self.parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            sig, idx, flags, part = sig[order].astype(np.uint32), idx[order], flags[order], part[order]
            ids, comps, codes = np.array(self.ids, np.int64), np.array(self.comps, np.int64), np.array(self.codes, np.uint8)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            data = []
            for lo, hi in zip(cut, np.r_[cut[1:], len(part)], strict=True):
                at = idx[lo:hi]
                data.append(b"".join((sig[lo:hi].tobytes(), _planes(ids[at]), _planes(ids[at] - comps[at]), codes[at].tobytes(), flags[lo:hi].tobytes())))
            n = len(data)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(data, pa.binary()), pa.nulls(n, pa.int32()), none, none, pa.nulls(n, pa.binary())], schema=OUT_ARROW)
        if said:
            kind, a, b = (list(c) for c in zip(*said, strict=True))
            n = len(said)
            yield pa.RecordBatch.from_arrays([pa.array([x % self.parts for x in a], pa.int32()), pa.nulls(n, pa.binary()), pa.array(kind, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.binary())], schema=OUT_ARROW)
        said.clear()
        self.clear()


ROW = 4 + 8 + 8 + 1 + 1


def size_code(size: int) -> int:
    """Eighths of the size's binary logarithm."""
    return int(8 * np.log2(size))


#: Similar sets' sizes are as 3 to 4 at most, their codes this far apart.
APART = 4


def _emitted(size: int) -> list[tuple[int, int]]:
    """The bands a set is looked up in: its own, and the one below if partners may lie there."""
    if size < 3:
        return []
    own = band_of(size)
    return [(own, 0)] + ([(own - 1, LOWER)] if own and -(-3 * size // 4) < LOW[own] else [])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray]]:
    """Documents with their sets, but for rows that share an id with another set."""
    for batch in batches:
        rest = batch.drop_columns(["text"]).to_pylist()
        for row, text in zip(rest, batch.column("text"), strict=True):
            s = shingles(text.as_py())
            if _set_key(s) == row["k1"]:
                yield row, s


def _round1(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, said = _Block(parts), []
    for row, s in _rows(batches):
        n = len(s)
        if n < 3:
            continue
        block.place(row["doc_id"], row["comp"], n)
        for band, lower in _emitted(n):
            least = may_differ(n, band, lower) + 1
            seg, _, _, total, _ = _parts(s, band, least + int(SLACK[band]))
            block.add(_sign(total, seg, band), lower)
            if len(seg) < least + SLACK[band]:
                said.append((SHORT, row["doc_id"], lower // LOWER + 2 * max(0, len(seg) - least + 1)))
        if block.full():
            yield from block.flush(said)
    yield from block.flush(said)


def _runs(by_choice: bool, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Candidates and marks of one partition's signatures.

    by_choice: frequent signatures mark the documents that have chosen them (round 2), else all.
    """
    if not blobs:
        return
    sig, doc, comp, size, flag = [], [], [], [], []
    for raw in blobs:
        n = len(raw) // ROW
        sig.append(np.frombuffer(raw, np.uint32, n))
        ids = _values(raw, 4 * n, n)
        doc.append(ids)
        comp.append(ids - _values(raw, 12 * n, n))
        size.append(np.frombuffer(raw, np.uint8, n, 20 * n))
        flag.append(np.frombuffer(raw, np.uint8, n, 21 * n))
    cols = [np.concatenate(c) for c in (sig, doc, comp, size, flag)]

    def only(keep: np.ndarray) -> None:
        cols[:] = [c[keep] for c in cols]

    def bounds() -> tuple[np.ndarray, np.ndarray]:
        start = np.flatnonzero(np.r_[True, cols[0][1:] != cols[0][:-1]])
        return start, np.diff(np.r_[start, len(cols[0])])

    only(np.argsort(cols[0], kind="stable"))
    start, length = bounds()
    # what lies in one component need not meet
    other = np.minimum.reduceat(cols[2], start) != np.maximum.reduceat(cols[2], start)
    exact = np.minimum.reduceat(cols[4] & DELETION, start) == 0
    only(np.repeat(other & exact, length))
    if not len(cols[0]):
        return
    only(np.lexsort((cols[4], cols[1], cols[3], cols[0])))
    # repeated rows of a document
    sig, doc, comp, size, flag = cols
    only(np.r_[True, (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]) | (flag[1:] != flag[:-1])])
    sig, doc, comp, size, flag = cols
    start, length = bounds()
    run = np.repeat(np.arange(len(start)), length)
    frequent = (length > FREQUENT)[run]
    size = size.astype(np.int64)
    left, right = [], []

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        ok = (size[j] - size[i] <= APART) & (comp[i] != comp[j]) & ((flag[i] & flag[j] & (LOWER | DELETION)) == 0)
        left.append(doc[i[ok]])
        right.append(doc[j[ok]])

    few = np.flatnonzero(~frequent)
    for d in range(1, FREQUENT):
        i = few[: len(few) - d] if d < len(few) else few[:0]
        i = i[(i + d < len(sig))]
        i = i[run[i + d] == run[i]]
        if not len(i):
            break
        meet(i, i + d)
    often = np.flatnonzero(frequent)
    if len(often):
        # one of each component and the first of the run whose size may do, all in the run being sorted by size
        order = np.lexsort((comp[often], run[often]))
        one = often[order]
        one = one[np.r_[True, (run[one][1:] != run[one][:-1]) | (comp[one][1:] != comp[one][:-1])]]
        meet(np.searchsorted(run * 256 + size, run[one] * 256 + np.maximum(size[one] - APART, 0)), one)
        said = often[(flag[often] & CHOSEN) > 0] if by_choice else often
        if len(said):
            role = (flag[said] & LOWER) > 0
            order = np.lexsort((role, doc[said]))
            said, role = said[order], role[order]
            cut = np.flatnonzero(np.r_[True, (doc[said][1:] != doc[said][:-1]) | (role[1:] != role[:-1])])
            n = len(cut)
            sigs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((4 * np.r_[cut, len(said)]).astype(np.int32)), pa.py_buffer(sig[said])])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, MARK, np.int32)), pa.array(doc[said[cut]]), pa.array(role[cut].astype(np.int64)), sigs], schema=FOUND_ARROW)
    a, b = np.concatenate(left), np.concatenate(right)
    if len(a):
        a, b = np.minimum(a, b), np.maximum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[new], b[new]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(a), pa.array(b), pa.nulls(len(a), pa.binary())], schema=FOUND_ARROW)


def _meet(by_choice: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by p; each p is handled by itself."""
    now, blobs = None, []
    for batch in batches:
        said = batch.filter(batch.column("kind").is_valid()).select(FOUND_ARROW.names)
        if said.num_rows:
            yield said
        for p, data in zip(batch.column("p").to_pylist(), batch.column("data"), strict=True):
            if p != now:
                yield from _runs(by_choice, blobs)
                now, blobs = p, []
            if data.is_valid:
                blobs.append(data.as_py())
    yield from _runs(by_choice, blobs)


# -- round 2: one-deletion neighbourhoods ----------------------------------------------


def _round2(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: doc_id, text, k1, comp, and for its own and the lower band the frequent signatures (null: settled)."""
    block, said = _Block(parts), []
    for row, s in _rows(batches):
        n = len(s)
        block.place(row["doc_id"], row["comp"], n)
        for band, lower in _emitted(n):
            bad = row["lower" if lower else "own"]
            if bad is None:
                continue
            seg, start, count, total, h = _parts(s, band)
            sig = _sign(total, seg, band)
            frequent = np.isin(sig.astype(np.uint32), np.frombuffer(b"".join(bad), np.uint32))
            need = may_differ(n, band, lower) + 1 - int((~frequent).sum())
            # a pair of tokens leaves single tokens, which many sets hold
            cost = np.where(frequent | (count < 2), 1 << 40, count * np.where(count == 2, 8, 1))
            order = np.argsort(cost, kind="stable")[: max(need, 0)]
            settled = need <= 0 or (len(order) == need and bool((cost[order] < 1 << 40).all()))
            if not settled:
                said.append((MARK, row["doc_id"], 0))
            chosen = np.zeros(len(seg), bool)
            chosen[order] = settled
            own = np.repeat(np.arange(len(seg)), count)
            drop = _sign(total[own] - h, seg[own], band)
            # what the document counts on is chosen; the rest is what a partner may count on
            exact = ~frequent & settled
            rest = (count[own] > 2) & ~chosen[own]
            block.add(sig[~exact], lower)
            block.add(sig[exact], lower | CHOSEN)
            block.add(drop[rest], lower | DELETION)
            block.add(drop[chosen[own]], lower | CHOSEN | DELETION)
        if block.full():
            yield from block.flush(said)
    yield from block.flush(said)


# -- round 3: each token by itself -------------------------------------------------------


def _round3(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = _Block(parts)
    for row, s in _rows(batches):
        block.place(row["doc_id"], row["comp"], len(s))
        block.add(mix(s ^ U(0xA0761D6478BD642F)), 0)
        if block.full():
            yield from block.flush([])
    yield from block.flush([])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The quarter of a set that must hold a shared token if three quarters are shared."""
    for whole in batches:
        for b in slices(whole, SMALL):
            doc, tok = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row, s in _rows(iter([b])):
                s = mix(s ^ U(0xA0761D6478BD642F))
                s.sort()
                s = s[: len(s) - -(-3 * len(s) // 4) + 1]
                doc.append(np.full(len(s), row["doc_id"], np.int64))
                tok.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(doc)), pa.array(np.concatenate(tok))], ["doc", "tok"])


def _compared(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks that join components.

    Sizes, infrequent tokens and parities rule pairs out, the sets decide. Pairs whose
    components are joined by then need no look.
    """
    up: dict[int, int] = {}

    def root(c: int) -> int:
        while (above := up.get(c, c)) != c:
            up[c] = up.get(above, above)
            c = above
        return c

    links: list[tuple[int, int]] = []
    x = x.assign(wide=x["bits"].map(len))
    y = y.assign(wide=y["bits"].map(len))
    for wide_x, left in x.groupby("wide"):
        for wide_y, right in y.groupby("wide"):
            if not wide_x // 2 <= wide_y <= 2 * wide_x:
                continue
            wide = min(wide_x, wide_y)
            bits = []
            for part, has in ((left, wide_x), (right, wide_y)):
                m = np.frombuffer(b"".join(part["bits"]), np.uint8).reshape(len(part), has)
                bits.append((m[:, :wide] ^ m[:, wide:] if has > wide else m).view(np.uint64))
            n, r, c = (right[k].to_numpy() for k in ("n", "rare", "c"))
            for i, (na, ra, ca, da, ta) in enumerate(zip(left["n"], left["rare"], left["c"], left["doc"], left["tokens"], strict=True)):
                most = (na + n) // 7
                ok = np.flatnonzero((ca != c) & (4 * np.minimum(na, n) >= 3 * np.maximum(na, n)) & (ra + r <= most))
                if len(ok):
                    ok = ok[np.bitwise_count(bits[1][ok] ^ bits[0][i]).sum(1) <= most[ok]]
                for j in ok.tolist():
                    ra_, rb_ = root(int(ca)), root(int(c[j]))
                    if ra_ != rb_ and _alike(np.frombuffer(ta, U), np.frombuffer(right["tokens"].iat[j], U)):
                        up[max(ra_, rb_)] = min(ra_, rb_)
                        links.append((int(da), int(right["doc"].iat[j])))
    return pd.DataFrame({"a": [min(p) for p in links], "b": [max(p) for p in links]}, dtype="int64")


def _alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Exactly: whether two sorted sets of distinct tokens have a similarity of 0.75 or more."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 75 * (len(x) + len(y) - common)


#: Documents, and tokens, of a block of round 3.
BLOCK, BLOCK_TOKENS = 1000, 1_000_000


def _across(few: DataFrame, texts_of: Texts, bits: DataFrame, path: str) -> DataFrame:
    """Links among mostly frequent documents (doc_id, n, rare, c) that lie in different components c.

    Documents that share one of the tokens of which similar ones must share one form a
    family. A family's components are cut into blocks, small ones together; blocks of one
    and the same component needn't meet, others are compared pair by pair.
    """
    spark = few.sparkSession
    texts = texts_of(few.select("doc_id"), "across")
    tokens = save(texts.mapInArrow(_tokens, "doc long, tok long").distinct(), f"{path}/tokens")
    low = tokens.groupBy("tok").agg(F.min("doc").alias("b"))
    family = components(tokens.join(low, "tok").select(F.col("doc").alias("a"), "b").distinct(), f"{path}/families")
    sets = save(_sets_of(texts, f"{path}/sets").join(bits.select("doc", "bits"), "doc"), f"{path}/both")
    rows = few.join(family, few.doc_id == family.node).select(F.col("doc_id").alias("doc"), "n", "rare", "c", F.col("component").alias("family"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    sizes = rows.groupBy("family", "c").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).withColumn("blocks", blocks)
    large = F.col("blocks") > 1
    small = sizes.groupBy("family").agg(F.sum(F.when(~large, F.col("members"))).alias("members"), F.sum(F.when(~large, F.col("tokens"))).alias("tokens"), F.count("*").alias("parts")).where("parts > 1")
    rows = rows.join(sizes.select("family", "c", F.col("blocks").alias("blocks")).join(small.select("family", blocks.alias("loose")), "family"), ["family", "c"])
    own = F.when(large, F.col("c")).otherwise(-1)
    dealt = F.when(large, F.pmod(F.xxhash64("doc"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("c"), F.col("loose")))
    rows = save(rows.select("doc", "n", "rare", "c", "family", own.alias("own"), dealt.cast("long").alias("k")), f"{path}/rows")
    parts = rows.select("family", "own", "k").distinct()
    x, y = parts.alias("x"), parts.alias("y")
    meet = x.join(y, F.expr("x.family = y.family and struct(x.own, x.k) <= struct(y.own, y.k) and (x.own < 0 or x.own <> y.own)"))
    meet = save(meet.select(F.col("x.family").alias("family"), F.col("x.own").alias("o1"), F.col("x.k").alias("k1"), F.col("y.own").alias("o2"), F.col("y.k").alias("k2")), f"{path}/meet")
    keys = ["family", "o1", "k1", "o2", "k2"]

    def side(i: int) -> DataFrame:
        # read anew for each side, so that their columns are told apart
        r, b, m = (spark.read.schema(t.schema).parquet(f"{path}/{n}") for t, n in ((rows, "rows"), (sets, "both"), (meet, "meet")))
        at = ["family", f"o{i}", f"k{i}"]
        return r.join(b, "doc").withColumnsRenamed({"own": at[1], "k": at[2]}).join(m, at)

    left, right = side(1), side(2)
    with batches_of(spark, 250):
        return save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compared, "a long, b long"), f"{path}/links")


# -- verification --------------------------------------------------------------------------

SMALL = 8 << 20
SETS = "doc long, tokens binary"


def _tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, SMALL):
            rows = [(row["doc_id"], s.tobytes()) for row, s in _rows(iter([b]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc", "tokens"])


def _sets_of(texts: DataFrame, path: str) -> DataFrame:
    """(doc, tokens), one row a document."""
    spark = texts.sparkSession
    with batches_of(spark, 2000):
        sets = save(texts.mapInArrow(_tokens_of, SETS), path)
    # only tables that repeat rows pay for telling them apart
    counts = sets.agg(F.count("*"), F.count_distinct("doc")).first()
    return sets if counts[0] == counts[1] else save(sets.dropDuplicates(["doc"]), f"{path}-once")


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parity bitmaps differ in no more places than similar sets may."""
    for b in batches:
        keep = []
        for i, (na, nb, xa, xb) in enumerate(zip(b.column("na").to_pylist(), b.column("nb").to_pylist(), b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True)):
            x, y = int.from_bytes(xa, "little"), int.from_bytes(xb, "little")
            lx, ly = 8 * len(xa), 8 * len(xb)
            while lx > ly:
                lx //= 2
                x = (x >> lx) ^ (x & (1 << lx) - 1)
            while ly > lx:
                ly //= 2
                y = (y >> ly) ^ (y & (1 << ly) - 1)
            if (x ^ y).bit_count() <= (na + nb) // 7:
                keep.append(i)
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = [i for i, (x, y) in enumerate(zip(b.column("xa"), b.column("xb"), strict=True)) if _alike(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U))]
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a chunk of pairs, those that connect what the ones before them don't."""
    up: dict[int, int] = {}
    for b in batches:
        keep = []
        for i, (x, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            for end in (x, y):
                while (above := up.get(end, end)) != end:
                    up[end] = up.get(above, above)
                    end = above
                x, y = y, end
            if x != y:
                up[max(x, y)] = min(x, y)
                keep.append(i)
        if len(up) > EDGES:
            up.clear()
        yield b.take(pa.array(keep, pa.int64()))


#: Ids and what goes with them are broadcast up to so many bytes; beyond it they are joined by a shuffle.
BROADCAST_BYTES = 16 << 20


def _bytes(rows: DataFrame) -> int:
    """Of values: eight for a number, the length of what arrays hold."""
    each = [F.aggregate(F.coalesce(c, F.array().cast("array<binary>")), F.lit(8), lambda n, s: n + 8 + F.length(s)) if kind.startswith("array") else F.lit(8) for c, kind in rows.dtypes]
    return int(rows.agg(F.sum(sum(each[1:], each[0]).cast("long"))).first()[0] or 0)


#: From ids (doc_id and more columns) and a name for their table to those documents with their texts.
Texts = Callable[[DataFrame, str], DataFrame]


def _texts_of(docs: DataFrame, reps: DataFrame, path: str) -> Texts:
    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """Few ids go to the texts, not the texts to them."""
        ids = save(ids.join(reps.select("doc_id", "k1"), "doc_id"), f"{path}/ids-{name}")
        return docs.join(F.broadcast(ids) if _bytes(ids) <= BROADCAST_BYTES else ids, "doc_id")

    return texts_of


def _verified(pairs: DataFrame, bits: DataFrame, texts_of: Texts, known: DataFrame | None, path: str) -> tuple[DataFrame, DataFrame]:
    """The candidate pairs (a, b) that truly link, and all sets known by now."""
    spark = pairs.sparkSession
    pairs = save(pairs.distinct(), f"{path}/pairs")

    def beside(p: DataFrame, what: DataFrame, column: str, more: tuple[str, ...] = ()) -> DataFrame:
        for side in "ab":
            p = p.join(what.select(F.col("doc").alias(side), F.col(column).alias("x" + side), *[F.col(c).alias(c + side) for c in more]), side)
        return p

    near = save(beside(pairs, bits, "bits", ("n",)).mapInArrow(_near, "a long, b long"), f"{path}/near")
    ids = near.select(F.col("a").alias("doc")).union(near.select("b")).distinct()
    if known is not None:
        ids = ids.join(known.select("doc"), "doc", "left_anti")
    sets = _sets_of(texts_of(ids.select(F.col("doc").alias("doc_id")), path.rsplit("/", 1)[1]), f"{path}/sets")
    sets = sets if known is None else known.union(sets)

    def exact(p: DataFrame, name: str) -> DataFrame:
        with batches_of(spark, 250):
            return save(beside(p, sets, "tokens").mapInArrow(_linked, "a long, b long"), f"{path}/{name}")

    # a forest of the pairs first; of the others, those that it leaves unconnected
    tree = save(near.coalesce(max(1, -(-near.count() // EDGES))).mapInArrow(_trees, "a long, b long"), f"{path}/tree")
    links = exact(tree, "links-1")
    found = components(links, f"{path}/c")
    rest = near.join(tree, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(found.select(F.col("node").alias(side), F.col("component").alias("c" + side)), side, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    return links.union(exact(rest, "links-2")), sets


# -- links of each document -------------------------------------------------------------------


def _partners(x: list[np.ndarray], y: list[np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of y each set of x links with, and the reverse; without y, how many others of x."""
    sides = [x] if y is None else [x, y]
    size = [np.array([len(s) for s in side], np.int64) for side in sides]
    both = [s for side in sides for s in side]
    row = np.repeat(np.arange(len(both)), np.concatenate(size))
    _, tok, held = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    row, tok = row[held[tok] > 1], tok[held[tok] > 1]
    # tokens of many sets by matrix product, those of few by the lists of their sets
    often = held * 16 >= len(both)
    place = np.cumsum(often) - 1
    dense = np.zeros((len(both), int(often.sum())), np.float32)
    dense[row[often[tok]], place[tok[often[tok]]]] = 1
    row, tok = row[~often[tok]], tok[~often[tok]]
    first = 0 if y is None else len(x)
    right = row >= first
    order = np.argsort(tok[right], kind="stable")
    r_row, r_tok = row[right][order] - first, tok[right][order]
    n_y = size[-1]
    of_x, of_y = np.zeros(len(x), np.int64), np.zeros(len(n_y), np.int64)
    for at in range(0, len(x), 256):
        to = min(at + 256, len(x))
        common = (dense[at:to] @ dense[first:].T).astype(np.int64)
        lo, hi = np.searchsorted(row, (at, to))
        start, end = np.searchsorted(r_tok, tok[lo:hi]), np.searchsorted(r_tok, tok[lo:hi], side="right")
        n = end - start
        if n.sum():
            j = r_row[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
            common += np.bincount(np.repeat(row[lo:hi] - at, n) * len(n_y) + j, minlength=common.size).reshape(common.shape)
        linked = 100 * common >= 75 * (size[0][at:to, None] + n_y[None] - common)
        if y is None:
            linked[np.arange(to - at), np.arange(at, to)] = False
        of_x[at:to] = linked.sum(1)
        of_y += linked.sum(0)
    return of_x, of_y


def _counted(df: pd.DataFrame) -> pd.DataFrame:
    """Links of each document within its component, of those between the blocks i and j."""
    df = df.drop_duplicates("doc")
    c, doc, k = (df[n].to_numpy() for n in ("component", "doc", "k"))
    sets = [np.frombuffer(t, U) for t in df["tokens"]]
    i, j = int(df["i"].iat[0]), int(df["j"].iat[0])
    order = np.argsort(c, kind="stable")
    cut = np.flatnonzero(np.r_[True, c[order][1:] != c[order][:-1]])
    n = np.zeros(len(df), np.int64)
    for lo, hi in zip(cut, np.r_[cut[1:], len(df)], strict=True):
        rows = order[lo:hi]
        if len(rows) == 2:
            n[rows] = _alike(sets[rows[0]], sets[rows[1]])
        elif i == j:
            n[rows] = _partners([sets[r] for r in rows], None)[0]
        elif len(x := rows[k[rows] == i]) and len(y := rows[k[rows] == j]):
            n[x], n[y] = _partners([sets[r] for r in x], [sets[r] for r in y])
    return pd.DataFrame({"doc": doc, "n": n})


def _degrees(members: DataFrame, sets: DataFrame, path: str) -> DataFrame:
    """(class_id, n_links) of all classes (doc, component, n) that link with others.

    Links lie within components. Small components are compared whole, many at once; large
    ones are cut into blocks, and every two blocks of a component meet. Only counts leave
    a comparison, no pairs.
    """
    members = save(members, f"{path}/members")
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    sizes = members.groupBy("component").agg(F.count("*").alias("members"), F.sum("n").alias("tokens")).withColumn("blocks", blocks)
    bins = max(1, -(-int(members.agg(F.sum("n")).first()[0] or 0) // BLOCK_TOKENS))
    large = F.col("blocks") > 1
    home = F.when(large, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(bins)))
    k = F.when(large, F.pmod(F.xxhash64("doc"), F.col("blocks"))).otherwise(0)
    dealt = save(members.join(sizes, "component").select("doc", "component", large.alias("large"), home.alias("home"), k.cast("long").alias("k"), "blocks"), f"{path}/dealt")
    rows = dealt.join(sets, "doc").withColumn("other", F.explode(F.sequence(F.lit(0), F.when(large, F.col("blocks") - 1).otherwise(0).cast("int"))))
    rows = rows.select("large", "home", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), "k", "component", "doc", "tokens")
    with batches_of(members.sparkSession, 250):
        counts = save(rows.groupBy("large", "home", "i", "j").applyInPandas(_counted, "doc long, n long"), f"{path}/counts")
    return counts.groupBy(F.col("doc").alias("class_id")).agg(F.sum("n").alias("n_links"))


# -- the operator ------------------------------------------------------------------------------


def _found(emitted: DataFrame, by_choice: bool, parts: int, path: str) -> DataFrame:
    dealt = emitted.repartition(parts, "p").sortWithinPartitions("p")
    return save(dealt.mapInArrow(partial(_meet, by_choice), FOUND), path)


def _alike_by_sketch(reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents and one of those that hold the same small token, another one for each token."""
    held = reps.where("n >= 3").select("doc_id", "n", F.explode("sketch").alias("token"))
    head = held.groupBy("token").agg(F.min(F.struct(F.xxhash64("doc_id", "token").alias("chance"), F.col("doc_id").alias("head"), F.col("n").alias("m"))).alias("h"), F.count("*").alias("holders"))
    both = held.join(head.where("holders > 1").select("token", "h.head", "h.m"), "token")
    both = both.where((F.col("doc_id") != F.col("head")) & (4 * F.least("n", "m") >= 3 * F.greatest("n", "m")))
    return both.select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, class_id, and n_links if asked for.

    Two documents link when their sets of distinct five-word shingles have a Jaccard
    similarity of at least 0.75. class_id is the smallest doc_id with the same set;
    n_links is the number of other classes that its class links with, all pairs of a
    component being compared. Null and empty texts have no shingles and are linked with nothing; rows
    with a null id are returned with a null component. Repeated rows are returned as
    often as they come; an empty table gives an empty result; other columns are ignored.
    Of rows that share an id but not a text, each has its own n_shingles, and all have the
    links of the one with the smallest set key.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch(spark, "jaccard")
    prints = save(docs.mapInArrow(_prints, PRINTS), f"{path}/prints")
    known = prints.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("k1", "k2", F.col("n_shingles").alias("n"), "sketch", "bits"), F.struct("k1", "k2")).alias("x")).select("doc_id", "x.*")
    known = save(known, f"{path}/known")
    names = known.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("class_id"))
    classes = save(known.join(names, ["k1", "k2", "n"]).select("doc_id", "class_id"), f"{path}/classes")
    reps = save(known.join(names.select("class_id"), known.doc_id == names.class_id, "left_semi"), f"{path}/reps")
    bits = reps.select(F.col("doc_id").alias("doc"), "n", "bits")
    texts_of = _texts_of(docs, reps, path)

    sketched, sets = _verified(_alike_by_sketch(reps), bits, texts_of, None, f"{path}/v0")
    alike = components(sketched, f"{path}/c0")
    large = reps.where("n >= 3").select("doc_id", "n").join(alike, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("comp"))
    large = save(large, f"{path}/large")
    total = int(large.agg(F.sum("n")).first()[0] or 0)
    # a document emits about half as many signatures as it has tokens
    parts = partitions_for(spark, total // 2, PARTITION_ROWS, PARTITION_LEAST)
    first = _found(texts_of(large.drop("n"), "first").mapInArrow(partial(_round1, parts), OUT), False, parts, f"{path}/first")

    # documents that round 1 leaves open, with their frequent signatures by band
    role = F.col("b").bitwiseAND(1)
    said = first.where(f"kind <> {PAIR}").groupBy(F.col("a").alias("doc_id"), role.alias("lower")).agg(F.collect_list("s").alias("bad"), F.min(F.when(F.col("kind") == SHORT, F.shiftright("b", 1) - 1)).alias("short"))
    band = F.length(F.bin(F.expr("n div 3"))) - 1 - F.col("lower")
    slack = 2 + F.floor((F.expr("shiftleft(3L, cast(band + 1 as int))") - 1) / 64)
    marks = F.aggregate("bad", F.lit(0), lambda n, s: n + F.length(s)) / 4
    open_ = said.join(large, "doc_id").withColumn("band", band).where(marks > F.coalesce("short", slack))
    own, lower = (F.max(F.when(F.col("lower") == i, F.col("bad"))).alias(name) for i, name in enumerate(("own", "lower")))
    hard = save(open_.groupBy("doc_id", "n", "comp").agg(own, lower), f"{path}/hard")
    rows = int(hard.agg(F.sum("n")).first()[0] or 0)
    parts2 = partitions_for(spark, 3 * rows, PARTITION_ROWS, PARTITION_LEAST)
    second = _found(texts_of(hard.drop("n"), "second").mapInArrow(partial(_round2, parts2), OUT), True, parts2, f"{path}/second")

    left = save(second.where(f"kind = {MARK}").select(F.col("a").alias("doc_id")).distinct().join(large, "doc_id"), f"{path}/left")
    parts3 = partitions_for(spark, rows, PARTITION_ROWS, PARTITION_LEAST)
    third = _found(texts_of(left.drop("n"), "third").mapInArrow(partial(_round3, parts3), OUT), False, parts3, f"{path}/third")

    candidates = first.union(second).union(third).where(f"kind = {PAIR}").select("a", "b")
    links, sets = _verified(candidates, bits, texts_of, sets, f"{path}/v1")
    links = links.union(sketched)

    # round 3, mostly frequent tokens: pairs that lie in different components
    found = components(links, f"{path}/c1")
    common = third.where(f"kind = {MARK}").groupBy(F.col("a").alias("doc_id")).agg((F.sum(F.length("s")) / 4).cast("long").alias("often"))
    few = left.join(common, "doc_id").select("doc_id", "n", (F.col("n") - F.col("often")).alias("rare")).where("3 * rare <= n")
    few = few.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n", "rare", F.coalesce("component", "doc_id").alias("c"))
    across = _across(save(few, f"{path}/few"), texts_of, bits, f"{path}/across")

    links = save(links.union(across).distinct(), f"{path}/links")
    found = components(links, f"{path}/c2")
    of_class = classes.join(found, classes.class_id == found.node, "left").select(F.col("doc_id").alias("id"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    if count_links:
        more = spark.read.schema(SETS).parquet(f"{path}/across/both")
        members = found.join(large, found.node == large.doc_id).select(F.col("node").alias("doc"), "component", "n")
        degree = _degrees(members, sets.union(more.join(sets.select("doc"), "doc", "left_anti")), f"{path}/degrees")
        of_class = of_class.join(degree, "class_id", "left")
    out = prints.join(of_class, prints.doc_id == of_class.id, "left")
    links_of = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), *links_of)
