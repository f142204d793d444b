"""Packing documents into sequences of tokens by hierarchical residual best fit.

Items are packed best-fit decreasing within partitions. Full and nearly full bins are
emitted; all others become items, which a tree merges from partition to partition for
further best-fit rounds. Only sizes go up the tree: a bin is an item of the next level,
and the places of the pieces are put together at the end, level by level.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, scratch, slices

#: Items of one partition.
GROUP = 40_000
#: Partitions whose underfull bins meet at each step of the tree, if together they have no more items than a partition.
MERGE = 64
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
#: White space and separators beyond ASCII's, at which str.split would cut as well.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Letters that have one form and one lower case, then marks but for the apostrophe.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
END = (1).to_bytes(4, "little")
#: Words that a worker remembers.
KNOWN = 600_000


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


#: Words with capitals, marks, digits, accents and odd blanks, by which a vocabulary shows how it cuts texts.
PROBE = ["Straße", "ÉTÉ", "naïve,", "The", "it's", "don't!", "(word)", "e.g.", "x1y2", "2024-01-02", "$5.00", "a_b", "…", "日本語", "hello...", "WORLD?!", "co-op", "#tag", "é", "Ÿ", "[at]", "<b>", "100%", "İstanbul"]


class _Words(dict):
    """Token ids of each blank-separated word as little-endian bytes.

    A vocabulary that drops white space and never joins what it separates gives a text the
    ids of its words, one after the other. One that also separates letters from marks and
    lowers them lets plain words go to its model directly. Both are tried on probe words
    first; where they don't hold, words or whole texts are encoded as they are.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.model = tokenizer.encode, tokenizer.model
        self.letters: dict[str, bytes] = {}
        self.bytes = _byte_characters()
        self.plain = True
        try:
            self.plain = all(self[w] == self.encoded(w) for w in PROBE)
        except Exception:  # a model that has no such bytes or method
            self.plain = False
        self.clear()
        texts = [" ".join(PROBE), "\n".join(reversed(PROBE)), f" {PROBE[3]}\t\x0b {PROBE[4]} \r\n"]
        self.by_word = all(self.ids_by_word(t) == self.encoded(t) for t in texts)
        self.clear()

    def encoded(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        ids = self.letters.get(word)
        if ids is None:
            text = word if word.isascii() else "".join(map(self.bytes.__getitem__, word.encode()))
            ids = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
            if len(self.letters) >= KNOWN:
                self.letters.clear()
            self.letters[word] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64:
            return self.encoded(word)
        if self.plain and (m := SIMPLE.fullmatch(word)):
            ids = self._letters(m[1].lower()) + (self[m[2]] if m[2] else b"")
        else:
            ids = self.encoded(word)
        if len(self) >= KNOWN:
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return self.ids_by_word(text) if self.by_word else self.encoded(text)

    def ids_by_word(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, CHUNK.findall(text) if ODD.search(text) else text.split()))


@lru_cache(1)
def _words(path: str) -> _Words:
    return _Words(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pieces(vocabulary: str | None, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _words(vocabulary or default_vocabulary())
    for whole in batches:
        for b in slices(whole):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = words.ids(text.as_py() or "") + END
                for piece, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    for col, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: An item of a level, named by group and bin, in the group and bin of the next; fill is that of the bin.
PACKED = "grp long, bin long, to long, into long, offset long, fill long, open boolean"


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; sizes come largest first."""
    at, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(limit + 1)]
    mask = bins = 0  # mask: bit r is set if some bin has r left
    for i, n in enumerate(sizes.tolist()):
        if fit := mask >> n:
            r = n + (fit & -fit).bit_length() - 1
            k = room[r].pop()
            if not room[r]:
                mask &= ~(1 << r)
        else:
            k, r = bins, limit
            bins += 1
        at[i], offset[i] = k, limit - r
        if r > n:
            room[r - n].append(k)
            mask |= 1 << (r - n)
    return at, offset


def _packed(limit: int, full: int, last: bool):
    """One group of items (grp, bin, size) into bins."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "grp", "bin"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        into, offset = best_fit(df["size"].to_numpy(), limit)
        fill = np.bincount(into, df["size"].to_numpy()).astype(np.int64)[into]
        return pd.DataFrame({"grp": df["grp"], "bin": df["bin"], "to": df["to"], "into": into, "offset": offset, "fill": fill, "open": (fill < full) & (not last)})

    return pack


def pack_documents(docs: DataFrame, limit: int = 4096, slack: float = 0.005, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's token ids and the id 1; only documents of more than ``limit``
    tokens are cut, into pieces of ``limit`` and a rest. Bins with at most ``slack`` of
    their room left count as full. ``vocabulary``: a tokenizer file that executors can
    read, else the installed one.

    Null and empty texts are the single id 1. Repeated rows are packed as often as they
    come. Null ids are allowed. An empty table gives an empty result; other columns are
    ignored. A rerun over the same rows gives the same packing up to bin numbers.
    """
    spark = docs.sparkSession
    path = scratch(spark, "packing")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = save(docs.mapInArrow(partial(_pieces, vocabulary, limit), PIECES), f"{path}/pieces")
    full = max(1, int(limit * (1 - slack)))
    whole = pieces.where(F.col("length") == limit)
    rest = pieces.where(F.col("length") < limit)
    groups = max(1, -(-rest.count() // GROUP))
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(groups))
    # the name of a piece as an item: its group and a number
    rest = save(rest.withColumns({"grp": spread, "bin": F.monotonically_increasing_id()}), f"{path}/rest")
    items = rest.select("grp", "bin", F.col("length").alias("size"), F.col("grp").alias("to"))
    levels, count = [], rest.count()
    while True:
        last = groups == 1
        out = save(items.groupBy("to").applyInPandas(_packed(limit, full, last), PACKED), f"{path}/level-{len(levels)}")
        levels.append(out)
        if last:
            break
        open_ = out.where("open").select(F.col("to").alias("grp"), F.col("into").alias("bin"), F.col("fill").alias("size")).distinct()
        left = open_.count()
        # a group of the next level holds as many open bins as one of the first held pieces
        merged = max(-(-groups // MERGE), -(-left // GROUP), 1)
        if merged >= groups and left > count - count // 100:
            break  # bins that fit nowhere among so many others: they stay as they are
        groups, count = merged, left
        items = open_.withColumn("to", F.pmod(F.xxhash64("grp", "bin"), F.lit(groups)))
    # places from the last level down: of an item, its sequence and where it starts there
    placed = None
    for i in reversed(range(len(levels))):
        here = levels[i].withColumn("number", 2 * ((F.lit(i) * F.lit(1 << 32) + F.col("to")) * F.lit(1 << 20) + F.col("into")) + 1)
        if placed is None:
            placed = here.select("grp", "bin", F.col("number").alias("sequence_id"), "offset")
            continue
        up = placed.select(F.col("grp").alias("to"), F.col("bin").alias("into"), F.col("sequence_id").alias("above"), F.col("offset").alias("start"))
        both = here.join(up, ["to", "into"], "left")
        placed = save(both.select("grp", "bin", F.coalesce("above", "number").alias("sequence_id"), (F.col("offset") + F.coalesce("start", F.lit(0))).alias("offset")), f"{path}/placed-{i}")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    packed = rest.join(placed, ["grp", "bin"]).select(*columns)
    # a full piece is a sequence of its own, with an even number
    alone = whole.select("doc_id", "piece", "start", "length", "ids_crc32", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(alone)
