"""Spelling variants: words that differ by one edit, grouped under their commonest form.

One edit moves a word's letter counts by a squared distance of 1 (a letter more or less) or
2 (a letter replaced), so near words are looked for among letter-count vectors: blocks of
words of equal and adjacent lengths are multiplied, the Gram matrix gives all squared
distances of a block at once, and pairs at 2 or less are verified letter by letter.

An edit changes the counts of two letters at most. The letters are dealt to four groups, so
near words agree on all counts of two groups at least; only words that agree on the counts
of some two groups are multiplied, six choices of two. Blocks of more than ``BLOCK`` words
are cut, and every two pieces meet, so that no task holds more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions_for, save, scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: The place of each code point among the letters.
PLACE = np.zeros(256, np.int64)
PLACE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
GROUPS = 4
#: Letters in turn, so that each group has common ones.
GROUP = np.arange(len(LETTERS)) % GROUPS
CHOICES = list(combinations(range(GROUPS), 2))
#: Words of a block at most, rows multiplied at once, pairs verified at once, and counts held before they are handed on.
BLOCK, TOGETHER, MOST, HELD = 1000, 256, 200_000, 200_000
BUCKET_ROWS = 400_000


# -- words ------------------------------------------------------------------------------------


def _occurrences(batches: Iterator[pa.RecordBatch], every: int) -> Iterator[pa.RecordBatch]:
    """(word, n): occurrences in these texts, a word as often as it was handed on."""
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(b"%d:" % doc if doc is not None else b":")
            for run, n in Counter(RUN.findall(text.as_py() or "")).items():
                run = run.lower() if run.isascii() else run.translate(UPPER)
                h = zlib.crc32(run.encode(), start)
                if h % every == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                held[run] += n
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, letters: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, of ``letters`` code points and ``least`` occurrences or more.

    A run loses one letter in one of ``every`` documents: the one that the checksum of its
    document and itself names.
    """
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    words = texts.mapInArrow(partial(_occurrences, every=every), "word string, n long").where(F.length("word") >= letters)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# -- near words ---------------------------------------------------------------------------------


def letter_counts(words: list[str]) -> np.ndarray:
    """Exact in sums of squares: short words in single precision."""
    length = np.fromiter(map(len, words), np.int64, len(words))
    place = PLACE[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
    flat = np.repeat(np.arange(len(words)), length) * len(LETTERS) + place
    kind = np.float32 if length.max() < 2000 else np.float64
    return np.bincount(flat, minlength=len(words) * len(LETTERS)).reshape(len(words), -1).astype(kind)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, tag, word): for each choice of two groups, and as shorter and longer of two lengths; the tag says which."""
    weight = mix(np.arange(1, len(LETTERS) + 1, dtype=np.uint64))
    for batch in batches:
        words = batch.column(0)
        each = words.to_pylist()
        if not each:
            continue
        counts = letter_counts(each).astype(np.uint64)
        length = np.fromiter(map(len, each), np.uint64, len(each))
        for c, choice in enumerate(CHOICES):
            inside = np.isin(GROUP, choice)
            key = (counts[:, inside] * weight[inside]).sum(1, dtype=np.uint64)
            for longer in (0, 1):
                bucket = mix(mix(key + (length - np.uint64(longer)) * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(c))
                tag = np.full(len(each), 2 * c + longer, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(tag), words], ["bucket", "tag", "word"])


def one_edit(letters: np.ndarray, length: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i become words j, which are as long or longer by one, by one letter replaced or put in. letters: a row a word, padded."""
    x, y = letters[i], letters[j]
    wide = x.shape[1]
    same = x == y
    out = (length[i] == length[j]) & ((~same).sum(1) == 1)
    put = np.flatnonzero(length[i] + 1 == length[j])
    if len(put):
        # what agrees from the start, and from the end with the longer word moved by one
        inside = np.arange(wide)[None] < length[i[put], None]
        start = np.cumprod(same[put] & inside, 1, dtype=np.uint8).sum(1)
        moved = np.zeros((len(put), wide), bool)
        moved[:, :-1] = x[put, :-1] == y[put, 1:]
        end = np.cumprod((moved | ~inside)[:, ::-1], 1, dtype=np.uint8).sum(1) - (wide - length[i[put]])
        out[put] = start.astype(np.int64) + end >= length[i[put]]
    return out


def _near(words: list[str], run: np.ndarray, tag: np.ndarray, piece: np.ndarray, apart: np.ndarray) -> tuple[list[str], list[str]]:
    """Near pairs within runs; of a run that holds two pieces ``apart``, those between the pieces."""
    x = letter_counts(words)
    length = x.sum(1).astype(np.int64)
    norm = (x * x).sum(1)
    square = norm[:, None] + norm[None] - 2 * (x @ x.T)
    longer = (tag & 1).astype(bool)
    # a letter more, the longer word being here as the longer; or a letter replaced, both as the shorter
    ok = ((square == 1) & (longer[None] & ~longer[:, None])) | ((square == 2) & ~longer[:, None] & ~longer[None] & np.triu(np.ones(square.shape, bool), 1))
    ok &= (run[:, None] == run[None]) & ((piece[:, None] != piece[None]) | ~apart[:, None])
    i, j = np.nonzero(ok)
    letters = np.zeros((len(words), int(length.max())), np.uint8)
    letters[np.arange(letters.shape[1])[None] < length[:, None]] = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    near = [np.flatnonzero(one_edit(letters, length, i[k : k + MOST], j[k : k + MOST])) + k for k in range(0, len(i), MOST)]
    if not near:
        return [], []
    i, j = i[np.concatenate(near)], j[np.concatenate(near)]
    # a pair meets for each choice of groups that it agrees on; the first of them reports it
    same = np.stack([(x[i][:, GROUP == g] == x[j][:, GROUP == g]).all(1) for g in range(GROUPS)], 1)
    first = np.stack([same[:, list(c)].all(1) for c in CHOICES], 1).argmax(1) == tag[i] >> 1
    return [words[k] for k in i[first]], [words[k] for k in j[first]]


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, piece, tag, word) come sorted by the first three: (a, b) of near words. Whole runs are compared, short ones together."""

    def compared(words: list[str], rest: np.ndarray, run: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = 0
        ends = np.r_[np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)]
        while cut < len(run):
            to = int(ends[min(np.searchsorted(ends, cut + TOGETHER), len(ends) - 1)])
            if to - cut > 1:
                i, j, piece, tag = rest[1:, cut:to]
                a, b = _near(words[cut:to], run[cut:to], tag, piece, i != j)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])
            cut = to

    def runs_of(rest: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[True, (rest[:3, 1:] != rest[:3, :-1]).any(0)])

    words: list[str] = []
    rest = np.empty((5, 0), np.int64)
    for batch in batches:
        words += batch.column(5).to_pylist()
        rest = np.concatenate((rest, np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(5)])), 1)
        if len(words) < 2:
            continue
        run = runs_of(rest)
        last = int(np.searchsorted(run, run[-1]))  # its run may go on
        yield from compared(words[:last], rest[:, :last], run[:last])
        words, rest = words[last:], rest[:, last:]
    if words:
        yield from compared(words, rest, runs_of(rest))


def near_words(words: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """(a, b): all pairs of the distinct ``word`` s that are one edit apart, each once."""
    dealt = save(words.select("word").mapInArrow(_dealt, "bucket long, tag int, word string"), f"{path}/dealt")
    sizes = save(dealt.groupBy("bucket").count().where("count > 1"), f"{path}/sizes")
    pieces = F.ceil(F.col("count") / block).cast("int")
    rows = dealt.join(sizes.select("bucket", pieces.alias("pieces")), "bucket")
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"))
    # every two pieces of a bucket meet in one block
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    rows = rows.select("bucket", F.least("piece", "other").alias("i"), F.greatest("piece", "other").alias("j"), "piece", "tag", "word")
    n = int(sizes.agg(F.sum("count")).first()[0] or 0)
    parts = partitions_for(words.sparkSession, n, BUCKET_ROWS)
    rows = rows.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return save(rows.mapInArrow(_met, "a string, b string"), f"{path}/near")


# -- forms --------------------------------------------------------------------------------------


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 97, letters: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point. A word's form
    is the near word with the most occurrences, ties going to the first in code-point order,
    if it has ``times`` as many as the word itself, else null (form_n too). root is where the
    forms lead, the word itself without one; each step at least doubles n, so they end.

    Null and empty texts have no words. A row with a null id counts, its checksum being of an
    empty id; repeated rows count as often as they come. An empty table gives an empty
    result, other columns are ignored, texts and words may have any length.
    """
    path = scratch(docs.sparkSession, "spelling")
    words = save(count_words(docs, id_col, text_col, every, letters, least), f"{path}/words")
    pairs = near_words(words, path)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    both = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other"))).alias("best"))
    chosen = -F.col("best.minus") >= times * F.col("n")
    told = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.minus")).alias("form_n"))
    told = save(told, f"{path}/forms")
    root = save(told.where("form is not null").select("word", F.col("form").alias("root")), f"{path}/root-0")
    # forms lead on for as many steps as n can double; each round doubles the steps taken
    for i in range(1, 8):
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        went = save(root.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"{path}/root-{i}")
        root = went.select("word", "root")
        if went.where("moved").isEmpty():
            break
    out = told.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
