"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words; their TF-IDF vectors over the
benchmark's words get a latent space by a distributed randomised SVD (one pass, Nystrom
form).  Passages close to a benchmark item in that space are candidates, which the longest
common subsequence of words and a check of the item's closing words (its answer) decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import query, table, with_row_key, without_rows, word_bytes

# Items handled in one pass over the documents; a larger benchmark takes several passes.
ITEMS_AT_ONCE = 256
# The longest item of a pass may have so many times the words of the shortest one: passages suit the longest.
LENGTHS_AT_ONCE = 4
EXTRA_DIMENSIONS = 48
# Words in more than this share of passages say too little to look for.
MAX_SHARE = 0.02
TERMS_IN_ROW = 64
ROWS_AT_ONCE = 20_000


@dataclass(frozen=True)
class Settings:
    """Thresholds: latent cosine of candidates; share of an item's words in common order, alone or with the answer."""

    cosine: float = 0.4
    verbatim: float = 0.8
    paraphrase: float = 0.6
    answer: float = 0.9
    answer_words: int = 8


@dataclass(frozen=True)
class Item:
    """A benchmark text as words, and bit masks of where each word stands, for the subsequences."""

    id: int
    words: tuple[bytes, ...]
    answer_words: int

    def masks(self, start: int = 0) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        for at, word in enumerate(self.words[start:]):
            out[word] = out.get(word, 0) | 1 << at
        return out


def common_subsequence(masks: dict[bytes, int], size: int, words: Sequence[bytes]) -> int:
    """Length of the longest common subsequence with a text of ``size`` words given by its masks, bit-parallel."""
    full = (1 << size) - 1
    state = full
    for word in words:
        mask = masks.get(word)
        if mask is not None:
            hit = state & mask
            state = ((state + hit) | (state - hit)) & full
    return size - state.bit_count()


def passage_terms(
    texts: Sequence[str | None], index: dict[bytes, int], stride: int
) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Words of each text, and over all its passages: text, passage, term and count, with the number of passages.

    A passage is ``2 * stride`` words from a multiple of ``stride`` on, so any run of
    up to ``stride`` words stands whole in one.
    """
    all_words = [word_bytes((text or "").lower()) for text in texts]
    sizes = np.array([len(words) for words in all_words], np.int64)
    total = int(np.maximum(1, -(-sizes // stride) - 1).sum())
    ids = np.fromiter(map(index.get, chain.from_iterable(all_words), repeat(-1)), np.int64, int(sizes.sum()))
    at = np.flatnonzero(ids >= 0)
    if not len(at):
        none = np.zeros(0, np.int64)
        return all_words, none, none, none, none, total
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    text_at = np.repeat(np.arange(len(texts)), sizes)[at]
    term, place = ids[at], at - starts[text_at]
    slot = place // stride
    text_at = np.concatenate([text_at, text_at[slot > 0]])
    term = np.concatenate([term, term[slot > 0]])
    slot = np.concatenate([slot, slot[slot > 0] - 1])
    width = np.int64(len(index))
    slots = np.int64(slot.max() + 1)
    key, count = np.unique((text_at * slots + slot) * width + term, return_counts=True)
    passage, term = key // width, key % width
    return all_words, passage // slots, passage % slots, term, count, total


def vectors(passage: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray):
    """Starts of the passages' runs, and their unit TF-IDF weights term by term."""
    weight = (1 + np.log(count)) * idf[term]
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    norm = np.sqrt(np.add.reduceat(weight**2, starts))
    sizes = np.diff(np.append(starts, len(term)))
    return starts, sizes, (weight / np.repeat(np.maximum(norm, 1e-12), sizes)).astype(np.float32)


def weighted_sums(
    values: np.ndarray, index: np.ndarray, weight: np.ndarray, starts: np.ndarray, sizes: np.ndarray
) -> np.ndarray:
    """For each run of ``index`` and ``weight``, the weighted sum of the rows of ``values``; runs of one length go together."""
    out = np.empty((len(starts), values.shape[1]), np.float32)
    for size in np.unique(sizes):
        of = np.flatnonzero(sizes == size)
        # Many runs at a time, but never more rows than fit easily.
        for part in np.array_split(of, -(-len(of) * int(size) // ROWS_AT_ONCE)):
            places = starts[part][:, None] + np.arange(size)[None, :]
            out[part] = np.matmul(weight[places][:, None, :], values[index[places]])[:, 0, :]
    return out


def runs(of_text: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """One number per passage, ascending."""
    return of_text * (int(slot.max()) + 1 if len(slot) else 1) + slot


def term_shares(docs: DataFrame, index: dict[bytes, int], stride: int) -> tuple[np.ndarray, int]:
    """In how many passages of all documents each term stands, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, passages = np.zeros(len(index), np.int64), 0
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(first, 256).to_pylist()
                _, _, _, term, _, total = passage_terms(texts, index, stride)
                seen += np.bincount(term, minlength=len(index))
                passages += total
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *at], pa.int32()), pa.array([passages, *seen[at]], pa.int64())], names=["term", "n"]
        )

    counted = docs.select("_text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    shares, passages = np.zeros(len(index), np.int64), 0
    for row in counted:
        if row["term"] < 0:
            passages = row["n"]
        else:
            shares[row["term"]] = row["n"]
    return shares, passages


def sketch(docs: DataFrame, index: dict[bytes, int], idf: np.ndarray, start: np.ndarray, stride: int) -> np.ndarray:
    """A'A times ``start``, for the matrix A of all passages' vectors: partial sums per task, added up per block of terms.

    A task passes on one row per block of terms, and the tasks that add them hold
    one sum per block, whatever the number of rows.
    """
    shape = start.shape

    def rows_of(total: np.ndarray) -> pa.RecordBatch:
        blocks = range(0, shape[0], TERMS_IN_ROW)
        return pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([total[b : b + TERMS_IN_ROW].tobytes() for b in blocks], pa.binary())],
            names=["block", "part"],
        )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.float32)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(first, 256).to_pylist()
                _, of_text, slot, term, count, _ = passage_terms(texts, index, stride)
                if not len(term):
                    continue
                starts, sizes, weight = vectors(runs(of_text, slot), term, count, idf)
                near = weighted_sums(start, term, weight, starts, sizes)
                order = np.argsort(term, kind="stable")
                row = np.repeat(np.arange(len(starts)), sizes)[order]
                by_term = term[order]
                heads = np.flatnonzero(np.concatenate([[True], by_term[1:] != by_term[:-1]]))
                total[by_term[heads]] += weighted_sums(near, row, weight[order], heads, np.diff(np.append(heads, len(by_term))))
        yield rows_of(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(part.as_buffer(), np.float32)
                sums[block] = sums[block] + values if block in sums else values.copy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "part"]
        )

    parts = docs.select("_text").mapInArrow(partial, "block int, part binary")
    added = parts.repartition("block").mapInArrow(add, "block int, part binary").collect()  # one row per block of terms
    out = np.zeros(shape, np.float64)
    for row in added:
        at = row["block"]
        out[at : at + TERMS_IN_ROW] += np.frombuffer(row["part"], np.float32).reshape(-1, shape[1])
    return out


def latent_space(image: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Right singular vectors of A from ``image`` = A'A ``start`` (Nystrom form, with a small shift for stability)."""
    shift = np.sqrt(image.shape[0]) * np.finfo(np.float32).eps * max(np.linalg.norm(image, 2), 1e-30)
    image = image + shift * start
    core = start.T @ image
    values, turned = np.linalg.eigh((core + core.T) / 2)
    kept = values > values.max() * 1e-9
    factor = image @ (turned[:, kept] / np.sqrt(values[kept]))
    left, singular, _ = np.linalg.svd(factor, full_matrices=False)
    return left[:, singular > singular.max() * 1e-6].astype(np.float32)


def item_vectors(items: Sequence[Item], index: dict[bytes, int], idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows of the items."""
    out = np.zeros((len(items), len(index)))
    for at, item in enumerate(items):
        for word in item.words:
            if word in index:
                out[at, index[word]] += 1
    out = np.where(out > 0, (1 + np.log(np.maximum(out, 1))) * idf, 0)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def leaks_of_block(docs: DataFrame, items: Sequence[Item], settings: Settings) -> DataFrame:
    """``(_row, _id, item_id, cosine, lcs, answer)`` of passages that hold one of a block of items."""
    index = {word: at for at, word in enumerate(dict.fromkeys(word for item in items for word in item.words))}
    stride = max(len(item.words) for item in items)
    stride += stride // 4  # a paraphrase may be longer than the item
    shares, passages = term_shares(docs, index, stride)
    idf = np.log((1 + passages) / (1 + shares))
    common = shares > MAX_SHARE * passages
    for item in items:
        # An item made up of common words is looked for by those.
        own = np.array([index[word] for word in set(item.words)])
        if common[own].mean() > 0.7:
            common[own] = False
    # From here on only the telling words count.
    kept = np.flatnonzero(~common)
    idf = np.maximum(idf, 0.01)[kept]
    index = {word: at for at, word in enumerate(np.array(list(index), object)[kept])}
    rows = item_vectors(items, index, idf)
    random = np.random.default_rng(8).standard_normal((len(index), EXTRA_DIMENSIONS)) / np.sqrt(len(index))
    start = np.linalg.qr(np.hstack([rows.T, random]))[0].astype(np.float32)
    space = latent_space(sketch(docs, index, idf, start, stride), start.astype(np.float64))
    goal = rows @ space
    goal = (goal / np.maximum(np.linalg.norm(goal, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    id_type = docs.schema["_id"].dataType.simpleString()
    item_type = "long"
    masks = [(item.masks(), item.masks(len(item.words) - item.answer_words)) for item in items]
    sizes_of = [(len(item.words), item.answer_words) for item in items]
    ids = [item.id for item in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                words, of_text, slot, term, count, _ = passage_terms(part.column(1).to_pylist(), index, stride)
                found = []
                if len(term):
                    starts, sizes, weight = vectors(runs(of_text, slot), term, count, idf)
                    latent = weighted_sums(space, term, weight, starts, sizes)
                    norm = np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
                    cosine = (latent / norm) @ goal.T
                    for passage, item in np.argwhere(cosine >= settings.cosine).tolist():
                        text, at = int(of_text[starts[passage]]), int(slot[starts[passage]])
                        run = words[text][at * stride : (at + 2) * stride]
                        size, answer_size = sizes_of[item]
                        lcs = common_subsequence(masks[item][0], size, run) / size
                        if lcs < settings.paraphrase:
                            continue
                        answer = common_subsequence(masks[item][1], answer_size, run) / answer_size
                        if lcs >= settings.verbatim or answer >= settings.answer:
                            found.append((text, ids[item], float(cosine[passage, item]), lcs, answer))
                at_row = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(at_row),
                        pa.array([x[1] for x in found], pa.int64()),
                        *[pa.array([x[i] for x in found], pa.float64()) for i in (2, 3, 4)],
                    ],
                    names=["_id", "item_id", "cosine", "lcs", "answer"],
                )

    return docs.select("_id", "_text").mapInArrow(
        search, f"_id {id_type}, item_id {item_type}, cosine double, lcs double, answer double"
    )


def benchmark_blocks(benchmark: DataFrame, settings: Settings) -> Iterator[list[Item]]:
    """The items with words, a block at a time, ordered by length so that a block's passages suit its items."""
    known = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    block: list[Item] = []
    for row in known.orderBy(F.length("text"), "item_id", "text").toLocalIterator():
        words = tuple(word_bytes(row["text"]))
        if not words:
            continue
        sizes = [len(words), *(len(item.words) for item in block)]
        if len(block) == ITEMS_AT_ONCE or max(sizes) > LENGTHS_AT_ONCE * min(sizes):
            yield block
            block = []
        block.append(Item(row["item_id"], words, min(len(words), settings.answer_words)))
    if block:
        yield block


def find_leaks(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """``(id_col, item_id, cosine, lcs, answer)``: the items (``item_id``, ``text``) that each document holds, best passage each.

    ``lcs`` is the share of the item's words that stand in a passage in their order,
    ``answer`` that of its last words.  A document holds an item if ``lcs`` reaches
    ``verbatim``, or ``paraphrase`` with the answer.  Items without an id or without
    words are left out, null texts are empty, rows repeated with one id are one
    document.  Either table may be empty.
    """
    settings = settings or Settings()
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = docs.schema["_id"].dataType.simpleString()
    found = df.sparkSession.createDataFrame([], f"_id {id_type}, item_id long, cosine double, lcs double, answer double")
    for block in benchmark_blocks(benchmark, settings):
        found = found.union(leaks_of_block(docs, block, settings))
    return (
        found.groupBy("_id", "item_id")
        .agg(F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer"))
        .withColumnRenamed("_id", id_col)
    )


def drop_contaminated(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None
) -> DataFrame:
    """``df`` without the documents that hold a benchmark item; rows without an id stay.

    Rows that share an id but not the text are told apart, so a clean one stays.
    """
    keyed = with_row_key(df.select(id_col, text_col), id_col, text_col)
    return without_rows(df, find_leaks(keyed, benchmark, "_row", text_col, settings), id_col, text_col)


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
