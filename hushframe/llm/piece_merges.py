"""SentencePiece encoding and decoding by vectorised merge rounds over flat symbol arrays."""

from __future__ import annotations

import functools
import heapq
import itertools
import os
import re
import sys
import types
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import query, table
from hushframe.llm.tokens import public_path

SPACE = "▁"
# Words kept with their ids, in two halves: when the newer one is full, the older one goes.
CACHE_WORDS = 400_000
# Texts are taken together up to so many characters; longer ones are read by so many words at a time.
CHARS_AT_ONCE, WORDS_AT_ONCE = 500_000, 100_000
# No pair of symbols: a rank behind all others.
NONE = np.iinfo(np.int32).max
# Symbols that are no piece are numbered behind all code points.
SHIFT = np.uint64(21)


def _alternate(hits: np.ndarray) -> np.ndarray:
    """Of positions in ascending order, those that stay when each one kept forbids the next position."""
    if len(hits) < 2:
        return hits
    run = np.concatenate([[True], np.diff(hits) > 1])
    first = np.maximum.accumulate(np.where(run, np.arange(len(hits)), 0))
    return hits[(np.arange(len(hits)) - first) % 2 == 0]


class PieceModel:
    """The vocabulary of a sentencepiece model file, and both directions over it.

    The model has to be BPE with byte fallback, identity normalisation that keeps
    all white space, and pieces that hold the space sign in front only; another
    one is an error.  Words (space signs and what follows them) are then merged
    independently of each other.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec
        kinds = proto.SentencePiece
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        if (
            kind.model_type != kind.BPE or not kind.byte_fallback or norm.precompiled_charsmap
            or norm.remove_extra_whitespaces or kind.treat_whitespace_as_suffix
            or any(t in (kinds.USER_DEFINED, kinds.UNUSED) for _, _, t in pieces)
            or any(SPACE in p.lstrip(SPACE) for p, _, t in pieces if t == kinds.NORMAL)
        ):
            raise ValueError(f"not a plain BPE model with byte fallback: {path}")
        self.lead = SPACE if norm.add_dummy_prefix else ""
        self.size = len(pieces)
        normal = {p: i for i, (p, _, t) in enumerate(pieces) if t == kinds.NORMAL}
        self.chars = np.arange(0x110000, dtype=np.int32) + self.size
        for piece, at in normal.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = at
        self.bytes = np.zeros(256, np.int32)
        self.text: list[bytes] = [p.replace(SPACE, " ").encode() for p, _, _ in pieces]
        self.raw = np.zeros(self.size, bool)
        for at, (piece, _, t) in enumerate(pieces):
            if t == kinds.BYTE:
                value = int(piece[3:5], 16)
                self.bytes[value], self.raw[at], self.text[at] = at, True, bytes([value])
            elif t == kinds.CONTROL:
                self.text[at] = b""
            elif t == kinds.UNKNOWN:
                self.unknown, self.text[at] = at, kind.unk_surface.encode()
        self.silent = np.array([not text for text in self.text])
        self.normal = [(piece, at, pieces[at][1]) for piece, at in normal.items()]
        inner = {char for piece in normal for char in piece}
        breaks = "".join(re.escape(char) for char in "\n\r\t" if char not in inner)
        self.words = re.compile(f"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (f"|[{breaks}]" if breaks else ""))
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @functools.cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of symbols that make a piece, in ascending order, with rank and piece; only encoding needs them.

        Equal scores share a rank; within a rank the leftmost pair goes first.
        """
        order = {score: rank for rank, score in enumerate(sorted({score for *_, score in self.normal}, reverse=True))}
        normal = {piece: at for piece, at, _ in self.normal}
        keys, ranks, made = [], [], []
        for piece, at, score in self.normal:
            for cut in range(1, len(piece)):
                left, right = (self._symbol(x, normal) for x in (piece[:cut], piece[cut:]))
                if left is not None and right is not None:
                    keys.append((left << int(SHIFT)) | right)
                    ranks.append(order[score])
                    made.append(at)
        by_key = np.argsort(np.array(keys, np.uint64))
        return np.array(keys, np.uint64)[by_key], np.array(ranks, np.int32)[by_key], np.array(made, np.int32)[by_key]

    def _symbol(self, text: str, normal: dict[str, int]) -> int | None:
        if len(text) == 1:
            return int(self.chars[ord(text)])
        return normal.get(text)

    # ---- merge rounds

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of pairs of symbols; rank ``NONE`` where no piece is made."""
        known, ranks, made = self.pairs
        keys = (left.astype(np.uint64) << SHIFT) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ranks[at], NONE).astype(np.int32), made[at]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Merge all words (none empty) until no pair is left: their numbers as they finish, sizes, and symbols in a row.

        In every round each word merges all its pairs of the best rank, from the
        left and without overlap; finished words leave the arrays.  That equals
        merging one pair at a time as long as no merge makes a pair as good as the
        one merged; a word where it would goes on pair by pair.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        symbols = self.chars[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        names = np.arange(len(words))
        ranks, made = self._ranked(symbols, sizes)
        while len(names):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(ranks, starts)
            over = best == NONE
            if over.any():
                keep = np.repeat(~over, sizes)
                done.append((names[over], sizes[over], symbols[~keep]))
                symbols, ranks, made = symbols[keep], ranks[keep], made[keep]
                names, sizes, best = names[~over], sizes[~over], best[~over]
                if not len(names):
                    break
                starts = np.cumsum(sizes) - sizes
            of_word = np.repeat(np.arange(len(names)), sizes)
            hits = _alternate(np.flatnonzero(ranks == best[of_word]))
            several = np.bincount(of_word[hits], minlength=len(names)) > 1
            odd = self._odd(symbols, made, hits, of_word, best, several) if several.any() else several
            if odd.any():
                for at in np.flatnonzero(odd):
                    merged = self._one_by_one(symbols[starts[at] : starts[at] + sizes[at]].tolist())
                    done.append((names[at : at + 1], np.array([len(merged)]), merged))
                keep = ~odd[of_word]
                symbols, ranks, made = symbols[keep], ranks[keep], made[keep]
                names, sizes = names[~odd], sizes[~odd]
                continue
            symbols[hits] = made[hits]
            keep = np.ones(len(symbols), bool)
            keep[hits + 1] = False
            sizes = sizes - np.bincount(of_word[hits], minlength=len(names))
            place = np.cumsum(keep) - 1
            symbols, ranks, made, of_word = symbols[keep], ranks[keep], made[keep], of_word[keep]
            now = place[hits]
            touched = np.concatenate([now, now[now > 0] - 1])
            last = np.ones(len(touched), bool)
            inside = touched + 1 < len(symbols)
            last[inside] = of_word[touched[inside]] != of_word[touched[inside] + 1]
            ranks[touched[last]] = NONE
            open_ = touched[~last]
            ranks[open_], made[open_] = self._pairs(symbols[open_], symbols[open_ + 1])
        return tuple(map(np.concatenate, zip(*done, strict=True)))

    def _ranked(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each symbol with the next one of its word."""
        ranks = np.full(len(symbols), NONE, np.int32)
        made = np.zeros(len(symbols), np.int32)
        open_ = np.ones(len(symbols), bool)
        open_[np.cumsum(sizes) - 1] = False
        at = np.flatnonzero(open_)
        ranks[at], made[at] = self._pairs(symbols[at], symbols[at + 1])
        return ranks, made

    def _odd(self, symbols, made, hits, of_word, best, several) -> np.ndarray:
        """The words in which one of several merges could make a pair that does not rank behind them."""
        hits = hits[several[of_word[hits]]]
        word = of_word[hits]
        new = made[hits]
        odd = np.zeros(len(best), bool)

        def test(found: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            if len(found):
                rank, _ = self._pairs(left, right)
                odd[word[found][rank <= best[word[found]]]] = True

        before = np.flatnonzero((hits > 0) & (of_word[np.maximum(hits - 1, 0)] == word))
        test(before, symbols[hits[before] - 1], new[before])
        end = len(symbols) - 1
        after = np.flatnonzero((hits + 2 <= end) & (of_word[np.minimum(hits + 2, end)] == word))
        test(after, new[after], symbols[hits[after] + 2])
        beside = np.flatnonzero((np.diff(hits) == 2) & (np.diff(word) == 0))
        test(beside, new[beside], new[beside + 1])
        return odd

    def _one_by_one(self, symbols: list[int]) -> np.ndarray:
        """Merge the best pair, the leftmost of equal ones, until none is left."""
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(lefts: list[int]) -> None:
            pairs = [(x, symbols[x], symbols[after[x]]) for x in lefts if x >= 0 and after[x] >= 0]
            if pairs:
                ranks, made = self._pairs(np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs]))
                for (at, left, right), rank, piece in zip(pairs, ranks.tolist(), made.tolist(), strict=True):
                    if rank != NONE:
                        heapq.heappush(queue, (rank, at, left, right, piece))

        offer(list(range(len(symbols))))
        while queue:
            _, at, left, right, piece = heapq.heappop(queue)
            other = after[at]
            if symbols[at] != left or other < 0 or symbols[other] != right:
                continue
            symbols[at], symbols[other] = piece, -1
            after[at] = after[other]
            if after[at] >= 0:
                before[after[at]] = at
            offer([before[at], at])
        return np.array([s for s in symbols if s >= 0], np.int32)

    # ---- texts to ids

    def _spelled(self, symbols: np.ndarray) -> bytes:
        """Ids of symbols, those without a piece in byte pieces."""
        parts = [[x] if x < self.size else self.bytes[list(chr(x - self.size).encode())].tolist() for x in symbols.tolist()]
        return np.array(list(itertools.chain(*parts)), "<i4").tobytes()

    def _fill(self, words: set[str]) -> None:
        """See to it that the cache holds all these words."""
        missing = words.difference(self.cache)
        if not missing:
            return
        if len(self.cache) + len(missing) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {}
            missing = words
        new = []
        for word in missing:
            if word in self.older:
                self.cache[word] = self.older[word]
            else:
                new.append(word)
        if new:
            names, sizes, symbols = self.merge(new)
            ends = np.cumsum(sizes)
            strange = np.maximum.reduceat(symbols, ends - sizes) >= self.size
            ids, cache = symbols.astype("<i4").tobytes(), self.cache
            for name, first, end in zip(names.tolist(), (4 * (ends - sizes)).tolist(), (4 * ends).tolist(), strict=True):
                cache[new[name]] = ids[first:end]
            for at in np.flatnonzero(strange).tolist():
                cache[new[names[at]]] = self._spelled(symbols[ends[at] - sizes[at] : ends[at]])

    def _escaped(self, text: str) -> str:
        return self.lead + text.replace(" ", SPACE)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each whole text as little-endian 32-bit integers; a null or empty text has none."""
        out: list[bytes] = []
        for group in self._groups(texts):
            if len(group) == 1 and len(group[0] or "") > CHARS_AT_ONCE:
                parts = []
                words = (m[0] for m in self.words.finditer(self._escaped(group[0])))
                while some := list(itertools.islice(words, WORDS_AT_ONCE)):
                    self._fill(set(some))
                    parts.append(b"".join(map(self.cache.__getitem__, some)))
                out.append(b"".join(parts))
                continue
            cut = [self.words.findall(self._escaped(text)) if text else [] for text in group]
            self._fill(set(itertools.chain.from_iterable(cut)))
            out += [b"".join(map(self.cache.__getitem__, words)) for words in cut]
        return out

    def _groups(self, texts: Iterable[str | None]) -> Iterator[list[str | None]]:
        """Neighbouring texts, of ``CHARS_AT_ONCE`` characters at most if there are several."""
        group: list[str | None] = []
        chars = 0
        for text in texts:
            size = len(text or "")
            if group and chars + size > CHARS_AT_ONCE:
                yield group
                group, chars = [], 0
            group.append(text)
            chars += size
        if group:
            yield group

    # ---- ids to texts

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: spaces for space signs, without the leading one; bytes that are no UTF-8 become U+FFFD each."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.size):
            raise IndexError("an id outside the vocabulary")
        joined = b"".join(map(self.text.__getitem__, ids.tolist()))
        silent = self.silent[ids]
        try:
            # Byte pieces of whole characters; what other pieces add is UTF-8 by itself.
            text = self._repaired(ids) if silent.any() else joined.decode()
        except UnicodeDecodeError:
            text = self._repaired(ids)
        # The first piece that has any text gives up one space.
        first = ids[np.argmin(silent)] if len(ids) else self.unknown
        spaced = self.lead and first != self.unknown and not self.raw[first] and self.text[first][:1] == b" "
        return text[1:] if spaced else text

    def _repaired(self, ids: np.ndarray) -> str:
        cuts = np.flatnonzero(np.diff(self.raw[ids])) + 1
        parts = []
        for run in np.split(ids, cuts):
            joined = b"".join(self.text[x] for x in run.tolist())
            while joined:
                try:
                    parts.append(joined.decode())
                    break
                except UnicodeDecodeError as error:
                    parts.append(joined[: error.start].decode() + "�")
                    joined = joined[error.start + 1 :]
        return "".join(parts)


def worker_model(path: str) -> PieceModel:
    """This worker process's model; its cache serves the worker's later tasks as well."""
    kept = sys.modules.setdefault("_piece_models", types.ModuleType("_piece_models")).__dict__
    key = repr((path, os.getpid()))
    if key not in kept:
        kept[key] = PieceModel(path)
    return kept[key]


def _with_column(df: DataFrame, source: str, target: str, kind: str, make, keep: Sequence[str] | None) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) and a column ``target``; one of that name is replaced."""
    others = [c for c in (df.columns if keep is None else keep) if c != target]
    names = [f"_{n}" for n in range(len(others))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)], F.col(f"`{source}`").alias("_in"))
    types_ = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for c, n in zip(others, names, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, made in make(batch):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*names, "_out"])

    done = rows.mapInArrow(run, f"{types_}{', ' if types_ else ''}_out {kind}")
    return done.select(*[F.col(n).alias(c) for c, n in zip(others, names, strict=True)], F.col("_out").alias(target))


def encode_pieces(
    df: DataFrame, model: str, text_col: str = "text", ids_col: str = "piece_ids", keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` and its texts' piece ids as ``array<int>``, without begin or end ids.

    A null or empty text has an empty array.  Rows are worked on one by one, so
    repeated rows stay and an empty table gives an empty one; all other columns
    are kept (or those of ``keep``), but for one named ``ids_col``, which is replaced.  Words met before
    are looked up in a bounded cache of the worker; a text of any length is read a
    bounded number of words at a time.
    """

    def make(batch: pa.RecordBatch):
        pieces = worker_model(model)
        step = 200
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            found = pieces.encode(part.column(part.num_columns - 1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            flat = np.frombuffer(b"".join(found), "<i4").astype(np.int32)
            yield part, pa.ListArray.from_arrays(offsets, pa.array(flat))

    return _with_column(df, text_col, ids_col, "array<int>", make, keep)


def decode_pieces(
    df: DataFrame, model: str, ids_col: str = "piece_ids", text_col: str = "decoded", keep: Sequence[str] | None = None
) -> DataFrame:
    """``df`` and the texts of its id arrays; a null array gives a null text, an empty one an empty text.

    An id that is null or no piece of the model is an error.  Repeated rows stay, an
    empty table gives an empty one, and a column named ``text_col`` is replaced.
    """

    def make(batch: pa.RecordBatch):
        pieces = worker_model(model)
        step = 200
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            lists = part.column(part.num_columns - 1)
            texts = [
                None if ids is None else pieces.decode(ids.values.to_numpy(zero_copy_only=False).astype(np.int32))
                for ids in (x if x.is_valid else None for x in lists)
            ]
            yield part, pa.array(texts, pa.string())

    return _with_column(df, ids_col, text_col, "string", make, keep)


@query("op12_sentencepiece")
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, with digests of both."""
    model = public_path("piece_bpe_32k.model")
    ids = encode_pieces(table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    return decode_pieces(ids, model).select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("piece_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )
