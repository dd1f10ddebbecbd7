"""Source divergence, piece encoding and centroid clustering against brute force and the library."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hushframe.llm import divergence_cube, piece_merges, subvector_kmeans
from hushframe.llm.tokens import public_path

MODEL = public_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return piece_merges.PieceModel(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(pieces, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in pieces.encode(texts)]


# ---- sentencepiece

PARTS = ["a", "b", " ", "  ", "▁", "\n", "\t", "\r\n", "é", "中文", "😀", "\0", "ss", "the", " the", "<s>", "</s>", "<unk>", "<0x41>", "==", "--", "23", "�", "ﬁ", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_and_texts_are_the_librarys(pieces, library, parts):
    text = "".join(parts)
    ids = library.encode(text)
    assert ids_of(pieces, [text]) == [ids]
    assert pieces.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_long_words_and_runs(pieces, library):
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" " * n for n in range(70)] + ["=" * n for n in range(70)] + ["ab" * 700, " " * 9_000 + "x", "\t" * 100, "a" * 5_000]
    texts += ["".join(rng.choice(letters) for _ in range(4_000)) for _ in range(5)]
    assert ids_of(pieces, texts) == library.encode(texts)


def test_texts_longer_than_a_group(pieces, library, monkeypatch):
    monkeypatch.setattr(piece_merges, "CHARS_AT_ONCE", 50)
    monkeypatch.setattr(piece_merges, "WORDS_AT_ONCE", 7)
    texts = ["one two  three\n" * 40, "", None, "four", "x" * 200, "five six " * 3]
    assert ids_of(pieces, texts) == library.encode([t or "" for t in texts])


def test_small_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(piece_merges, "CACHE_WORDS", 20)
    small = piece_merges.PieceModel(MODEL)
    texts = [f"word{n} and word{n % 7} again" for n in range(60)]
    for text in texts:
        assert ids_of(small, [text]) == [library.encode(text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(0, 260)), max_size=10))
def test_any_ids_decode_as_in_the_library(pieces, library, ids):
    assert pieces.decode(np.array(ids, np.int32)) == library.decode(ids)


def test_ids_outside_the_vocabulary_are_refused(pieces):
    with pytest.raises(IndexError):
        pieces.decode(np.array([32_000]))


def test_pieces_of_a_table(spark, library):
    texts = [None, "", "Hello  world\n", "Hello  world\n", "中文 😀", "x" * 50_000]
    df = spark.createDataFrame([(i, t, "mine", 1.5) for i, t in enumerate(texts)], "doc_id long, text string, piece_ids string, `a b` double").repartition(3)
    encoded = piece_merges.encode_pieces(df, MODEL)
    assert encoded.columns == ["doc_id", "text", "a b", "piece_ids"]
    rows = {r["doc_id"]: r for r in piece_merges.decode_pieces(encoded, MODEL, text_col="text").collect()}
    for i, text in enumerate(texts):
        assert rows[i]["piece_ids"] == library.encode(text or "")
        assert rows[i]["text"] == (text or "")
    empty = piece_merges.decode_pieces(piece_merges.encode_pieces(df.limit(0), MODEL), MODEL)
    assert empty.count() == 0
    nothing = spark.createDataFrame([(None,), ([],)], "piece_ids array<int>")
    assert [r["decoded"] for r in piece_merges.decode_pieces(nothing, MODEL).collect()] == [None, ""]


def test_whole_documents_round_trip(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in piece_merges.op12_sentencepiece(spark, sf).collect()}
    for row in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(row["text"] or "")
        expected = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert tuple(got[row["doc_id"]])[1:] == expected
    assert len(got) == 200


# ---- centroid clustering


def brute_clusters(rows, k, rounds, dims, scale=64):
    kept = [
        (i, tuple(int(np.floor(scale * float(x))) for x in v))
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)
    ]

    def start(row):
        return (1, "", row[1]) if row[0] is None else (0, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest(), row[1])

    centroids = [list(v) for _, v in sorted(kept, key=start)[:k]]

    def assign():
        out = []
        for i, v in kept:
            apart = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids]
            out.append((i, v, apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, c, _ in assign():
            members[c].append(v)
        centroids = [[sum(x) // len(members[c]) for x in zip(*members[c])] if c in members else old for c, old in enumerate(centroids)]
    found = assign()
    return sorted(((i, c, d) for i, _, c, d in found), key=repr), centroids


VECTORS = st.lists(
    st.one_of(
        st.none(),
        st.lists(st.one_of(st.none(), st.sampled_from([0.0, -0.25, 0.5, 1.0, -1.01, 3.3, float("nan"), float("inf")])), min_size=3, max_size=3),
        st.lists(st.floats(-2, 2, width=32), min_size=2, max_size=4),
    ),
    max_size=25,
)


@settings(max_examples=6, deadline=None)
@given(VECTORS)
def test_clusters_against_brute_force(spark, vectors):
    rows = [(n % 20, v, 7) for n, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").repartition(3)
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = subvector_kmeans.cluster_vectors(df, dims=3, k=4, rounds=3, block=2)
    expected, centroids = brute_clusters(rows, 4, 3, 3)
    assert sorted(map(tuple, found.assigned.collect()), key=repr) == expected
    assert found.centroids == centroids
    sums = Counter()
    for _, c, d in expected:
        sums[c] += d
    assert found.inertia == {c: sums[c] for c in {c for _, c, _ in expected}}


def test_chunks_lose_nothing(spark):
    rng = np.random.default_rng(5)
    vectors = rng.integers(-40, 40, (500, 5)) / 64
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<double>")
    for row in subvector_kmeans.encode_chunks(df, "id", "vector", 5, 64, 2).collect():
        back = np.concatenate([entries[codes] for _, entries, codes in subvector_kmeans._blocks(row.asDict(), 5, 2)], axis=1)
        assert (back == vectors[row["ids"]] * 64).all()


def test_components_too_large_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="summed exactly"):
        subvector_kmeans.cluster_vectors(df, dims=2)


# ---- source divergence


def brute_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall((text or "").translate(lower))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    kept = {lang: sorted(t for t, n in found.items() if n >= min_docs) for lang, found in docs.items()}

    def shares(count, words):
        below = sum(count[t] for t in words) + 5 * len(words)
        return {t: 1 + 10**9 * (count[t] + 5) // below for t in words}

    for (lang, source), count in groups.items():
        words = kept[lang]
        whole = Counter()
        for (other, _), c in groups.items():
            if other == lang:
                whole.update(c)
        p, q = shares(count, words), shares(whole, words)
        pairs = []
        for (other, name), c in groups.items():
            if other == lang and name != source:
                r = shares(c, words)
                pairs.append((-sum(abs(p[t] - r[t]) for t in words), name.encode()))
        own = sorted((q[t] - p[t], t.encode()) for t in words if count[t] and p[t] > q[t])[:top]
        for part, found in (("pair", sorted(pairs)), ("term", own)):
            out += [(lang, source, part, item.decode(), -value, rank + 1) for rank, (value, item) in enumerate(found)]
    return sorted(out)


WORDS = ["a", "B", "b", "Ä", "ä", "über", "x_y", "it's", "\U0001f600", "￿", "z9z", "中文", "the", "The", "q" * 300]


@pytest.mark.parametrize("group_block,term_block", [(16, 4096), (2, 3), (1, 1)])
def test_divergence_against_brute_force(spark, group_block, term_block):
    rng = random.Random(group_block)
    rows = [
        (rng.choice([None, ""] + [" ".join(rng.choices(WORDS, k=rng.randint(0, 40)))] * 6), rng.choice(["en", "de", None, ""]), rng.choice([None, "", "s1", "s2", "s3", "ß", "s4"]))
        for _ in range(150)
    ]
    rows += [("only here", "xx", "lonely"), ("", "yy", "a"), (None, "yy", "b"), ("a " * 3_000, "en", "s1")] + [("the same a b", "en", "s1")] * 50
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "text string, lang string, source string, rank int, part string").repartition(5)
    found = divergence_cube.source_divergence(df, min_docs=8, top=4, group_block=group_block, term_block=term_block)
    assert sorted(map(tuple, found.collect())) == brute_divergence(rows, 8, 4)


def test_divergence_of_no_rows(spark):
    assert divergence_cube.source_divergence(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_counts_are_handed_on_and_long_texts_read_in_parts(spark, monkeypatch):
    text = "alpha Beta " * 500 + "gamma"
    monkeypatch.setattr(divergence_cube, "BYTES_AT_ONCE", 100)
    lists = list(divergence_cube._term_lists(text))
    assert len(lists) > 20
    assert Counter(t for part in lists for t in part) == Counter({b"alpha": 500, b"beta": 500, b"gamma": 1})
    df = spark.createDataFrame([("en", "s", text)] * 3, "lang string, source string, text string").coalesce(1)
    counts = {r["term"]: (r["n"], r["docs"]) for r in divergence_cube.count_terms(df).collect()}
    assert counts == {None: (0, 0), "alpha": (1500, 3), "beta": (1500, 3), "gamma": (3, 3)}


def test_cells_are_bounded_by_their_blocks(spark):
    rows = [(f"w{i} w{i + 1} w{i + 2}", "en", f"s{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    found = divergence_cube.source_divergence(df, min_docs=1, group_block=8, term_block=16)
    assert found.filter("part = 'pair'").count() == 40 * 39
    assert found.filter(F.col("value") < 0).count() == 0


# ---- rows that share an id


def test_near_dedup_and_decontamination_lose_no_text_of_a_shared_id(spark):
    from hushframe.llm import decontaminate, simhash_pivots

    rng = random.Random(9)
    names = ["".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    a, b, leak = (" ".join(rng.choices(names, k=60)) for _ in range(3))
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (3, b + " " + leak, 3), (3, a[::-1], 4), (None, a, 5), (4, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row_no int").repartition(3)
    for kept in (simhash_pivots.keep_first_similar(df), simhash_pivots.keep_first(df)):
        assert sorted(r["_row_no"] for r in kept.collect()) == [0, 2, 3, 4, 5, 6]
    items = spark.createDataFrame([(7, leak)], "item_id long, text string")
    assert sorted(r["_row_no"] for r in decontaminate.drop_contaminated(df, items).collect()) == [0, 1, 2, 4, 5, 6]
