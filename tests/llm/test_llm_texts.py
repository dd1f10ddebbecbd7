"""Operators on words, tokens and labels: licenses, lines, packing, token files, decontamination, toxicity, pipeline."""

import random
import struct
import textwrap
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hushframe.llm import decontaminate, license_scan, line_dedup, packing, token_orc, toxicity
from hushframe.llm import tokens as tokens_module
from hushframe.llm.tokens import ChunkEncoder, public_path

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  a  b ", "a\n b", "don't  it's", "e\u0301 \u0301x", "\x1c a", "Σ ΣΑΣ.", "<|endoftext|> a", "a\tb \t c\r\n",
    "word...\n\nnext?!", "a.'s b", "日本 語、", "٣ ٤", "12 34.5", "foo|bar|", "\n", "a\n", "\na", "a.\nb, c\n\nd", "naïve.'t", "İß ÿ",
]


# ---- tokens


@pytest.mark.parametrize(("name", "word_ends"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
@pytest.mark.parametrize("cache", [10, 100_000])
def test_chunks_give_the_tokenizers_ids(monkeypatch, name, word_ends, cache):
    monkeypatch.setattr(tokens_module, "CACHE_CHUNKS", cache)
    encoder = ChunkEncoder(public_path(name), word_ends)
    plain = Tokenizer.from_file(public_path(name))
    draw = random.Random(2)
    texts = ODD + ["".join(draw.choice("ab é.,'s\n\t 1²|Σ\u0301") for _ in range(draw.randint(1, 40))) for _ in range(1500)]
    for text in texts:
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        assert encoder.ids(text) == struct.pack(f"<{len(ids)}I", *ids), text
    for text in ["<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>y <|startoftext|>z", "<|endof text|>", *texts[::-1]]:
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        assert encoder.ids(text) == struct.pack(f"<{len(ids)}I", *ids), text
    assert plain.encode("<|endoftext|>", add_special_tokens=False).ids == [49407 if word_ends else 50256]


# ---- packing


def check_sequences(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def least_sequences(sizes, capacity):
    """The optimum, by trying all ways (small instances)."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for at in range(len(bins)):
            if bins[at] + sizes[i] <= capacity and bins[at] not in bins[:at]:
                bins[at] += sizes[i]
                place(i + 1, bins)
                bins[at] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_dominance_never_costs_a_sequence():
    draw = random.Random(1)
    for _ in range(300):
        capacity = draw.randint(6, 30)
        sizes = [draw.randint(1, capacity) for _ in range(draw.randint(1, 9))]
        counts = np.bincount(sizes, minlength=capacity + 1)
        fixed, rest = packing.reduce_by_dominance(counts, capacity)
        left = [s for s in range(capacity + 1) for _ in range(rest[s])]
        assert sum(times for _, times in fixed) + least_sequences(left, capacity) == least_sequences(sizes, capacity), (sizes, capacity)
        used = np.zeros(capacity + 1, int)
        for items, times in packing.solve(counts, capacity):
            assert sum(s * n for s, n in items) <= capacity
            for s, n in items:
                used[s] += n * times
        assert (used == counts).all()


def test_packing_documents(spark):
    texts = [(i, t) for i, t in enumerate(ODD)] + [(90, None), (91, "word " * 5000), (92, "the cat " * 10), (92, "the cat " * 10), (None, "x")]
    df = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack_documents(df, public_path("word_bpe_49k.json"), 256).collect()
    check_sequences(rows, 256)
    encoder = ChunkEncoder(public_path("word_bpe_49k.json"), True)
    expected = []
    for i, t in texts:
        ids = encoder.ids(t)
        expected += [(i, n, at // 4, len(ids[at : at + 1024]) // 4, zlib.crc32(ids[at : at + 1024])) for n, at in enumerate(range(0, len(ids), 1024))]
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows], key=repr) == sorted(expected, key=repr)
    assert packing.pack_documents(df.limit(0), public_path("word_bpe_49k.json")).count() == 0


def test_packing_a_large_instance_is_close_to_full(spark):
    draw = random.Random(4)
    sizes = [min(2048, int(draw.lognormvariate(5, 1.2)) + 1) for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long").repartition(6)
    n = check_sequences(packing.pack(df, 2048, ["doc_id"]).collect(), 2048)
    assert n <= -(-sum(sizes) // 2048) * 1.01 + 1


def test_packing_refuses_other_sizes(spark):
    for size in (0, 11, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(1, size)], "doc_id long, length long"), 10, ["doc_id"])


# ---- token files


def test_token_files_round_trip(spark, tmp_path):
    texts = [(5 * i, t) for i, t in enumerate(ODD)] + [(3, None), (7, "word " * 20_000), (7, "again"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, row_id int").repartition(4)
    path = str(tmp_path / "tokens")
    token_orc.write_token_files(df, path, public_path("byte_bpe_50k.json"), row_index_stride=1000)
    tokens = token_orc.read_token_files(spark, path)
    encoder = ChunkEncoder(public_path("byte_bpe_50k.json"), False)
    want = sorted(((i, list(np.frombuffer(encoder.ids(t), "<u4"))) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.tokens) for r in tokens.collect()), key=repr) == want
    digests = token_orc.document_digests(tokens).collect()
    at = 0
    for r in sorted(digests, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert at == sum(len(ids) for _, ids in want)
    order = [r.doc_id for r in sorted(digests, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in tokens.filter("doc_id = 7")._jdf.queryExecution().toString()


def test_token_files_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_orc.write_token_files(df, str(tmp_path / "none"), public_path("byte_bpe_50k.json"))
    rows = spark.read.schema("doc_id long, row_id long, n_tokens int, tokens array<int>").orc(str(tmp_path / "none"))
    assert token_orc.document_digests(rows).count() == 0


# ---- licenses


def brute_matches(text, templates, containment):
    """Labels of the templates that some line (all lines here are short) holds."""
    out = set()
    for line in (text or "").split("\n"):
        words = set(license_scan.words_of(line))
        for label, template in templates:
            need = set(license_scan.words_of(template))
            if len(words & need) >= containment * len(need) - 1e-9:
                out.add(label)
    return out


def test_licenses_against_brute_force(spark):
    draw = random.Random(9)
    pool = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()}) + ["foo", "bar"]
    texts = [None, "", "CC-BY cc by cc by", "all rights reserved rights reserved", "General  Public\nLicense", "x" * 200_000]
    for _ in range(200):
        label, template = draw.choice(license_scan.TEMPLATES)
        words = [w for w in template.split() if draw.random() < 0.85] + draw.sample(pool, 3)
        draw.shuffle(words)
        texts.append("some text\n" + " ".join(words) + "\nthe end of the work")
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in license_scan.scan_licenses(df.repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = license_scan.words_of(t)
        starts = [at for p, _ in license_scan.BASE_PHRASES for at in range(len(words)) if words[at : at + len(p.split())] == p.split()]
        base = {label for p, label in license_scan.BASE_PHRASES if f" {p} " in f" {' '.join(words)} "}
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | brute_matches(t, license_scan.TEMPLATES, 0.8))), t
        assert 0 <= r.score <= 1
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_a_notice_across_windows_is_found(spark):
    notice = dict(license_scan.TEMPLATES)["mit"]
    for lead in (0, 7, 20, 33, 50):
        text = " ".join(["foo"] * lead) + " " + notice + " bar" * 200
        r = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        assert r.labels == "mit"


@pytest.mark.parametrize("width", [30, 45, 75])
def test_a_notice_wrapped_over_lines_is_found(spark, width):
    texts = [
        ["foo bar " * lead + "\n" + "\n * ".join(textwrap.wrap(notice, width)) + "\n\n" + "bar foo\n" * 60 for lead in (0, 9, 40)]
        for label, notice in license_scan.TEMPLATES if label in ("mit", "bsd", "apache-2.0", "mpl-2.0")
    ]
    rows = [(i, text) for i, text in enumerate(t for group in texts for t in group)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = license_scan.scan_licenses(df, across_lines=True).collect()
    labels = {r.doc_id: r.labels for r in found}
    assert [labels[i] for i, _ in rows] == [x for x in ("apache-2.0", "bsd", "mit", "mpl-2.0") for _ in range(3)]
    assert all(r.score == 1 for r in found)
    # Line by line the longer ones are lost.
    assert sum(r.labels != "" for r in license_scan.scan_licenses(df).collect()) < len(rows)


# ---- lines

LONG = "the river ran past the old mill and the quiet village until it met the wide grey sea beyond the hills "


def test_lines_exact_fuzzy_and_short(spark):
    twenty = LONG * 20
    rows = [
        (1, "One fine line of five words\nshort one\n" + twenty, 1),
        (2, "ONE fine line, of five words 77!\nshort one\nown line with enough words here", 2),
        (3, twenty.replace("quiet", "silent", 1), 3),
        (4, None, 4), (5, "", 5), (None, "One fine line of five words", 6),
        (6, "one fine line of five words", 7),
        (7, "\n\none fine line of five words\n", 8),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(3)
    got = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got[1] == rows[0][1]
    assert got[2] == "own line with enough words here"
    assert 3 not in got and 6 not in got  # nothing is left of them
    assert got[4] is None and got[5] == "" and got[None] == rows[5][1] and got[7] == "\n\n"
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0
    assert line_dedup.drop_repeated_lines(df.limit(0), k=2).count() == 0


def test_rows_that_share_an_id_lose_no_text(spark):
    a, b = "first line of five words", "another line with other words here"
    rows = [(1, a, 0), (2, a, 1), (2, b, 2), (2, b, 3), (2, None, 4), (2, a + "\n" + b, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long").repartition(3)
    # The repeated row counts as one document, and both stay; only one text keeps each line.
    left = sorted((r.row, r.text) for r in line_dedup.drop_repeated_lines(df).collect())
    kept = [text for _, text in left if text]
    assert (0, a) in left and (4, None) in left and sum(b in text.split("\n") for text in kept) >= 1
    assert {line for text in kept for line in text.split("\n")} == {a, b}


@pytest.mark.parametrize("long_line", [0, 500])
def test_edits_of_long_and_short_lines(spark, monkeypatch, long_line):
    monkeypatch.setattr(line_dedup, "LONG_LINE", long_line)
    draw = random.Random(4)
    pairs = []
    for _ in range(80):
        a = "".join(draw.choice("ab\U00012345\U00054321") for _ in range(draw.randint(1, 12)))
        b = "".join(c for c in a if draw.random() > 0.2) + draw.choice(["", "a", "\U00054321"])
        pairs.append((a, b, draw.randint(0, 4)))
    df = spark.createDataFrame(pairs, "a string, b string, allowed int")
    got = df.select(line_dedup.within_edits(F.col("a"), F.col("b"), F.col("allowed")).alias("near")).collect()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert [r["near"] for r in got] == [distance(a, b) <= n for a, b, n in pairs]


@pytest.mark.parametrize("pairwise", [1, 256])
def test_crowded_keys_give_the_same_links(spark, monkeypatch, pairwise):
    monkeypatch.setattr(line_dedup, "PAIRWISE_KEY", pairwise)
    monkeypatch.setattr(line_dedup, "KNOWN_GRAMS", 0)
    draw = random.Random(5)
    names = ["".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    lines = ["all rights are reserved by " + " ".join(draw.choice(names) for _ in range(draw.choice([1, 1, 2, 8]))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    want = sorted((i, r) for i, r in enumerate(similar_roots(lines)) if i != r)
    assert sorted((r.doc.id, r.keep_doc.id) for r in line_dedup.repeated_lines(df, rows_per_salt=2).collect()) == want


def test_bags_never_part_similar_lines():
    draw = random.Random(8)
    names = [f"w{n}" for n in range(300)]
    for _ in range(300):
        a = [draw.choice(names) for _ in range(draw.randint(1, 90))]
        b = [w for w in a if draw.random() > 0.1] or a
        b += [draw.choice(names) for _ in range(draw.randint(0, 5))]
        bags = line_dedup.bags_of(*line_dedup.word_hashes(pa.array([" ".join(a), " ".join(b)])))
        for x, y, own, other in ((0, 1, a, b), (1, 0, b, a)):
            apart = sum(int(np.bitwise_count((bag[x] & ~bag[y]).astype(np.uint64))) for bag in bags)
            assert apart <= sum(w not in other for w in own)


def test_line_groups_against_all_pairs(spark):
    draw = random.Random(6)
    words = LONG.split()
    lines = []
    for _ in range(6):
        base = [draw.choice(words) for _ in range(150)]
        for _ in range(12):
            changed = list(base)
            for _ in range(draw.randint(0, 3)):
                changed[draw.randrange(150)] = draw.choice(words)
            lines.append(" ".join(changed))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    nodes = line_dedup.line_nodes(df, "doc_id", "text")
    found = {r.node: r.fp for r in line_dedup.with_simhash(nodes).collect()}
    by_norm = {r.norm: found[r.node] for r in nodes.collect()}
    prints = [by_norm[line] for line in lines]
    for i, line in enumerate(lines[:20]):
        hashes = [xxhash.xxh64_intdigest(word, 42) for word in line.split()]
        assert prints[i] == sum(1 << b for b in range(62) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            near = (prints[a] ^ prints[b]).bit_count() <= 2
            if near and distance(lines[a].split(), lines[b].split()) <= 0.2 * 150:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted((i, find(i)) for i in range(len(lines)) if find(i) != i)
    got = sorted((r.doc.id, r.keep_doc.id) for r in line_dedup.repeated_lines(df, k=2).collect())
    assert got == want and want


def test_short_lines_and_scripts_without_spaces(spark):
    chinese, thai = "这条河流过老磨坊和安静的村庄直到大海", "แม่น้ำไหลผ่านโรงสีเก่าและหมู่บ้าน"
    first = ["Read more", "All rights reserved.", "12 / 34", "-----", chinese, thai, "", "  ", "one two three four", "河", "3-4"]
    second = [
        "READ more!", "all rights reserved", "12 / 34", "-----", chinese.replace("老", "旧"), thai, "", "  ", "one two three five", "河。", "4-3",
        "hao 你好 hao",
    ]
    rows = [(1, "\n".join(first)), (2, "\n".join(second)), (None, "Read more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc.id, r.line, r.keep_doc.id, r.keep_line) for r in line_dedup.repeated_lines(df).collect()}
    assert found == {(2, at, 1, at) for at in (0, 1, 2, 3, 4, 5, 9)}
    left = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(df).collect()}
    assert left == {1: rows[0][1], 2: "\n  \none two three five\n4-3\nhao 你好 hao", None: "Read more"}


def similar_roots(lines, similarity=0.8):
    """The smallest line that each is linked to, by edits of words between all pairs."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a].split(), lines[b].split()
            allowed = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
            if abs(len(x) - len(y)) <= allowed and distance(x, y) <= allowed:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(lines))]


@pytest.mark.parametrize("known", [0, 200_000])
def test_similar_lines_against_all_pairs(spark, monkeypatch, known):
    monkeypatch.setattr(line_dedup, "KNOWN_GRAMS", known)
    draw = random.Random(11)
    words = LONG.split() + ["".join(draw.choice("abcdefgh") for _ in range(4)) for _ in range(60)]
    lines = ["la " * 9 + "la", "la " * 10 + "lo", "la " * 8 + "la"]
    for size in (5, 6, 8, 9, 10, 14, 20, 29, 40):
        for _ in range(3):
            base = [draw.choice(words) for _ in range(size)]
            for _ in range(4):
                changed = list(base)
                for _ in range(draw.randint(0, size // 5)):
                    at, kind = draw.randrange(len(changed)), draw.random()
                    changed[at : at + 1] = [] if kind < 0.2 else [draw.choice(words)] if kind < 0.8 else [changed[at], draw.choice(words)]
                if len(changed) >= 5:
                    lines.append(" ".join(changed))
    lines = [line.strip() for line in lines]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    roots = similar_roots(lines)
    want = sorted((i, r) for i, r in enumerate(roots) if i != r)
    assert sorted((r.doc.id, r.keep_doc.id) for r in line_dedup.repeated_lines(df).collect()) == want
    # Two bits find few of them.
    assert line_dedup.repeated_lines(df, k=2).count() < len(want) * 0.8


# ---- decontamination


def test_leaks(spark):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(3000)]

    def prose(n):
        return " ".join(draw.choice(vocabulary[:40] if draw.random() < 0.5 else vocabulary) for _ in range(n))

    items = [(i, prose(draw.randint(15, 50))) for i in range(40)] + [(90, None), (91, ""), (92, "!!")]
    docs, want = [], set()
    for i in range(300):
        text = prose(draw.choice([5, 60, 400]))
        if i % 6 == 0:
            item, passage = items[i // 6 % 40]
            words = passage.split()
            if i % 12 == 0:  # a paraphrase: a quarter of the words before the answer change
                for at in range(0, len(words) - 8, 4):
                    words[at] = draw.choice(vocabulary)
            text += " " + " ".join(words).upper() + ". " + prose(30)
            want.add((i, item))
        docs.append((i, text, 1.0))
    docs += [(1000, None, 1.0), (1001, "", 1.0), (None, prose(20), 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, cosine double").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, benchmark).collect()}
    assert got == want
    left = decontaminate.drop_contaminated(df, benchmark)
    assert left.columns == df.columns and left.count() == len(docs) - len({i for i, _ in want})
    assert decontaminate.find_leaks(df.limit(0), benchmark).count() == 0
    assert decontaminate.find_leaks(df, benchmark.limit(0)).count() == 0


def test_items_of_very_different_lengths_do_not_share_a_pass(spark):
    draw = random.Random(4)
    vocabulary = ["".join(draw.choice("bcdfglmnprst") + draw.choice("aeiou") for _ in range(3)) for _ in range(2000)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 12, 15, 18, 40, 59, 61, 500, 900])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate.benchmark_blocks(benchmark, decontaminate.Settings()))
    assert sorted(item.id for block in blocks for item in block) == list(range(9))
    for block in blocks:
        sizes = [len(item.words) for item in block]
        assert max(sizes) <= 4 * min(sizes)
    docs = [(i, " ".join(draw.choice(vocabulary) for _ in range(2000)) + f" {text} end") for i, text in items]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    assert got >= {(i, i) for i in range(1, 9)}


def test_common_subsequence():
    draw = random.Random(8)
    for _ in range(200):
        a, b = ([draw.choice([b"x", b"y", b"z"]) for _ in range(draw.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(decontaminate.Item(1, tuple(a), 1).masks(), len(a), b) == table[-1][-1]


# ---- toxicity


def labelled(spark, biased):
    draw = random.Random(7)
    rows = []
    for i in range(600):
        words = [draw.choice("tree house river road cloud stone lamp".split()) for _ in range(10)]
        toxic = i % 3 == 0
        if toxic:
            words.append("vilefool")
        if draw.random() < (0.6 if toxic else 0.1) * biased:
            words.append("muslims")
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows, "id long, text string, label int")


def test_counterfactuals_take_the_weight_off_group_terms(spark):
    data = labelled(spark, 1)
    free = toxicity.fit(data, settings=toxicity.Settings(counterfactual=0.0))
    bound = toxicity.fit(data, settings=toxicity.Settings(counterfactual=10.0))

    def change(model):
        return abs(model.weights.get("muslims", 0) - model.weights.get("buddhists", 0))

    assert change(bound) < 0.1 < 1 < change(free)
    assert bound.scorer()("tree vilefool") > 0.7 > 0.3 > bound.scorer()("tree muslims")


def test_toxicity_of_odd_inputs(spark):
    model = toxicity.fit(labelled(spark, 0))
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "VILEFOOL " * 20_000, 5)], "doc_id long, text string, score int")
    rows = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(df, model).collect()}
    assert rows[1] == rows[2] and rows[2][1] == 0 and rows[3][1] == 1
    assert sorted(r.score for r in toxicity.keep_clean(df, model).collect()) == [5, 5]
    none = toxicity.fit(spark.createDataFrame([], "id long, text string, label int"))
    assert none.scorer()("x") == 0.5
    same = toxicity.fit(spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None)], "id long, text string, label int"))
    assert same.scorer()("a") > 0.5


def test_held_out_accuracy(spark):
    from hushframe.llm.queries import QUERIES

    scored = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01")
    rows = scored.filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.9


# ---- pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        left = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert left.columns == docs.columns and left.schema.simpleString() == docs.schema.simpleString()
            left = spark.createDataFrame(left.collect(), left.schema)
            assert 0 < left.count() <= docs.count()
        docs = left
    assert check_sequences(docs.collect(), 2048) > 0
