"""Exact operators against brute force: url filters, exact dedup, repeated windows, fingerprints."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hushframe.llm import exact_dedup, simhash_pivots, suffix_windows, url_filter
from hushframe.llm.components import components


def rows_of(df, *columns):
    return sorted((tuple(row[c] for c in columns) for row in df.collect()), key=repr)


# ---- url filters

URLS = [
    None, "", "no scheme", "http://", "http://NET/x", "http://a.b.Example.NET/en/1?q#f", "https://example.net/de/", "http://examplenet/en/",
    "http://xexample.net/en/", "http://example.com/de/x", "http://example.com/dex", "http://example.com?de/", "http://q.org/fr/#z",
    "http://org/fr/", "http://q.org/f", "x://y://net/a", "http://" + "a." * 3000 + "net/" + "p" * 5000, "http://net", "http://net/",
    "http://example.net./en/", "http://ÄÖ.net/é",
]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS + URLS)], "page_id long, url string, verdict string")
    got = rows_of(url_filter.filter_urls(df, url_filter.RULES), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i, *judge(u, url_filter.RULES)) for i, u in enumerate(URLS + URLS)), key=repr)


def test_urls_without_rows_or_rules(spark):
    empty = spark.createDataFrame([], "url string")
    assert url_filter.filter_urls(empty, url_filter.RULES).count() == 0
    some = spark.createDataFrame([("http://net/",)], "url string")
    assert rows_of(url_filter.filter_urls(some, ()), "rule", "verdict") == [(None, "allow")]
    with pytest.raises(ValueError):
        url_filter.filter_urls(some, (("allow", "net", "/"), ("block", "net", "/")))


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("crc32(cast(key AS binary)) % 7 = 0")
    cascade = url_filter.build_cascade(listed, universe.union(universe))
    assert len(cascade.levels) > 1
    wrong = universe.filter(cascade.contains(F.col("key")) != F.expr("crc32(cast(key AS binary)) % 7 = 0"))
    assert wrong.count() == 0


# ---- exact dedup

TEXTS = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 100_000), (8, "X" * 100_000), (9, "aBC"), (None, "abc"), (None, "solo")]


def expected_copies(rows):
    low = {}
    for i, t in rows:
        low.setdefault("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""), []).append(i)
    out = []
    for t, ids in low.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda t: F.encode(F.length(t).cast("string"), "utf-8")])
@pytest.mark.parametrize("salts", [1, 16])
def test_copies_even_where_digests_collide(spark, digest, salts):
    rows = TEXTS + [(9, "aBC")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, keep_id int").repartition(4)
    got = rows_of(exact_dedup.exact_dedup(df, digest=digest, salts=salts), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == expected_copies(rows)


def test_no_copies_without_rows(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- repeated windows


def brute_windows(rows, threshold):
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for at in range(len(raw) - threshold + 1):
            window = raw[at : at + threshold]
            if window in seen:
                gone[at : at + threshold] = b"\1" * threshold
            seen.add(window)
        spans = sum(1 for q in range(len(raw)) if gone[q] and (q == 0 or not gone[q - 1]))
        out[i] = (len(raw), sum(gone), spans, bytes(x for x, g in zip(raw, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("threshold", [30, 100])
def test_windows_against_brute_force(spark, threshold):
    draw = random.Random(threshold)
    rows = [(1, None), (2, ""), (3, "a" * 400), (4, "ab" * 200), (5, "short")]
    for i in range(6, 60):
        text = "".join(draw.choice("abé ") for _ in range(draw.randint(0, 150)))
        kind = draw.random()
        if kind < 0.3:
            text *= draw.randint(2, 6)
        elif kind < 0.8:
            other = draw.choice(rows)[1] or ""
            text += other[len(other) // 4 :] + text[:40]
        rows.append((i * 2, text))
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, first string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_windows.remove_repeats(df, threshold).collect()}
    assert got == brute_windows(rows, threshold)


@pytest.mark.parametrize("threshold", [30, 100])
@pytest.mark.parametrize("copied", [False, True])
def test_windows_of_texts_with_a_period(spark, threshold, copied):
    draw = random.Random(threshold)
    width = threshold - suffix_windows.GRAM + 1
    rows = []
    for period in (width - 1, width, width + 1):
        for times in (3, 5):
            line = "".join(draw.choice("abcdefgh ") for _ in range(period - 1)) + "\n"
            rows += [(len(rows) + at, line * times) for at in range(2 if copied else 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_windows.remove_repeats(df, threshold).collect()}
    assert got == brute_windows(rows, threshold)


def test_windows_of_repeated_and_missing_ids(spark):
    draw = random.Random(1)
    long = "".join(draw.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(7, long), (7, long), (None, "x" + long), (7, "other")], "doc_id long, text string")
    got = rows_of(suffix_windows.remove_repeats(df, 100), "doc_id", "n_bytes", "n_removed")
    # The row without an id comes first; the repeated row is one document, and all of it stands in the former.
    assert got == sorted([(7, 300, 300), (7, 300, 300), (None, 301, 0), (7, 5, 0)], key=repr)
    assert suffix_windows.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- fingerprints


def brute_print(text, size):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots_of(values, k):
    root = {i: i for i in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(values)
    prints = np.array([values[i] for i in ids], np.uint64)
    for at, i in enumerate(ids):
        for other in np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= k):
            a, b = find(i), find(ids[other])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    draw = random.Random(5)
    base = [" ".join(draw.choice("red green blue black white".split()) for _ in range(n)) for n in (0, 1, 2, 3, 200, 200)]
    rows = [(i, t) for i, t in enumerate(base + [None, "RED\tgreen\u00a0x", "red " * 3000])]
    rows += [(100 + i, base[4].replace("red", "reddish", i)) for i in range(6)] + [(200, base[5].upper())]
    df = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, fp string")
    found = simhash_pivots.near_duplicates(df, shingle=3).collect()
    prints = {i: brute_print(t, 3) for i, t in rows}
    assert {r.doc_id: r.fp & (2**64 - 1) for r in found} == prints
    assert {r.doc_id: r.component_id for r in found} == roots_of(prints, 2)
    assert sorted(r.doc_id for r in simhash_pivots.keep_first(df, shingle=3).collect()) == sorted(set(roots_of(prints, 2).values()))


@pytest.mark.parametrize("pairwise", [4, 48])
def test_links_of_crowded_keys(spark, pairwise):
    draw = np.random.default_rng(0)
    values = set()
    for base in draw.integers(0, 2**63, 4, dtype=np.uint64):
        for _ in range(60):
            value = int(base)
            for bit in draw.integers(0, 64, draw.integers(0, 5)):
                value ^= 1 << int(bit)
            values.add(value)
    prints = dict(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(i, v - 2**64 if v >> 63 else v) for i, v in prints.items()], "node long, fp long")
    found = {r.node: r.root for r in components(simhash_pivots.near_links(nodes, 2, pairwise)).collect()}
    assert {i: found.get(i, i) for i in prints} == roots_of(prints, 2)


def test_similar_documents_against_all_pairs(spark):
    draw = random.Random(12)
    vocabulary = [f"w{i}" for i in range(2000)]
    rows = [(0, ""), (1, None), (2, "one two"), (3, "ONE  two"), (None, "one two"), (4, "one two three")]
    for size in (20, 60, 100, 200, 500):
        for _ in range(4):
            base = [draw.choice(vocabulary) for _ in range(size)]
            for _ in range(6):
                words = list(base)
                for _ in range(draw.randint(0, max(1, size // 40))):
                    words[draw.randrange(size)] = draw.choice(vocabulary)
                rows.append((10 + len(rows), " ".join(words)))
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {" ".join(words[at : at + 5]) for at in range(max(1, len(words) - 4))} - {""}
    root = {i: i for i in sets if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    want = sorted(i for i in root if find(i) == i)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    left = simhash_pivots.keep_first_similar(df)
    assert left.columns == df.columns
    got = [r.doc_id for r in left.collect()]
    assert None in got and sorted(i for i in got if i is not None) == want
    # Two bits leave most of them in.
    assert simhash_pivots.keep_first(df).count() > len(want) + 10
    assert simhash_pivots.keep_first_similar(df.limit(0)).count() == 0


def test_near_duplicates_without_ids_or_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, "q")], "doc_id long, text string")
    assert rows_of(simhash_pivots.near_duplicates(df), "doc_id", "component_id") == sorted([(None, 4), (4, 4), (None, None)], key=repr)
    assert simhash_pivots.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 1), (2, 2), (9, 3), (3, 7), (7, 2), (20, 21)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "root"))
    assert got == {**dict.fromkeys((1, 2, 3, 7, 9), 1), 20: 20, 21: 20, **dict.fromkeys(range(100, 141), 100)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
