"""Windows of open runs are cut into blocks first; only blocks that share a core are hashed window by window."""

import random

from hushframe.llm import suffix_windows


def brute(texts, threshold):
    """Removed places of each text (in order of the ids): those under a string that also starts earlier."""
    seen, out = set(), []
    for raw in texts:
        gone = set()
        for at in range(len(raw) - threshold + 1):
            window = raw[at : at + threshold]
            if window in seen:
                gone.update(range(at, at + threshold))
            seen.add(window)
        out.append(gone)
    return out


def found(spark, texts, threshold):
    df = spark.createDataFrame([(i, raw.decode()) for i, raw in enumerate(texts)], "doc_id long, text string")
    rows = suffix_windows.remove_repeats(df, threshold).collect()
    spans = {row.doc_id: {place for span in row.spans for place in range(span.start, span.end)} for row in rows}
    return [spans[i] for i in range(len(texts))]


def noise(rng, n, letters="abcdefghijklmnop"):
    return "".join(rng.choices(letters, k=n)).encode()


def test_a_string_too_short_opens_no_window(spark, monkeypatch):
    rng, counts, stored = random.Random(1), {}, suffix_windows.stored

    def counted(df, name):
        out = stored(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(suffix_windows, "stored", counted)
    shared = noise(rng, 90)
    texts = [noise(rng, 300) + shared + noise(rng, 300) for _ in range(4)]
    assert found(spark, texts, 100) == [set()] * 4
    assert counts["blocks"] > 0
    assert counts["windows"] == 0


def test_blocks_lose_no_window(spark):
    rng = random.Random(2)
    passages = [noise(rng, n) for n in (100, 101, 107, 108, 130, 99)]
    period = [b"ab" * 90, b"a" * 220, noise(rng, 30) * 6, noise(rng, 7) * 25]
    texts = []
    for _ in range(60):
        parts = [noise(rng, rng.randrange(60)), rng.choice(passages), noise(rng, rng.randrange(4)), rng.choice(period), rng.choice(passages)]
        whole = b"".join(parts)
        cut = rng.randrange(20)
        texts.append(whole[cut : len(whole) - rng.randrange(20)])
    for threshold in (25, 40, 100):
        assert found(spark, texts, threshold) == brute(texts, threshold)
