import hashlib
import random
from collections import Counter

from loomwork.llm import repeats


def brute(texts, least):
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        n = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), n, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


def texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, out = prose(120), []
    for i in range(40):
        out.append(prose(rnd.randint(0, 300)))
        a = rnd.randint(0, 60)
        out.append(f"{prose(rnd.randint(0, 60))} {shared[a : a + rnd.randint(90, 300)]} {prose(rnd.randint(0, 60))}")
    out += [out[0], out[0], out[3][:-5] + "x", None, "", "x" * 5000, "xy" * 700, shared + "!" + shared, shared]
    return out


def test_blocks_match_counting():
    rnd = random.Random(3)
    for least in (1, 2, 7):
        for _ in range(40):
            parts = [bytes(rnd.choice(b"ab\0\xff") for _ in range(rnd.randint(least, 40))) for _ in range(rnd.randint(1, 9))]
            seen = Counter(p[i : i + least] for p in parts for i in range(len(p) - least + 1))
            assert [x.tolist() for x in repeats.repeated(parts, least)] == [[seen[p[i : i + least]] > 1 for i in range(len(p) - least + 1)] for p in parts]


def test_all_sizes_of_groups_match_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(None, texts()[1], "en"), (5, texts()[5], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(3)
    for least, anchor, largest in ((100, 30, (2000, 1 << 22)), (100, 30, (2, 1 << 22)), (400, 128, (2000, 1 << 22))):
        want = brute([(t or "").encode() for _, t, _ in rows], least)
        got = repeats.without_repeats(docs, least, anchor, largest, keep_text=True).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == sorted(((r[0], *w) for r, w in zip(rows, want)), key=str)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_short_periodic_runs_match_brute_force(spark):
    rnd = random.Random(5)
    line = lambda n: "".join(rnd.choice("abcdefghij ") for _ in range(n))
    rows = [(i, line(300) + (line(p) * 34)[:n] + line(300)) for i, (p, n) in enumerate((p, n) for p in (20, 60, 130, 200) for n in (401, 440, 480, 530, 600, 670))]
    want = brute([t.encode() for _, t in rows], 400)
    assert sum(w[1] > 0 for w in want) > 10
    got = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 400, 128).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == [(i, *w) for (i, _), w in zip(rows, want, strict=True)]


def test_occurrences_count_starts():
    rnd = random.Random(6)
    for least, anchor in ((9, 9), (10, 9), (40, 9), (41, 9), (73, 9)):
        t = bytes(rnd.choice(b"abc") for _ in range(200)) + b"abcdefgabcdeabcd" * 12 + bytes(rnd.choice(b"abc") for _ in range(200))
        got = [x for m, n in repeats.occurrences(t, least, anchor) for x in zip(m.tolist(), n.tolist(), strict=True)]
        h = repeats.anchor_hashes(repeats.np.frombuffer(t, "u1"), anchor).view("i8").tolist()
        want = [(m, h[s : s + n + least - anchor].count(m)) for a, b, c in repeats.pieces(t, least, anchor) for s, n, m in zip(a.tolist(), b.tolist(), c.tolist(), strict=True)]
        assert got == want and (least < 40 or max(n for _, n in got) > 1)


def test_slices_join(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 64)
    t = texts()[1].encode() * 3
    found = [(int(s) + k, int(a)) for at, n, m in repeats.pieces(t, 100, 30) for s, c, a in zip(at, n, m) for k in range(c)]
    assert [s for s, _ in found] == list(range(len(t) - 99))
    by = {}
    assert all(by.setdefault(t[s : s + 100], a) == a for s, a in found)


def test_empty_table(spark):
    assert repeats.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
