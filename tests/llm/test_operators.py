import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loomwork.llm import chat, decontaminate, lm, mixing, near, personal, token_counts, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 4)))
    out = []
    for i in range(60):
        out.append((i, " ".join(word() for _ in range(rnd.randint(1, 80))), "en", f"s{i % 3}", 0))
    for i in range(60, 90):
        base = out[i % 7][1].split()
        base[rnd.randrange(len(base))] = "Edited"
        out.append((i, " ".join(base), "en", None if i % 2 else "s0", 0))
    out += [(90, None, None, None, None), (91, "", "en", "s1", 0), (92, " \t\n", "en", "s1", 0), (93, "two words", "en", "s1", 0), (94, "TWO words", "en", "s2", 0), (94, "TWO words", "en", "s2", 0)]
    out += [(95, "long " * 30000 + "end", "en", "s2", 0), (96, "x" * 50000, "en", "s2", 0), (97, "Mail a.b+c@ex-1.org.uk, 10.0.0.256 10.0.0.25 <|endoftext|> +1 (555) 010-9999, card 4539 1488 0343 6467, or", "en", "s2", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_mix_takes_near_targets(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r.copies in (0, 1, 2) for r in got)
    by = collections.defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source][0] += r.size
        by[r.source][1] = r.target
        by[r.source][2] += r.size * r.copies
        assert r["size"] == len(WORD.findall(r.text or "")) if r.text else r["size"] == 0
    total = sum(v[0] for v in by.values())
    assert math.isclose(sum(v[1] for v in by.values()), 1.5 * total)
    assert all(v[1] <= 2 * v[0] + 1e-9 for v in by.values())
    again = sorted((r.doc_id, r.copies) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((r.doc_id, r.copies) for r in got)


def test_near_components_are_those_of_brute_force(docs, rows):
    for k, num in ((4, 85), (5, 80)):
        sets = []
        for i, t, *_ in rows:
            w = WORD.findall(lower(t))
            sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
        root = list(range(len(rows)))
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    x, y = root[a], root[b]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        least = {}
        for i, r in enumerate(root):
            least[r] = min(least.get(r, 1 << 60), rows[i][0])
        want = sorted((rows[i][0], len(sets[i]), least[r]) for i, r in enumerate(root))
        assert sorted(tuple(r) for r in near.near_components(docs, k, num, 100).collect()) == want


def test_one_of_each_keeps_columns_and_empty_texts(docs, empty):
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {90, 91, 92, 93} <= set(ids) and 94 not in ids
    assert near.near_components(empty, 4, 85, 100).collect() == []


def test_chats_read_back(spark):
    odd = ["<|im_end|>", "<\\|im_start|>", "a<|", "\\", None, "", "<\\\\|x|>\n<|im_end|>\n"]
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", x) for t, x in enumerate(odd)] + [(2, 0, "assistant", "no"), (2, None, None, "x"), (3, 0, "user\n<", "q"), (3, 0, "user\n<", "q")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r.conv_id: r for r in got.withColumn("turns", chat.read_back(got.formatted)).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user" if k % 2 == 0 else "assistant", x or "") for k, x in enumerate(odd)]
    assert [(t.role, t.text) for t in out[3].turns] == [("user\n<", "q")] * 2
    assert not out[2].valid and "".join(s.text for s in out[1].segments) == out[1].formatted


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and personal.luhn(d)]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15])


def personal_rows():
    rnd = random.Random(2)
    odd = lambda n: "".join(rnd.choice("a@@..1234567890+- (x,é") for _ in range(n))
    out = [(i, odd(rnd.randint(0, 300))) for i in range(200)]
    for i in range(200, 240):
        out.append((i, f"é {odd(40)} a.b{i}@c.org at 10.0.{i}.1 or +1 (555) 010-{1000 + i}, 4539 1488 0343 6467; key = \"{rnd.randrange(16**8):08x}{'a1' * 16}\" end"))
    out += [(300, 'key = "short-XY-12"'), (301, 'key = "10.0.0.1"'), (302, "the key is 12345678"), (303, None), (304, ""), (300, 'key = "short-XY-12"'), (None, 'x key = "short-XY-12", y')]
    return [*out, (305, "long " * 40000 + 'key = "q-9" end')]


def test_personal_data_query_by_brute_force(spark, tmp_path, monkeypatch):
    rows = personal_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    unseen = {300: [(7, 4, 18)], None: [(9, 4, 20)], 305: [(200007, 4, 200010)]}
    want = []
    for i, t in rows:
        b = base(t or "")
        keys = [(m.start(), 4, m.end()) for m in re.finditer(r"(?<=key = \")[0-9a-f]{40}", t or "")] + unseen.get(i, [])
        listed = lambda x: ",".join(f"{personal.KINDS[k]}:{s}:{e}" for s, k, e in sorted(x))
        want.append((i, *(sum(k == j for _, k, _ in b) for j in range(4)), hashlib.sha256(listed(b).encode()).hexdigest(), listed(b + keys), len(keys)))
    got = sorted(map(tuple, personal.op5(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(want, key=str)
    # The same over patterns in several blocks.
    monkeypatch.setattr(personal, "LIMIT", 1)
    assert sorted(map(tuple, personal.op5(spark, str(tmp_path)).collect()), key=str) == got


def test_base_spans_by_brute_force():
    rnd = random.Random(3)
    for _ in range(3000):
        t = "".join(rnd.choice("a@@..1234567890+- (x,") for _ in range(rnd.randint(1, 60)))
        assert personal.base_spans(t) == base(t), t


def test_contexts_find_identifiers_that_no_rule_has(spark):
    rows = [(i, f"words then account number +1 (555) 010-{1000 + i} and more") for i in range(8)] + [(99, "words then account number ZK99-4410X and more")]
    rows += [(200 + i, f"{w} then another word") for i, w in enumerate(["thing", "word", "account"])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in personal.with_spans(docs).collect()}
    assert [rows[8][1][s.start : s.end] for s in got[99]] == ["ZK99-4410X"] and not any(got[200 + i] for i in range(3))
    red = personal.redact(docs)
    assert red.columns == docs.columns
    text = {r.doc_id: r.text for r in red.collect()}
    assert text[99] == "words then account number [CTX] and more" and all(text[i] == "words then account number [PHONE] and more" for i in range(8))


def test_contexts_spread_through_what_they_found(spark):
    # Seeds stand after "mail"; what else stands there does after "login" too, which has no seed.
    names = [f"user-{i}x" for i in range(6)]
    rows = [f"mail: a{i}@b.org ." for i in range(30)] + [f"mail: {n} ." for n in names] + [f"login: {n} !" for n in names] + ["login: stranger-7 !"]
    got = {r.doc_id: r.spans for r in personal.with_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert [rows[42][s.start : s.end] for s in got[42]] == ["stranger-7"]


def test_an_ordinary_word_in_a_context_is_no_seed(spark, monkeypatch):
    asked, leading = [], personal.leading
    monkeypatch.setattr(personal, "leading", lambda docs, new: asked.append(new.count()) or leading(docs, new))
    rows = [f"mail: a{i}@b.org ." for i in range(30)] + ["mail: the ."] + [f"p{i} of the q{i}" for i in range(200)]
    got = {r.doc_id: r.spans for r in personal.with_spans(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    # Before, all places of "the" were edges of the next round.
    assert asked == [] and not any(got[31 + i] for i in range(200))


def test_tokens_of_one_block_are_held_at_a_time(spark):
    # Three texts of more than a block each, in one batch; before, all were held at once.
    docs = spark.createDataFrame([("word " * (personal.STEP // 4),)] * 3, "text string").coalesce(1)
    gather = lambda parts: pa.RecordBatch.from_arrays([pa.array([len(parts)], pa.int64())], ["n"])
    values = spark.createDataFrame([(1,)], "pattern long")
    assert [r.n for r in personal.over_blocks(docs, values, "n long", gather).collect()] == [1, 1, 1]


def test_places_are_counted_once_a_task(spark):
    """Not once for every block of a task's texts."""
    docs = spark.createDataFrame([("alpha beta " * 100_000,)] * 3, "text string").coalesce(1)
    word = np.frombuffer(b"alpha beta", np.uint8)
    two = personal.Tokens(word, np.array([0, 10])).hash.view(np.int64).tolist()
    values = spark.createDataFrame([(h,) for h in [*two, 5]], "token long")
    got = personal.tallies(docs, values, lambda t: (t.hash,)).collect()
    assert sorted(map(tuple, got)) == sorted((h, 300_000) for h in two)


def test_personal_data_of_an_empty_table(empty):
    assert personal.with_spans(empty).collect() == [] and personal.redact(empty).collect() == []


def test_token_counts_are_the_library_s(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    want = sorted((i, len((t or "").encode()), len(own.encode(t or "", add_special_tokens=False))) for i, t, *_ in rows)
    assert sorted(tuple(r) for r in token_counts.count_tokens(docs, path, hot_keys=20).collect()) == want
    assert token_counts.count_tokens(empty, path).collect() == []


def test_a_worker_reads_its_vocabulary_once():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.splitter(path) is token_counts.splitter(path)


def test_language_model_matches_counts_read_as_levels(docs, rows, empty):
    train = docs.where(lm.remainder(docs.doc_id, 5) != 1)
    by_id = lambda df: sorted(df.collect(), key=lambda r: r.doc_id)
    got = by_id(lm.score(docs, train, hot_keys=5))
    tokens = [(i, WORD.findall(lower(t)) + [None]) for i, t, *_ in sorted(rows, key=lambda r: r[0])]
    kept = [ws for i, ws in tokens if zlib.crc32(str(i).encode()) % 5 != 1]
    c = collections.Counter(w for ws in kept for w in ws)
    c2 = collections.Counter(x for ws in kept for x in zip([None, *ws], ws))
    n, v = sum(c.values()), len(c)
    read = lambda x: float(lm.counts(lm.np.searchsorted(lm.LEVELS, [x], "right"))[0]) if x else 0.0
    off = []
    for r, (i, ws) in zip(got, tokens, strict=True):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (i, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        p1 = lambda w: (read(c[w]) + 0.5) / (n + 0.5 * (v + 1))
        want = sum(math.log10(min(1.0, (read(c2[a, w]) + lm.MU * p1(w)) / (read(c[a]) + lm.MU))) for a, w in zip([None, *ws], ws))
        off += [abs(r.score - want) / len(ws)] if len(ws) < 1000 else []
        # Texts that were trained on have no unseen pairs, so a probe can err in the level only.
        assert zlib.crc32(str(i).encode()) % 5 == 1 or abs(r.score - want) <= 0.1 * len(ws)
    assert sum(off) / len(off) < 0.08
    # Blocks of the filter, and shards of other sizes, ask the same.
    again = by_id(lm.score(docs, train, bits=1 << 12, hot_keys=5))
    assert all(math.isclose(a.score, b.score, rel_tol=1e-12) for a, b in zip(again, got, strict=True))
    assert all(abs(a.score - b.score) <= 0.3 * a.n_tokens and math.isclose(a.base_score, b.base_score, rel_tol=1e-9) for a, b in zip(got, by_id(lm.score(docs, train, hot_keys=5, shard=1 << 12))))
    none = by_id(lm.score(docs, empty))
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none) and lm.score(empty, docs).collect() == []


def test_language_model_of_odd_rows(spark):
    rows = [(None, "a b", 1), (0, "a b", 1), (3, "a b", 1), (3, "a b", 1), (4, None, 1)]
    got = sorted(lm.score(df := spark.createDataFrame(rows, "doc_id long, text string, score int"), df).collect(), key=str)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)
    assert len({r.score for r in got if r.n_tokens == 3}) == 1 and sum(r.n_tokens == 1 for r in got) == 1


def test_decontamination_finds_edited_passages(spark, empty):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("bcdfgaeiou") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(5)]
    edited = items[2][1].split()
    edited[7], edited[20] = "other", "words"
    rows = [(0, " ".join(word() for _ in range(200))), (1, "Before " + items[0][1].upper() + " after"), (2, " ".join(word() for _ in range(50)) + " " + ", ".join(edited)), (3, None), (4, "")]
    got = decontaminate.aligned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 0), (2, 2)]
    assert decontaminate.aligned(empty, spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_decontamination_finds_what_aligning_everything_finds(spark):
    rnd = random.Random(13)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("aeiou") * rnd.choice((1, 1, 2))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 15, 15, 24, 40))]
    rows = [(i, " ".join(word() for _ in range(rnd.randint(0, 60)))) for i in range(40)]
    for i in range(160):
        # Edited copies; item 7 in more texts than a rare seed may have been in.
        w = items[7 if i % 3 == 0 else rnd.randrange(len(items))][1].split()
        for _ in range(rnd.randint(0, 1 + len(w) // 3)):
            k = rnd.randrange(len(w))
            w[k : k + rnd.randint(0, 1)] = ["zz"] * rnd.randint(0, 2) or w[k : k + 1]
        rows.append((100 + i, " ".join([word() for _ in range(rnd.randint(0, 20))] + w + [word() for _ in range(rnd.randint(0, 20))])))
    w = items[8][1].split()
    rows += [(1000 + i, " ".join("zz" if k in (3, 8, 12) else x for k, x in enumerate(w)) + f" y{i}") for i in range(30)]
    rows.append((2000, " ".join("zz" if k in (3, 7, 11) else x for k, x in enumerate(w))))
    texts, benchmark = decontaminate.item_words([t for _, t in rows]), decontaminate.item_words([t for _, t in items])
    want = {(d, i): decontaminate.align(b, t) / (2 * len(b)) for (d, _), t in zip(rows, texts, strict=True) for (i, _), b in zip(items, benchmark, strict=True)}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.aligned(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: s for k, s in want.items() if s >= decontaminate.THRESHOLD}
    assert all((1000 + i, 8) in got for i in range(30)) and (2000, 8) in got


def test_kernels_are_those_of_all_subsequences():
    from itertools import combinations

    def slow(a, b, n):
        weigh = lambda s: [("".join(s[i] for i in c), toxicity.DECAY ** (c[-1] - c[0] + 1)) for c in combinations(range(len(s)), n)]
        return sum(x * y for u, x in weigh(a) for v, y in weigh(b) if u == v)

    words = ["idiot", "idxiot", "tidioti", "moron", "abcd"]
    got = toxicity.kernels(toxicity.codes(words), toxicity.codes(words), 7)
    for k in range(4):
        for i, a in enumerate(words):
            for j, b in enumerate(words):
                assert math.isclose(got[k, i, j], slow(a, b, toxicity.ORDER + k), rel_tol=1e-4, abs_tol=1e-7)


def test_close_words_are_those_of_all_kernels():
    rnd = random.Random(6)
    marks = toxicity.Landmarks(["idiot", "scum", "worthless", "abcabcabc"])
    words = ["".join(rnd.choice("idotscumwrhleab") for _ in range(rnd.randint(4, 24))) for _ in range(3000)]
    words += [m[:k] + rnd.choice("xyz") * rnd.randint(0, 2) + m[k:] for m in marks.strings for k in range(len(m))]
    want = marks.values(toxicity.codes(words))
    rows, values = marks.close(words)
    # An order's share is capped at 1, and float32 leaves ties at CLOSE to rounding.
    assert set(rows.tolist()) == set(np.flatnonzero(want.max(1) >= toxicity.CLOSE).tolist()) and len(rows) > 15
    assert np.allclose(values, np.where(want[rows] >= toxicity.CLOSE, want[rows], 0))
    for word in ("x" * 300 + "worthless" + "y" * 300, "worthless" + "z" * 50, "z" * 55 + "worthless"):
        assert marks.close([word])[1].max() > 0.99


def test_toxicity_learns_words_and_their_variants(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghilmnorst") for _ in range(rnd.randint(2, 8)))
    rows, labels = [], []
    for i in range(400):
        t = [word() for _ in range(30)]
        if i % 4 == 0:
            t[rnd.randrange(30)] = "z" * rnd.choice((0, 0, 0, 40)) + "grumble" + rnd.choice(["", "s", "dor"])
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "you g.r.u.m.b.l.e now"), (902, "you g r u m b l e now"), (903, "clean words only"), (904, "you gruxmble"), (904, "you gruxmble"), (None, "grumble")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = toxicity.add_scores(docs.withColumn("score", docs.text), model)
    assert scored.columns == ["doc_id", "text", "score"] and scored.count() == docs.count()
    assert toxicity.add_scores(docs.limit(0), model).collect() == []
    got = {r.doc_id: r.score for r in scored.collect()}
    assert got[904] >= toxicity.THRESHOLD and got[None] >= toxicity.THRESHOLD
    assert sum((got[i] >= toxicity.THRESHOLD) == (y == 1) for i, y in labels) >= 396
    assert got[901] >= toxicity.THRESHOLD and got[902] >= toxicity.THRESHOLD and got[903] < toxicity.THRESHOLD and got[900] < toxicity.THRESHOLD
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.add_scores(docs, none).collect()} == {0.0}


@pytest.mark.parametrize("name", ["op1_mix_sources", "op4_format_chats"])
def test_same_rows_as_sql(spark, name):
    from compare import compare
    from loomwork.llm import queries

    said = compare(spark, "/root/testdata/sf0.001", name, queries.QUERIES[name], queries.SQL[name])
    assert ": same " in said, said


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf)
    assert set(docs.columns) < set(out.columns) and out.count() > 0


def test_pipeline_matches_brute_force_of_each_stage(spark, tmp_path):
    from itertools import combinations

    import corpus_pipeline

    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("acdfhknopstvwxyz") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(n))) for i, n in enumerate((3, 15, 30))]
    texts = [prose(40) for _ in range(200)]
    for w in texts[::4]:
        w[rnd.randrange(40)] = "grumble"
    for k in (1, 5, 9):
        texts += [texts[k], [*texts[k][:-1], "zz"], [*texts[k][:18], "zz", "zz", *texts[k][20:]]]
    for k in range(12):
        w = items[k % 3][1].split()
        w[len(w) // 2] = "zz" if k % 2 else w[len(w) // 2]
        texts.append([*prose(12), *w, *prose(12)])
    rows = [(i, " ".join(w) + (f" mail {'ab'[i % 2]}.c@example.org now" if i % 10 == 3 else ""), "en", "s", 0) for i, w in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {r[0]: r[1] for r in rows if "grumble" not in r[1].split()}
    assert len(left) == len(rows) - 50
    runs = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in left.items()}
    root = {i: i for i in left}
    for a, b in combinations(sorted(left), 2):
        if len(runs[a] & runs[b]) >= 0.8 * len(runs[a] | runs[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    assert sum(i != r for i, r in root.items()) == 6
    left = {i: t for i, t in left.items() if root[i] == i}
    at = decontaminate.item_words([*left.values()])
    benchmark = decontaminate.item_words([t for _, t in items])
    leaks = {i for i, t in zip(left, at, strict=True) for b in benchmark if decontaminate.align(b, t) >= decontaminate.THRESHOLD * 2 * len(b)}
    assert len(leaks) == 10
    left = {i: re.sub(r"[ab]\.c@example\.org", "[EMAIL]", t) for i, t in left.items() if i not in leaks}
    assert sum("[EMAIL]" in t for t in left.values()) > 10

    md5 = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    band = lambda n: (n + 4).bit_length() * 4 + ((n + 4) >> ((n + 4).bit_length() - 3)) % 4
    order = sorted(left, key=lambda i: (band(n := len(left[i].split())), md5(f"7/{i}") % 64, n, md5(f"7/{i}"), i))
    # One source: its target is the budget, one and a half times its size.
    offset, want = md5("7/+s") / 2**32, []
    for k, i in enumerate(order):
        want += [(i, left[i])] * (math.floor(1.5 * (k + 1) + offset) - math.floor(1.5 * k + offset))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(want)
