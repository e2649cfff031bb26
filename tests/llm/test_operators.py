"""Each operator against brute force on small fixtures with nulls, empty and long texts, ties, repeated rows, extra columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.functions import lit as spark_lit

from graphloom.llm.common import mix64 as common_mix64
from graphloom.llm import bpe, jaccard, licences, neighbours, packing, pages, pii, quality, sharding, suffixes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, part int, blob string, n long, kept boolean"


def texts(seed: int = 3, n: int = 60) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgàéöñ") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) + rng.choice(["", "", ".", ","]) for _ in range(k))
    rows: list[tuple[int | None, str | None]] = [(i, prose(rng.randint(1, 120))) for i in range(n)]
    base = prose(200)
    passage = prose(60)
    for i in range(12):  # near copies
        words = base.split()
        words[rng.randrange(len(words))] = f"w{i}"
        rows.append((100 + i, " ".join(words)))
    rows += [(200 + i, base) for i in range(5)]
    rows += [(300 + i, prose(20) + "\n" + passage + "\n" + prose(30)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, "one"), (404, "One"), (405, "aa " * 400), (406, "x" * 3000), (407, "é" * 150), (408, "🙂 " * 100)]
    rows += [(500, base), (500, base), (None, base), (None, None), (409, "a b c d e\n" * 30)]
    rows += [(600, prose(6000))]
    return rows


@pytest.fixture(scope="module")
def rows():
    return texts()


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2, True) for d, t in rows], SCHEMA).repartition(3)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def words(t):
    return WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(ids, linked):
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(lambda: None)
    for k, i in enumerate(ids):
        r = root(k)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return [least[root(k)] for k in range(len(ids))]


def test_jaccard(spark, rows):
    sets = [shingles(t) for _, t in rows]

    def linked(i, j):
        a, b = sets[i], sets[j]
        return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)

    comps = components([d for d, _ in rows], linked)
    expected = sorted(((d, len(s), c if s else d) for (d, _), s, c in zip(rows, sets, comps)), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1))
    got = sorted((tuple(r) for r in jaccard.jaccard_components(frame(spark, rows)).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or -1))
    assert got == expected


def test_jaccard_links_through_rows_without_an_id(spark):
    rng = random.Random(9)
    words_ = [f"w{rng.randrange(10**6)}" for _ in range(130)]
    swap = lambda at, by: " ".join([*words_[:at], by, *words_[at + 1 :]])
    far = words_.copy()
    far[10], far[100] = "left", "right"
    # 1 is linked with a set that only rows without an id hold; 5 and 8 are linked through one alone
    other = [f"v{rng.randrange(10**6)}" for _ in range(60)]
    left, right = other.copy(), other.copy()
    left[8], right[50] = "l", "r"
    rows_ = [(None, " ".join(words_)), (None, " ".join(words_)), (1, swap(60, "x")), (9, " ".join(far)), (5, " ".join(left)), (None, " ".join(other)), (8, " ".join(right)), (None, "alone and without any id or link")]
    sets = [shingles(t) for _, t in rows_]
    comps = components([d for d, _ in rows_], lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    assert comps == [1, 1, 1, 1, 5, 5, 5, None]
    got = Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows_)).collect())
    assert got == Counter((d, c) for (d, _), c in zip(rows_, comps))


def test_jaccard_blocks(spark, rows, monkeypatch):
    whole = Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect()))
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4000)
    assert Counter(map(tuple, jaccard.jaccard_components(frame(spark, rows)).collect())) == whole


def test_jaccard_resolve_equals_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(20):
        centre = rng.integers(0, 10**6, 60, dtype=np.uint64)
        sets = []
        for _ in range(25):
            s = centre.copy()
            k = rng.integers(0, 25)
            s[:k] = rng.integers(10**7, 10**8, k, dtype=np.uint64)
            sets.append(np.unique(s))
        pairs = [(i, j) for i in range(25) for j in range(i) if jaccard.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        expected = components(list(range(25)), lambda i, j: (i, j) in pairs)
        forest = {frozenset(p) for p in jaccard.resolve(sets)}
        assert components(list(range(25)), lambda i, j: frozenset((i, j)) in forest) == expected


def test_jaccard_blocks_of_a_list_lose_no_link():
    rng = np.random.default_rng(11)
    for _ in range(60):
        n, p = [], []
        for _ in range(20):  # one set that holds 80 to 82 hundredths of another, at any gap of positions
            large = int(rng.integers(40, 400))
            small = -(-large * int(rng.integers(80, 83)) // 100)
            at = int(rng.integers(0, small // 5 + 1))
            n += [small, large]
            p += [at, at + int(rng.integers(0, large - small + 1))]
        order = np.argsort(n, kind="stable")
        n, p = np.array(n)[order], np.array(p)[order]
        i, j = np.triu_indices(len(n), 1)
        ok = jaccard._may_link(n[i], p[i], n[j], p[j])
        found = components(list(range(len(n))), lambda a, b, e=set(map(frozenset, zip(*map(np.ndarray.tolist, jaccard._list_edges(n, p))))): frozenset((a, b)) in e)
        assert all(found[a] == found[b] for a, b in zip(i[ok].tolist(), j[ok].tolist()))


def test_keep_one_of_each(spark, rows):
    docs = frame(spark, rows)
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.select("doc_id").collect())
    assert ids[200] == 0 and ids[100] == 1 and ids[400] == 1 and ids[None] == 2


def brute_suffixes(rows):
    order = sorted({(-(1 << 63) if d is None else d, zlib.crc32((t or "").encode()), t or "") for d, t in rows})
    seen, out = set(), {}
    for d, c, t in order:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(s)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[(d, c)] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("run_bytes", [24 << 20, 20_000])
def test_suffix_dedup(spark, rows, monkeypatch, run_bytes):
    monkeypatch.setattr(suffixes, "RUN_BYTES", run_bytes)
    monkeypatch.setattr(suffixes, "GROUP_BATCH", 7)
    expected = brute_suffixes(rows)
    want = Counter((d, *expected[(-(1 << 63) if d is None else d, zlib.crc32((t or "").encode()))]) for d, t in rows)
    assert Counter(map(tuple, suffixes.dedup_digests(frame(spark, rows)).collect())) == want


def test_suffix_dedup_trusts_no_hash(spark, monkeypatch):
    # hashes of a few values only: bytes decide, and all is as before
    real = suffixes.rolling
    monkeypatch.setattr(suffixes, "rolling", lambda data, length: real(data, length) % np.uint64(7) if length == suffixes.LEFT + suffixes.LENGTH else real(data, length))
    monkeypatch.setattr(suffixes, "mix64", lambda h: h % np.uint64(5) if h.ndim == 2 else common_mix64(h))
    some = [r for r in texts(4, 40) if r[0] != 600]
    expected = brute_suffixes(some)
    want = Counter((d, *expected[(-(1 << 63) if d is None else d, zlib.crc32((t or "").encode()))]) for d, t in some)
    assert Counter(map(tuple, suffixes.dedup_digests(frame(spark, some)).collect())) == want


def test_suffix_dedup_with_nothing_settled(spark):
    # two texts in two tasks: each task's run settles nothing, all is found in the merge
    rng = random.Random(12)
    shared = "".join(rng.choice("abcdefghij ") for _ in range(400))
    some = [(i, "".join(rng.choice("klmnopqrst ") for _ in range(300)) + shared) for i in range(2)]
    expected = brute_suffixes(some)
    want = Counter((d, *expected[(d, zlib.crc32(t.encode()))]) for d, t in some)
    assert Counter(map(tuple, suffixes.dedup_digests(frame(spark, some).repartition(2, "doc_id")).collect())) == want


def test_suffix_ranges(spark):
    rng = random.Random(6)
    rows_ = [(i, "Chapter " + "".join(rng.choice("abcdefgh ") for _ in range(1500))) for i in range(120)]
    docs = spark.createDataFrame([(i, 0, t) for i, t in rows_], "order_id long, tag long, text string")
    ranges = suffixes.choose_ranges(docs, 40)
    assert len(ranges) >= 38 and (np.sort(ranges) == ranges).all()
    heads = np.sort(np.array([t[i : i + 32] for _, t in rows_ for i in range(0, len(t) - 32, 3)], "S32"))
    sizes = np.diff(np.concatenate(([0], np.searchsorted(heads, ranges), [len(heads)])))
    assert sizes.max() < 4 * sizes.mean()
    assert (suffixes.choose_ranges(docs.repartition(5), 40) == ranges).all()


def test_loser_tree_order():
    rng = random.Random(2)
    docs = ["".join(rng.choice("ab") for _ in range(400)).encode() for _ in range(5)]
    runs, expected = [], []
    for d in docs:
        w = suffixes.RunWriter(np.empty(0, "S32"))
        w.add(np.frombuffer(d, np.uint8), 1, 2, np.arange(0, 400, 3))
        ((_, blob),), _ = w.runs()
        import zstandard

        runs.append(suffixes.Run(zstandard.ZstdDecompressor().decompress(blob)))
        expected += [d[i : i + 100] for i in range(0, 400, 3)]
    before, got = None, []
    for shared, run in suffixes.merge(runs):
        key = run.key
        if before is not None:
            real = next((i for i in range(min(len(key), len(before))) if key[i] != before[i]), min(len(key), len(before)))
            assert shared == real
        before = key
        got.append(key)
    assert got == sorted(got) and set(got) == set(expected)


def test_cut_repeats(spark, rows):
    docs = frame(spark, rows)
    out = suffixes.cut_repeats(docs)
    assert out.dtypes == docs.dtypes and out.count() == len(rows)
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert kept[400] is None and kept[401] == "" and kept[406] == "x" and len(kept[201]) < 200


def test_quality(spark, rows):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.score(frame(spark, rows)).collect()}
    for d, t in rows:
        t = t or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[(d, len(w), sum(map(len, w)))]
        assert (r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.kept and r.base_failed)
    kept = quality.filter_documents(frame(spark, rows))
    assert sorted(kept.columns) == sorted(frame(spark, rows).columns)
    assert kept.count() == sum(r.kept for r in quality.score(frame(spark, rows)).collect())


def test_quality_keeps_columns_of_any_name(spark, rows):
    docs = frame(spark, rows).withColumnsRenamed({"part": "n_words", "blob": "packed_stats", "n": "vote_length", "kept": "failed"}).withColumn("a.b", spark_lit(7))
    kept = quality.filter_documents(docs)
    assert kept.dtypes == docs.dtypes
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, "x", 2, True, 7)}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in quality.score(frame(spark, rows)).collect() if r.kept)


def test_quality_model_separates():
    rng = random.Random(1)
    truth, patterns = [], Counter()
    for _ in range(4000):
        y = rng.random() < 0.8
        v = tuple(0 if rng.random() < 0.3 else (1 if (rng.random() < 0.9) == y else -1) for _ in quality.RULES)
        truth.append((y, v))
        patterns[v] += 1
    m = quality.fit(list(patterns.items()))
    right = sum((quality.posterior(v, m["good"], m["bad"], m["prior"]) >= 0.5) == y for y, v in truth)
    assert right > 0.95 * len(truth)


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub("[^0-9]", "", v)) <= 19 and luhn(re.sub("[^0-9]", "", v))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub("[^0-9]", "", v)) <= 15),
}


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    rng = random.Random(4)
    pool = ["a@b.c", "x.y_d@e.f.g.", "@", "1.2.3.4", "300.1.1.1", "007.1.2.3.4.5.6.7", "4111 1111 1111 1111", "4111-1111--1111", "+1 (555) 123-4567", "+12", " ", "é", "🙂", "..", "12", "-", "_d@e.f", "token = 0123456789abcdef0123456789abcdef", "call 555-123-4567 now", "\n"]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(300)] + [(900, None), (901, ""), (902, "1" * 5000), (903, "a." * 3000 + "@b.c"), (904, "1 " * 3000), (905, "a@" + "b." * 3000 + "c")]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, True) for d, t in rows], SCHEMA)
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    for d, t in rows:
        expected = [(k, m.start(), m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, t or "") if ok(m[0])]
        assert [tuple(s) for s in got[d].base] == expected, t
        assert all(not (b.start < m.end and m.start < b.end) for b in got[d].base for m in got[d].more)
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[900] is None and out[901] == "" and out[903] == "[EMAIL]"
    trained = pii.train(docs)
    again = pii.train(docs.repartition(7).orderBy("n", "text"))
    assert again["thresholds"] == trained["thresholds"] and again["model"] == trained["model"]
    scores, y, kinds = trained["held_out"]
    for k, kind in enumerate(pii.MORE_KINDS):
        own = kinds == k
        chosen = scores[own] >= trained["thresholds"][kind]
        assert y[own][chosen].mean() >= pii.TARGET_PRECISION and chosen.sum() > 0.5 * y[own].sum(), kind


def test_pii_thresholds():
    # ties are in or out together, and a threshold never lies among the negatives
    assert pii.calibrate(np.array([3.0, 2.0, 1.0, 1.0]), np.array([1.0, 1.0, 1.0, 0.0]), 0.9) == 1.5
    assert pii.calibrate(np.array([3.0, 2.0, -1.0, -4.0]), np.array([1.0, 1.0, 0.0, 0.0]), 0.5) == 0.5
    assert pii.calibrate(np.array([3.0, 2.0]), np.array([0.0, 0.0])) == float("inf")


def test_pii_secrets(spark):
    rng = random.Random(21)
    alnum = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    hidden = [(i, f"the access secret: {alnum(24 + i % 20)} is here") for i in range(60)]
    clean = [(100 + i, f"of the {'-'.join(['over', 'many', 'long', 'names', 'of', 'pages'][: 4 + i % 3])}-continued and Donaudampfschifffahrtsgesellschaften of {1900 + i} to {2000 + i} on 2021-03-{10 + i % 18}") for i in range(60)]
    got = {r.doc_id: r.more for r in pii.find(spark.createDataFrame(hidden + clean, "doc_id long, text string")).collect()}
    assert sum(bool(got[i]) for i, _ in hidden) >= 54 and sum(bool(got[i]) for i, _ in clean) <= 1


def test_pii_trains_on_all_texts(spark):
    # each text has one number that the base kinds judge: all are training rows, copies once
    docs = spark.createDataFrame([(i, f"the row {i} has +49 {1000000 + i // 2 * 7} in it") for i in range(3000)], "doc_id long, text string")
    rows = lambda d: pii.training_rows(d).selectExpr("sum(n)").first()[0]
    assert rows(docs.unionByName(docs)) - rows(docs.limit(0)) == 3000


def test_pii_trees_of_weighted_rows(spark):
    rng = random.Random(3)
    x = [[float(rng.randrange(6)) for _ in pii.FEATURES] for _ in range(400)]
    rows = [(v, float(v[1] > 2 and v[4] < 3), 1 + k % 3) for k, v in enumerate(x)]
    one = pii.fit_trees(spark.createDataFrame(rows, "x array<double>, y double, n long"))
    many = pii.fit_trees(spark.createDataFrame([(v, y, 1) for v, y, n in rows for _ in range(n)], "x array<double>, y double, n long").repartition(5))
    assert one == many and {one[1][0][0], one[1][0][3][0], one[1][0][2] if not isinstance(one[1][0][2], tuple) else one[1][0][2][0]} >= {1, 4}
    score = lambda v: one[0] + sum(pii.tree_value(t, v) for t in one[1])
    assert all((score(v) > 0) == bool(y) for v, y, _ in rows)


def test_bpe(spark, rows):
    path = bpe.default_tokenizer()
    tk = bpe.open_tokenizer(path)
    more = [(700, "<|endoftext|> It's 12 o'clock now  ΣΑΣ ﬁ é"), (701, " ")]
    got = Counter(map(tuple, bpe.encode_digests(frame(spark, rows + more), path, 50).collect()))
    want = Counter()
    for d, t in rows + more:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want[(d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tk.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
    assert got == want
    full = bpe.encode_documents(frame(spark, more), path, 5).collect()
    assert {r.doc_id: r.ids for r in full}[700] == tk.encode(more[0][1], add_special_tokens=False).ids


def test_lexicon(tmp_path):
    words = {w.encode(): [i, i + 1] for i, w in enumerate("tap taps top tops a ab abc été".split())}
    f = tmp_path / "lexicon"
    f.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(f))
    numbers = lexicon.numbers([*words, b"ta", b"tapss", b"", b"zzz"])
    assert [np.frombuffer(lexicon.ids_of(int(n)), "<u4").tolist() for n in numbers[: len(words)]] == list(words.values())
    assert (numbers[len(words) :] == -1).all()
    # tap/top and taps/tops share their ends: fewer states than letters
    assert len(lexicon.finals) < 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_packing(spark, rows):
    path = bpe.default_tokenizer()
    tk = bpe.open_tokenizer(path)
    docs = frame(spark, rows)
    got = packing.pack_documents(docs, path).collect()
    bins, per_doc = defaultdict(list), Counter()
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        per_doc[(r.doc_id, r.piece, r.start, r.length, r.ids_crc32)] += 1
    want = Counter()
    for d, t in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, i in enumerate(range(0, len(ids), 2048)):
            want[(d, k, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes()))] += 1
    assert per_doc == want
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-sum(k[3] * n for k, n in want.items()) // 2048) + 1


def test_packing_plan():
    assert sorted(packing.fullest({5: 2, 3: 1, 9: 1}, 13)) == [3, 5, 5]
    rng = random.Random(0)
    for _ in range(30):
        counts = {rng.randint(1, 20): rng.randint(1, 5) for _ in range(6)}
        room = rng.randint(1, 40)
        best = {0}
        for x, n in counts.items():
            best |= {b + x * k for b in best for k in range(n + 1) if b + x * k <= room}
        chosen = packing.fullest(counts, room)
        assert sum(chosen) == max(best) and all(n <= counts[x] for x, n in Counter(chosen).items())
        used = Counter()
        for times, lengths in packing.plan(counts, 25):
            assert sum(lengths) <= 25
            for x in lengths:
                used[x] += times
        assert used == Counter(counts)


def test_sharding(spark, rows):
    got = sharding.shard(frame(spark, rows), 4).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    total, at = sum(r.size for r in got), 0
    for r in sorted(got, key=lambda r: r.begin):
        assert r.begin == at
        at += r.size
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    largest = max(r.size for r in got)
    assert all(abs(s - total / 4) <= largest for s in sizes.values())
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    order = [r.shard for r in sorted(got, key=lambda r: r.begin)]
    assert order == sorted(order)


def test_licences(spark):
    rows = [(1, "Text here.\nReleased under the MIT License.\nmore"), (2, "RELEASED!! UNDER!! THE!! MIT!! LICENSE!!"), (3, "The license of prose is long and free of any template words at all"), (4, None), (5, ""), (6, licences.TEMPLATES[3][1]), (7, "licensed under cc by-nc 4.0 and more words that go on for quite a while in one long line"), (8, "This work is licensed under the GNU General Public License, version 3."), (9, "x " * 50000), (10, "Copyright (c) 2020 Some One\n\n" + re.sub(r"([:.]) ", r"\1\n\n", dict(licences.TEMPLATES[-7:])["MIT"])), (11, "2.0 " + licences.TEMPLATES[-2][1].upper())]
    got = {r.doc_id: r.hits for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    made = [(n, set(licences.bigrams_of(t))) for n, t in licences.TEMPLATES]
    for d, t in rows:
        t = t or ""
        lines = t.split("\n")
        segments = {s.strip(" ") for s in lines + [x for line in lines for x in re.split(r"(?<=[.;!?])\s+", line)] + re.split(r"\n\s*\n", t) + [t]}
        expected = set()
        for s in segments:
            g = set(licences.bigrams_of(s))
            dice = [(2 * len(g & m) / (len(g) + len(m)) if g or m else 0, -k, n) for k, (n, m) in enumerate(made)]
            if max(dice)[0] >= licences.THRESHOLD:
                expected.add((max(dice)[2], round(max(dice)[0], 9), s))
        assert {(h.licence, round(h.dice, 9), h.segment) for h in got[d]} == expected
    assert got[1] and not got[3] and got[6] and got[8]
    assert any(h.licence == "MIT" and len(h.segment) > 900 for h in got[10]) and any(h.licence == "Apache-2.0" and len(h.segment) > 400 for h in got[11])


def test_pages(spark):
    page = "<html><body><nav>Home About</nav>{}<footer>foot</footer></body></html>"
    rows = [
        (1, "http://a.org/1", page.format("<article><h1>Ti&amp;tle</h1><p>One <b>two</b>three<br>four<p>five <aside>no</aside><div class='comments'>no</div></article>")),
        (2, "http://a.org/2", None),
        (3, None, ""),
        (4, "http://a.org/4", "<p>plain &lt;text&gt; a < b"),
        (5, "http://a.org/5", "<article>open <script>var a='</p>';</script><!-- no --> end"),
        (6, "http://a.org/6", "<main><form>no</form><p hidden>no</p>yes</main>"),
    ]
    boiler = " ".join(f"menu{i}" for i in range(12))
    rows += [(10 + i, f"http://b.org/{i}", f"<div>{boiler}</div><div>unique words of page number {i} are here for all to read {i}</div>") for i in range(5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract(df).collect()}
    assert len(got) == len(rows)
    assert got[1].text == "Ti&tle One twothree four five" and got[2].text == "" and got[3].text == ""
    assert got[4].text == "plain <text> a < b" and got[5].text == "open end" and got[6].text == "yes"
    assert all(got[10 + i].text == f"unique words of page number {i} are here for all to read {i}" for i in range(5))
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_pages_keep_what_names_only_resemble(spark):
    rows = [
        (1, "http://e.org/1", '<article><div class="search-tips">tips</div><p class="share-prices">Share prices rose.</p><div class="share-buttons">no</div><div id="commentList-2">no</div><div class="ad-inline--wide">no</div><section class="post-comments">no</section><header><h2>sub</h2></header><p>end</p></article>'),
        (2, "http://f.org/2", "<body><header><h1>My Site Name</h1></header><section><header>head</header><p>Body of it</section><p>more</body>"),
        (3, "http://g.org/3", "<article>" + "<p>" + "<b><i><u><s>" * 30 + "one<p>two" + "</q></em>" * 50 + "</article>"),
        (4, "http://h.org/4", "<ul><li><span><span><span><span><span><span><span>a<li>b</ul>"),
        (None, None, "<p>" + " ".join(f"t{i}" for i in range(30))), (None, None, "<p>" + " ".join(f"t{i}" for i in range(30))),
        (5, "nowhere", "<p>" + " ".join(f"t{i}" for i in range(30))),
        (6, "http://i.org/6", "<article>" + "<p>long words of a page. " * 40_000 + "</article>"),
    ]
    got = Counter((r.page_id, r.text) for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    run = " ".join(f"t{i}" for i in range(30))
    expected = [(1, "tips Share prices rose. sub end"), (2, "head Body of it more"), (3, "one two"), (4, "a b"), (None, run), (None, run), (5, run), (6, " ".join(["long words of a page."] * 40_000))]
    assert got == Counter(expected)


def brute_articles(rows):
    """Less every token in a run of ten that half of a host's articles have, if they are three or more, unless most goes."""
    hosts = defaultdict(list)
    for _, url, texts in rows:
        hosts[url.split("/")[2]].append(" ".join(texts).lower().split())
    out = {}
    for i, url, texts in rows:
        own, words_ = hosts[url.split("/")[2]], " ".join(texts).split()
        n = Counter(r for w in own for r in {tuple(w[k : k + 10]) for k in range(len(w) - 9)})
        often = {r for r, c in n.items() if 2 * c >= len(own) and len(own) >= 3}
        low = [w.lower() for w in words_]
        gone = {k + d for k in range(len(low) - 9) if tuple(low[k : k + 10]) in often for d in range(10)}
        at = 0
        for t in texts:  # of a block that is covered in part, only pieces of ten tokens go
            block = range(at, at + len(t.split()))
            at = block.stop
            piece = []
            for k in [*block, None]:
                if k is not None and k in gone:
                    piece.append(k)
                    continue
                if len(piece) < 10 and len(piece) < len(block):
                    gone -= set(piece)
                piece = []
        out[i] = " ".join(w for k, w in enumerate(words_) if k not in gone) if 2 * len(gone) <= len(words_) else " ".join(words_)
    return out


@pytest.mark.parametrize("sent, parts", [(4 << 20, 3), (0, 7)])
def test_repeated_runs_of_articles(spark, monkeypatch, sent, parts):
    monkeypatch.setattr(pages, "SENT_BYTES", sent)
    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    rows = []
    for h in range(12):
        notices = [prose(rng.randrange(6, 40)) for _ in range(3)]
        quote, copied = prose(50), [prose(30), prose(40)]
        for i in range(rng.randrange(2, 14)):
            texts = copied.copy() if h == 5 and i else [prose(rng.randrange(5, 60)) for _ in range(3)]
            for k, notice in enumerate(notices):
                if rng.random() < (0.9, 0.5, 0.2)[k]:
                    texts.insert(rng.randrange(len(texts) + 1), notice if rng.random() < 0.7 else notice.upper() + " " + prose(2))
            if rng.random() < 0.3:
                texts.append(quote)
            rows.append((len(rows), f"http://h{h}.org/{i}", texts))
    html = [(i, u, "<nav>a b</nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>") for i, u, texts in rows]
    df = spark.createDataFrame(html, "page_id long, url string, html string").repartition(parts)
    expected = brute_articles(rows)
    assert {r.page_id: r.text for r in pages.extract(df).collect()} == expected
    assert sum(expected[i] != " ".join(t) for i, _, t in rows) > 30


#: Class names and ids that only resemble those of adverts, menus and notices.
RESEMBLING = (
    "ad-hoc cookie-recipe signup-2019 widget-review promo-codes-explained navigation-history modal-verbs footer-notes-on-kant comments-on-policy popup-books pagination-algorithms search-for-life "
    "share-of-market sponsors-of-1924 newsletter-history sidebars-in-print adverts-of-the-1950s ad-astra banner-years tagsort consent-in-law cookies-and-milk subscribe-pattern masthead-ships promote "
    "promotion-rules nav-mesh dialogue breadcrumb-chicken pager-device navy header-files related-rates response-1999 noticeable with-sidebar has-nav"
).split()


def test_pages_names_need_all_their_words(spark):
    say = lambda name: f"Text under {name.replace('-', ' ')} stays."
    rows = [(k, f"https://n{k}.example.org/a", f'<article><p>Start here.</p><p {("class", "id")[k % 2]}="{name}">{say(name)}</p></article>') for k, name in enumerate(RESEMBLING)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(RESEMBLING) >= 30 and got == {k: f"Start here. {say(name)}" for k, name in enumerate(RESEMBLING)}
    for name in [*pages.NAMES, *pages.MAYBE, "ad_300x250", "adSlot", "right-sidebar", "cookieNotice", "newsletter-signup", "share-buttons", "social-share", "related-posts", "site-footer", "main-nav", "nav-menu-2", "comment-list"]:
        blocks = pages.blocks_of(f'<article><p>Start.</p><div class="{name}">Gone.</div><p>End.</p></article>')
        assert [t for t, kind, _ in blocks if kind == pages.CONTENT] == ["Start.", "End."], name
    html = '<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, <label>so</label> <object data="a">it is</object>.</p></article>'
    assert [b[0] for b in pages.blocks_of(html)] == ["Let x=1, so it is."]
    wrapped = '<div class="with-sidebar"><article><p>Kept.</p></article><div class="sidebar">Gone.</div></div>'
    assert [t for t, kind, _ in pages.blocks_of(wrapped) if kind == pages.CONTENT] == ["Kept."]


def test_pages_keep_unique_runs(spark):
    boiler = " ".join(f"menu{i}" for i in range(12))
    mixed = [(i, f"http://m.org/{i}", f"<nav>{boiler}</nav><div>own{i} start{i} {boiler} own{i} end</div>") for i in range(3)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(mixed, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own{i} start{i} own{i} end" for i in range(3)}


def test_pages_of_a_large_host(spark):
    boiler = " ".join(f"menu{i}" for i in range(12))
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(15))
    # each pair of pages shares a passage of its own, on a host that no single task would hold
    rows = [(i, f"http://big.org/{i}", f"<div>{boiler} pair{i % 600} {' '.join(f'p{i % 600}q{k}' for k in range(10))}</div><div>{own(i)}</div>") for i in range(1200)]
    rows += [(i, f"http://big.org/{i}", f"<div>{' '.join(f'z{i % 40}q{k}' for k in range(12))}</div><div>{own(i)}</div>") for i in range(1200, 1280)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: own(i) for i in range(1280)}


def test_copies_of_a_page_keep_their_text(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(80))
    boiler = " ".join(f"menu{i}" for i in range(12))
    rows = [(i, f"http://c.org/{i}", f"<div>{boiler}</div><div>{own(i)}</div>") for i in range(4)]
    rows += [(10, "http://c.org/0?print", rows[0][2]), (11, "http://c.org/1b", rows[1][2] + "<div>printed on a day of may</div>")]
    rows += [(20 + i, f"http://d.org/{i}", f"<div>{own(9)}</div>") for i in range(30)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: own(i) for i in range(4)}, 10: own(0), 11: own(1) + " printed on a day of may", **{20 + i: own(9) for i in range(30)}}


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TILE", 16)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 16))
    rows = [(i, base[i % 40] + 0.05 * rng.standard_normal(16) * (i >= 40)) for i in range(120)]
    rows = [(i, [float(x) for x in v]) for i, v in rows]
    rows += [(200, None), (201, []), (202, [0.0] * 16), (203, [None] + [1.0] * 15), (204, [float("nan")] + [1.0] * 15), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, rows[3][1]), (207, rows[3][1]), (None, rows[3][1]), (208, [x * 1e200 for x in rows[4][1]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, key long")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in neighbours.vector_links(df).collect()), key=str)

    def linked(i, j):
        a, b = rows[i][1], rows[j][1]
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return False
        a, b = np.array(a) / max(map(abs, a)) if any(a) else np.array(a), np.array(b) / max(map(abs, b)) if any(b) else np.array(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return bool(np.isfinite(n) and n > 0 and a @ b / n >= 0.95)

    comps = components([r[0] for r in rows], linked)
    n_links = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    assert got == sorted(zip([r[0] for r in rows], n_links, comps), key=str)


@pytest.mark.parametrize("n", [1500, 6000])
def test_vectors_in_trees_that_split(spark, monkeypatch, n):
    # a sample far smaller than the table: the leaves below it are split on the executors
    monkeypatch.setattr(neighbours, "LEAF", 64)
    monkeypatch.setattr(neighbours, "TILE", 64)
    monkeypatch.setattr(neighbours, "SAMPLE_BYTES", 8 * 32 * 200)
    rng = np.random.default_rng(n)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.standard_normal((n, 32)))
    noise = rng.standard_normal((n, 32))
    near = unit(base + 0.32 * unit(noise - (noise * base).sum(axis=1, keepdims=True) * base))[: n // 3]  # cosines of about 0.952
    dense = unit(base[:1] + 0.03 * rng.standard_normal((300, 32)))
    every = np.concatenate([base, near, dense])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(every)]
    got = {r.vec_id: r for r in neighbours.vector_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near_ = every @ every.T >= 0.95
    np.fill_diagonal(near_, False)
    expected = near_.sum(axis=1)
    assert all(got[i].n_links <= expected[i] for i in range(len(every)))  # none below the cosine
    assert sum(r.n_links for r in got.values()) >= 0.97 * expected.sum()
    pairs = [i for i in range(n // 3) if expected[i] == 1 and i]
    assert sum(got[i].n_links for i in pairs) >= 0.95 * len(pairs) and len(pairs) > n // 5


@pytest.mark.parametrize("kind", ["docs", "pages", "vectors"])
def test_empty_tables(spark, kind):
    docs = spark.createDataFrame([], SCHEMA)
    if kind == "docs":
        path = bpe.default_tokenizer()
        for f in (jaccard.jaccard_components, jaccard.keep_one_of_each, suffixes.dedup_digests, suffixes.cut_repeats, quality.score, quality.filter_documents, pii.find, pii.redact, sharding.shard, licences.scan):
            assert f(docs).count() == 0
        assert bpe.encode_digests(docs, path).count() == 0 and packing.pack_documents(docs, path).count() == 0
    elif kind == "pages":
        assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    else:
        assert neighbours.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_pipeline(spark, rows, tmp_path):
    """Every stage against brute force on its own input, and run() against the stages one after another."""
    import corpus_pipeline

    more = [(700 + i, f"Contact me at user{i}@example.org or +1 555 123 45{i:02d} about the plan for page {i} and all of its many parts in the year to come") for i in range(8)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in [*rows, *more]], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "suffix-array dedup", "personal data", "best-fit packing"]

    def step(name, df):
        out = stages[name](spark, df, str(tmp_path))
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        assert name == "best-fit packing" or out.columns == docs.columns
        return spark.read.parquet(path)

    pairs = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    good = step("quality rules", docs)
    scored = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.score(docs).collect()}
    model = quality.fit(list(Counter(tuple(getattr(r, f"vote_{k}") for k in quality.RULES) for r in quality.score(docs).collect()).items()))
    keep = Counter()
    for d, t in [*rows, *more]:
        w = WORD.findall(t or "")
        r = scored[(d, len(w), sum(map(len, w)))]
        if not r.base_failed and quality.posterior(tuple(getattr(r, f"vote_{k}") for k in quality.RULES), model["good"], model["bad"], model["prior"]) >= quality.KEEP_AT:
            keep[(d, t)] += 1
    assert pairs(good) == keep and all(r.n_chars == len(r.text) for r in good.collect())

    held = sorted(pairs(good).elements(), key=str)
    sets = [shingles(t) for _, t in held]
    comps = components([d for d, _ in held], lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    single = step("n-gram Jaccard join", good)
    want = {(d, t) for (d, t), c in zip(held, comps) if d is not None and d == c}
    assert Counter({k: n for k, n in pairs(single).items() if k[0] is not None}) == Counter(want)

    cutted = step("suffix-array dedup", single)
    order, seen, left = sorted(want, key=lambda r: (r[0], zlib.crc32(r[1].encode()))), set(), {}
    for d, t in sorted([*order, *(k for k in pairs(single) if k[0] is None)], key=lambda r: (-(1 << 63) if r[0] is None else r[0], zlib.crc32(r[1].encode()))):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        left[(d, t)] = bytes(x for x, g in zip(b, gone) if not g).decode(errors="ignore")
    assert Counter((r.doc_id, r.text) for r in cutted.collect()) == Counter((d, x) for (d, t), x in left.items() for _ in range(pairs(single)[(d, t)]))

    safe = step("personal data", cutted)
    assert safe.count() == cutted.count() and all(r.n_chars == len(r.text) for r in safe.collect())
    before = {r.doc_id: r.text for r in cutted.collect()}
    for r in safe.collect():
        assert not any(ok(m[0]) for p, ok in PII.values() for m in re.finditer(p, r.text))
        if not re.search("[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert sum("[EMAIL]" in r.text and "[PHONE]" in r.text for r in safe.collect() if r.doc_id and r.doc_id >= 700) >= 1

    tk = bpe.open_tokenizer(bpe.default_tokenizer())
    packed = step("best-fit packing", safe)
    want_pieces = Counter()
    for r in safe.collect():
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, i in enumerate(range(0, len(ids), 2048)):
            want_pieces[(r.doc_id, k, i, len(ids[i : i + 2048]), zlib.crc32(ids[i : i + 2048].tobytes()))] += 1
    digest = lambda df: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert digest(packed) == want_pieces
    assert digest(corpus_pipeline.run(spark, str(tmp_path))) == want_pieces


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
