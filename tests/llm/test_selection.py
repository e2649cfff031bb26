"""Resampling, URL filters and the filter audit against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import audit, resampling, url_filters

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n_words long, tie long, part int, bucket string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcXYZàß9🙂") for _ in range(rng.randint(1, 9))) for _ in range(120)]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "#", "\n", "\x00"]) for _ in range(n))
    out = [(i, prose(rng.randint(1, 160)), rng.choice(["en", "de", None])) for i in range(70)]
    same = prose(130)
    out += [(100 + i, same, rng.choice(["en", "fr"])) for i in range(25)] + [(99, same, "en"), (None, same, "en"), (None, same, "en"), (110, same, "en")]
    out += [(200, None, "en"), (201, "", "en"), (202, " \t\n", None), (203, "A" * 4000, "x"), (204, "é" * 3000 + " z", "x"), (205, "İSTANBUL ÄB " * 40, "x"), (206, prose(4000), "en"), (None, prose(40), "en"), (7, prose(50), "de")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(d, t, lang, 1, 2, 3, "b") for d, t, lang in rows], SCHEMA).repartition(5)


def features(text, longest):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, rows, longest):
    target = [("abc the ab xy",), (None,), ("Ab9 àß! c",), (rows[3][1],)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, t, _ in rows for f in features(t, longest))
    t_ = Counter(bucket(f) for (t,) in target for f in features(t, longest))
    n_s, n_t = sum(s.values()), sum(t_.values())
    gain = {b: math.floor(1000 * math.log((t_[b] + 1) * (n_s + 10000) / ((s[b] + 1) * (n_t + 10000)))) for b in s}
    want = []
    for d, text, _ in rows:
        f = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        want.append((d, len(features(text, 1)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    got = resampling.resample(frame(spark, rows), spark.createDataFrame(target, "text string"), longest).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(want)
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = sorted(((r["rank"], r.score, r.doc_id) for r in got if r["rank"]), key=lambda x: x[0])
    assert [(k, x[4], x[0]) for k, x in enumerate(able[: len(able) // 10], 1)] == drawn


def test_crc32_of_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    length = np.where(rng.random(300) < 0.1, rng.integers(0, 900, 300), rng.integers(0, 45, 300))
    assert resampling.crc32_of(data, start, length).tolist() == [zlib.crc32(data[s : s + n].tobytes()) for s, n in zip(start.tolist(), length.tolist())]
    assert resampling.crc32_of(data, start[:0], length[:0]).tolist() == []


def test_resampling_of_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert resampling.resample(none, none).count() == 0
    none.write.parquet(f"{tmp_path}/none")
    some = spark.createDataFrame([(1, "a b " * 10, "en", 1, 1, 1, "")], SCHEMA)
    assert [r["rank"] for r in resampling.resample(some, spark.read.parquet(f"{tmp_path}/none"), percent=100).collect()] == [1]


URLS = [
    None, "", "example.org", "http://", "https://EXAMPLE.org", "https://example.org/", "https://www.example.org/es/1", "https://badexample.org/es/1", "https://org/es/", "http://a.example.com/fr/x?y=1#z",
    "http://a.example.com/de/x", "http://x.com/frx", "http://x.com?x=/fr/", "http://example.org/en/12", "http://example.org/en/2", "http://casino.net/", "http://mycasino.net/", "http://a.net/CASINO-1", "http://a.net/casino_",
    "http://a.net/casinö", "http://a.net/öcasino", "http://free.net/", "http://free.net/free/free", "http://free.net/bets?a", "http://a.net/?q=%63%61%73ino", "http://a.net/%2563asino", "http://a.net/analytics",
    "xxx", "free bets", "://x", "http://[::1]:80/fr/", "http://user@x.com:8080/fr/", "x" * 5000 + "://porn.net/" + "y" * 5000,
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host, path = re.match("[^/?#]*", rest)[0].translate(LOWER), re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = [(r, v) for r, v in url_filters.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    text = (rest if url and "://" in url else url or "").translate(LOWER)
    text = re.sub("%([2-7][0-9a-f])", lambda m: chr(int(m[1], 16)), text).translate(LOWER)
    has = lambda t: re.search(f"(?<![0-9a-z\x80-\U0010ffff]){re.escape(t)}(?![0-9a-z\x80-\U0010ffff])", text)
    strict, soft = [t for t in url_filters.STRICT if has(t)], [t for t in url_filters.SOFT if has(t)]
    return host, path, rule, verdict or ("block" if strict or sum(url_filters.SOFT[t] for t in soft) >= url_filters.NEEDED else "allow"), len(strict), len(soft)


def test_url_filters(spark):
    rng = random.Random(2)
    bits = ["example.org", "com", "www.", "/fr/", "/de/", "/es/", "/en/1", "free", "bets", "-", "porn", "x", "?", "#", "://", "net", "ads", "é", "%66ree"]
    urls = URLS + ["http://" + "".join(rng.choice(bits) for _ in range(rng.randint(1, 7))) for _ in range(400)]
    pages = spark.createDataFrame([(None if i % 50 == 7 else i, u, "h", "v") for i, u in enumerate(urls)], "page_id int, url string, host string, verdict string").repartition(3)
    got = url_filters.judge(pages).collect()
    assert Counter(tuple(r) for r in got) == Counter((None if i % 50 == 7 else i, *brute(u)) for i, u in enumerate(urls))
    kept = url_filters.keep_allowed(pages)
    assert kept.columns == pages.columns and Counter(r.url for r in kept.collect()) == Counter(u for u in urls if brute(u)[3] == "allow")
    assert url_filters.judge(pages.limit(0)).count() == 0
    bare = url_filters.Judge((), (), {})
    assert {r.verdict for r in url_filters.judge(pages, bare).collect()} == {"allow"}
    assert url_filters.Rules((("a/", "block"), ("a/", "allow"))).decide("b.a", "/x") == ("a/", "block")
    heavy = url_filters.Judge((), (), {"free": 1, "bets": 3}, 4)
    assert [heavy.rows([u])[0][3] for u in ("http://a/bets", "http://a/bets/free")] == ["allow", "block"]


def failures(rows):
    low = {}
    for d, t, _ in rows:
        k = t or ""
        low[k] = min(low.get(k, (True, 0)), (d is None, d or 0))
    out = []
    for d, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        out.append((lang or "", d, (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), (d is None, d or 0) > low[t])))
    return out


def test_filter_audit(spark, rows):
    labels = [(d, i % 2, (i // 2) % 2) for i, (d, _, _) in enumerate(rows) if i % 3 and d is not None] + [(0, 0, 1), (0, 1, 0), (None, 1, 1), (9999, 1, 1)]
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    held = failures(rows)
    want, sums = {}, defaultdict(int)
    for part in {p for p, _, _ in held}:
        mine = [(d, f) for p, d, f in held if p == part]
        for order in itertools.permutations(range(5)):
            left = mine
            for step, i in enumerate(order, 1):
                gone, left = [x for x in left if x[1][i]], [x for x in left if not x[1][i]]
                failing = sum(f[i] for _, f in mine)
                alone = sum(f[i] and sum(f) == 1 for _, f in mine)
                want[(part, "".join("ABCDE"[k] for k in order), step)] = [len(left), len(gone), failing - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                sums[(part, i)] += len(gone)
    got = audit.audit(frame(spark, rows), spark.createDataFrame([(*x, "n") for x in labels], "doc_id long, quality int, toxic int, mask string")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in got} == want and len(got) == len(want)
    assert all(r.shapley == sums[(r.part, "ABCDE".index(r.filter_order[r.step - 1]))] for r in got)
    assert audit.audit(frame(spark, rows).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_polynomials():
    rng = random.Random(4)
    counts = {rng.randrange(32): rng.randrange(50) for _ in range(12)}
    p = audit.removal_polynomial(counts, 5)
    assert all(audit.at_corner(p, s) == sum(c for m, c in counts.items() if m & s) for s in range(32))
    for i in range(5):
        assert audit.shapley(p, i) == sum(audit.Fraction(c, bin(m).count("1")) for m, c in counts.items() if m >> i & 1)


def test_filters_need_letters_of_their_own(spark, rows):
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        audit.audit(frame(spark, rows), None, lambda t: F.struct((F.length(t) > 3).alias("E")))
