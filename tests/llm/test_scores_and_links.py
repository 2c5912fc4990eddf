"""Quality, language, substring dedup, near-dedup and archives against brute force and held-out rows."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import language, quality, recompression, simhash, warc

SEP = re.compile(r"[^\x20\x09-\x0D]+")


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def brute_substrings(rows, window):
    first = {}
    split = {n: SEP.findall(r[1] or "") for n, r in enumerate(rows)}
    key = lambda i: float("inf") if i is None else i
    for n, words in split.items():
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            first[w] = min(first.get(w, float("inf")), key(rows[n][0]))
    out = []
    for n, words in split.items():
        gone = set()
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < key(rows[n][0]):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((rows[n][0], len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_substring_dedup(spark, docs, no_docs, rows, monkeypatch, parts):
    monkeypatch.setattr(recompression, "input_parts", lambda df, per: parts)
    got = recompression.substring_dedup(docs)
    columns = ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    want = brute_substrings(rows, 13)
    assert tuples(got, *columns) == want and sum(w[2] for w in want) > 100
    assert recompression.substring_dedup(no_docs).count() == 0


def test_substring_dedup_shared_passages(spark, monkeypatch):
    draw, made = random.Random(1), []
    passages = [[draw.choice("abcdefgh") * draw.randint(1, 2) for _ in range(draw.randint(8, 60))] for _ in range(12)]
    for n in range(150):
        words = [f"u{draw.randint(0, 10**6)}" for _ in range(draw.randint(0, 40))]
        for _ in range(draw.randint(0, 3)):
            p, at = draw.choice(passages), draw.randint(0, len(words))
            a = draw.randint(0, 8)
            words[at:at] = p[a : draw.randint(a, len(p))]
        made.append((draw.randint(0, 400), " ".join(words)))
    monkeypatch.setattr(recompression, "input_parts", lambda df, per: 5)
    got = recompression.substring_dedup(spark.createDataFrame(made, "doc_id long, text string"))
    assert tuples(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text") == brute_substrings(made, 13)


def test_recompression_is_consistent():
    draw = np.random.default_rng(2)
    inner = draw.integers(0, 6, 200).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    parses = []
    for seed in (3, 4):
        own = np.random.default_rng(seed).integers(0, 6, 40).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        names = np.concatenate([own[: 20 + seed], inner, own[20 + seed :]])
        s = recompression.parse(names, np.zeros(len(names), np.int64))
        shift = 20 + seed
        parses.append({(b - shift, e - shift, n) for b, e, n, low, high in zip(s.begin.tolist(), s.stop.tolist(), s.names.tolist(), s.low.tolist(), s.high.tolist(), strict=True) if low >= shift and high <= shift + 200})
    assert parses[0] == parses[1] and len(parses[0]) > 20


def brute_fingerprint(text, shingle=4):
    words = SEP.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    codes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def brute_components(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    low, size = {}, Counter(find(i) for i in range(len(rows)))
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], f"{prints[i]:016x}", low.get(find(i)), size[find(i)] - 1) for i, r in enumerate(rows)), key=repr)


def near_rows():
    draw = random.Random(9)
    base = [" ".join(f"v{draw.randint(0, 99999)}" for _ in range(300)) for _ in range(6)]
    out = []
    for n in range(60):
        words = draw.choice(base).split()
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = f"x{draw.randint(0, 9)}"
        out.append((1000 + n, " ".join(words)))
    return out


def test_near_dedup(spark, docs, no_docs, rows, monkeypatch):
    every = [(r[0], r[1]) for r in rows] + near_rows()
    frame = spark.createDataFrame(every, "doc_id long, text string")
    want = brute_components(every)
    columns = ("doc_id", "fingerprint", "component_id", "n_links")
    assert tuples(simhash.near_dedup(frame), *columns) == want
    monkeypatch.setattr(simhash, "LEAF", 8)
    assert tuples(simhash.near_dedup(frame), *columns) == want
    # Few large leaves, cut into blocks of points and of askers.
    monkeypatch.setattr(simhash, "LEAF", 2)
    monkeypatch.setattr(simhash, "DEEPEST", 2)
    monkeypatch.setattr(simhash, "ASKING", 8)
    monkeypatch.setattr(simhash, "DEALT", 7)
    assert tuples(simhash.near_dedup(frame), *columns) == want
    assert simhash.near_dedup(no_docs).count() == 0
    left = simhash.drop_near_copies(docs)
    assert left.columns == docs.columns
    small = brute_components([(r[0], r[1]) for r in rows])
    assert Counter(r[0] for r in left.collect()) == Counter(w[0] for w in small if w[0] == w[2] or w[2] is None)


def test_long_chains_of_links(spark):
    prints = [(1 << k) - 1 for k in range(0, 64, 3)]
    points = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    simhash.shared_dir(spark, "test")
    roots = {r.root for r in simhash._connected(simhash._stars(points, 4 * simhash.LEAF, 4)).collect()}
    assert len(roots) == 1


def test_few_links_leave_few_files(spark, monkeypatch):
    draw = np.random.default_rng(1)
    fp, star = draw.integers(-40, 40, 60), draw.integers(-40, 40, 60)
    stars = spark.createDataFrame([(int(f), int(s)) for a, b in zip(fp, star, strict=True) for f, s in ((a, b), (b, b))], "fp long, star long").checkpoint()
    spark.sparkContext.setJobGroup("few links", "")
    few = simhash._connected(stars)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 4 and few.rdd.getNumPartitions() == 1
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, simhash._connected(stars).collect()))


def test_tree_reaches_every_link():
    draw = np.random.default_rng(0)
    fp = draw.integers(0, 1 << 63, 1500, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, fp ^ (np.uint64(1) << draw.integers(0, 63, 1500, dtype=np.uint64))]))
    tree = simhash.Tree.fitted(fp[::3], 4)
    home, (index, leaf) = tree.leaf(fp), tree.reach(fp, 4)
    reach = set(zip(index.tolist(), leaf.tolist(), strict=True))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4)
    assert all(p in reach for p in zip(i.tolist(), home[j].tolist(), strict=True))
    label = simhash.components(fp, np.zeros(0, np.uint64), 4, fp[3])
    assert (label == simhash.merged(np.arange(len(fp)), i, j)).all()


SF = "/root/testdata/sf0.01"


def fold(n, by):
    return zlib.crc32(str(n).encode()) % by


def test_quality_on_held_out_rows(spark, docs, no_docs):
    larger = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    machine = quality.fit(table, labels)
    scores = {r.doc_id: r.score for r in quality.score(table.select("doc_id", "text"), machine).collect()}
    known = [(scores[r.doc_id], r.quality) for r in labels.collect() if fold(r.doc_id, 5) == 0]
    assert np.mean([(s >= 0.3) == q for s, q in known]) > 0.98
    own = quality.score(docs, machine, column="fm_score")
    assert own.count() == docs.count() and own.filter("fm_score IS NULL OR fm_score < 0 OR fm_score > 1").isEmpty()
    assert quality.score(no_docs, machine).count() == 0
    assert quality.accepted(docs, machine).columns == docs.columns
    empty = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs.select("text"), empty).collect()} == {0.5}


def test_sum_of_squares_identity():
    draw = np.random.default_rng(4)
    width = (1 << quality.BITS) + len(quality.DENSE)
    machine = quality.Machine(0.3, draw.normal(size=width), draw.normal(size=(width, quality.RANK)), np.zeros(len(quality.DENSE)), np.ones(len(quality.DENSE)))
    bucket, value, dense = np.array([5, 9, 200]), np.array([0.5, 1.0, 2.0]), draw.normal(size=(1, len(quality.DENSE)))
    x = np.concatenate([value, quality._split(dense, machine)[0]])
    at = np.concatenate([bucket, (1 << quality.BITS) + np.arange(len(quality.DENSE))])
    want = machine.bias + machine.linear[at] @ x + sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert np.isclose(quality.margins(machine, dense, np.zeros(3, int), bucket, value)[0], want)


def test_language_on_held_out_rows(spark, docs, no_docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    models = language.fit(table)
    truth = {r.doc_id: r.lang for r in table.select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in language.predict(table, models).collect()}
    assert np.mean([got[i].lang_pred == truth[i] for i in truth if fold(i, 4) == 2]) > 0.97
    own = language.predict(docs, models).collect()
    assert len(own) == docs.count() and all(0 <= r.score <= 1 for r in own)
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "12 ... 9"), (4, "日本"), (5, "é")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in language.predict(texts, models).collect()} == {1: True, 2: True, 3: True, 4: False, 5: False}
    assert language.predict(no_docs, models).count() == 0
    nothing = language.fit(no_docs)
    assert {r.lang_pred for r in language.predict(texts, nothing).collect()} == {"und"}


def test_language_mixture(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    models = language.fit(table)
    one, two = (table.filter(f"lang = '{k}' AND n_chars > 1500").orderBy("doc_id").first().text[:1500] for k in ("en", "fr"))
    (row,) = language.predict(spark.createDataFrame([(1, f"{one} {two}")], "doc_id long, text string"), models).collect()
    assert set(row.shares) == {"en", "fr"} and 0.3 < row.shares["fr"] < 0.7


PAGES = [(1, "http://a/x y", "<p>" + "é" * 200), (2, None, "<p>" + "é" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 9000), (0, "u", "<p>" + "é" * 200), (0, "u", "<p>" + "é" * 200), (None, "u", "<p>" + "é" * 200), (9, "u", "x" * 100), (8, "u", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "\n\r\n" * 50), (None, "u", "z" * 300)]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_archives(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(warc, "RECORDS", 7)
    pages = spark.createDataFrame([(*p, "d", 1) for p in PAGES], "page_id long, url string, html string, digest string, refers_to int")
    warc.shared_dir(spark, "test")
    warc.write_archives(pages, str(tmp_path / "w"), segment=5000)
    got = sorted(map(tuple, warc.read_archives(spark, str(tmp_path / "w"), payloads=True).collect()), key=repr)
    first = defaultdict(list)
    for i, _, html in PAGES:
        first[html or ""].append(i)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        keep = min((x for x in first[html or ""] if x is not None), default=None)
        again = len(body) >= 100 and keep is not None and keep != i
        want.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", keep if again else None, None if again else body))
    assert [(*g[:5], None if g[5] is None else bytes(g[5])) for g in got] == sorted(want, key=repr)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    raw = b"".join(map(gzip.decompress, files))
    records = list(warc.parse(raw))
    assert sum(f["warc-type"] == "continuation" for f, _ in records) > 20
    assert len(files) > 3 and sum(map(len, files)) < len(raw) and records == [r for f in files for r in warc.parse(warc.inflated(f))]
    # Every record begins a member of its own.
    assert sum(f.count(b"\x1f\x8b\x08") for f in files) >= len(records)
    assert warc.unanswered(warc.read_archives(spark, str(tmp_path / "w"))).count() == 0
    broken = spark.createDataFrame([(1, "response", None, "a"), (2, "revisit", 1, "a"), (3, "revisit", 1, "b"), (4, "revisit", 9, "a")], "page_id long, record_type string, refers_to long, payload_digest string")
    assert sorted(r.page_id for r in warc.unanswered(broken).collect()) == [3, 4]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_broken_archives():
    assert warc.unchunked(warc.chunked(b"abc" * 9, 4)) == b"abc" * 9 and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    for bad in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc", b"", b"-3\r\nabc\r\n0\r\n\r\n", b"+3\r\nabc\r\n0\r\n\r\n", b"\r\n0\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    (record,) = warc.page_records(1, "u", b"abc", None, "0-0")
    assert [b for _, b in warc.parse(record * 3)] == [b for _, b in warc.parse(record[k : k + 1] for k in range(len(record)))] * 3
    size = next(v for f, _ in warc.parse(record) for k, v in f.items() if k == "content-length").encode()
    odd = [record + b"rest", record[:-3], record.replace(b"Length: " + size, b"Length: -1"), record.replace(b"Length: " + size, b"Length: 5"), b"x" * 90]
    for bad in odd:
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    huge = bytes(range(256)) * 40_000  # over one member
    packed = b"".join(m + b"\0" for m in warc.members(huge))
    assert len(warc.members(huge)) == 2 and b"".join(warc.inflated(packed)) == huge == gzip.decompress(packed)
    for bad in (packed[:-9], packed[:50] + b"zz" + packed[52:]):
        with pytest.raises(ValueError):
            list(warc.inflated(bad))
