"""The registered queries on small tables, against brute force: their columns, folds, thresholds and projections."""

import hashlib
import re
import zlib

import pytest

from tessera.llm import registry
from tests_llm_help import brute_hits, check_pieces, crc, library_ids
from test_scores_and_links import brute_components, brute_substrings

ITEMS = [(0, " ".join(f"w{k}" for k in range(30))), (2, "one two"), (4, None), (None, "beta gamma")]
PAGES = [(1, "u", "x" * 200), (2, "u", "x" * 200), (3, None, None), (4, "v", "short"), (5, "v", "short"), (None, "w", "x" * 200)]
BASE = [re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(3 * n, n % 2, 0) for n in range(60)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    return path


def rows_of(spark, folder, name, columns):
    got = registry.QUERIES[name](spark, folder)
    assert got.columns[: len(columns.split())] == columns.split()
    return got.collect()


def fold(doc_id, by):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % by


def test_quality_and_language(spark, folder, rows):
    scored = rows_of(spark, folder, "op1_quality", "doc_id held_out score predicted")
    assert len(scored) == len(rows)
    for r in scored:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (None if r.doc_id is None else fold(r.doc_id, 5) == 0)
    found = rows_of(spark, folder, "op2_language", "doc_id held_out lang_pred score")
    text = {}
    for r in rows:
        text.setdefault(r[0], set()).add(r[1])
    for r in found:
        lettered = any(c.isalpha() for t in text[r.doc_id] for c in t or "")
        assert 0 <= r.score <= 1 and r.lang_pred in (("en",) if lettered else ("und",)) and r.held_out == (None if r.doc_id is None else fold(r.doc_id, 4) == 2)


def test_dedup(spark, folder, rows):
    got = rows_of(spark, folder, "op3_substring_dedup", "doc_id n_words n_removed kept_sha256")
    assert sorted(map(tuple, got), key=repr) == sorted((w[:4] for w in brute_substrings(rows, 13)), key=repr)
    got = rows_of(spark, folder, "op4_simhash", "doc_id fingerprint component_id")
    assert sorted(map(tuple, got), key=repr) == brute_components([(r[0], r[1]) for r in rows])
    assert {r.doc_id for r in rows_of(spark, folder, "op6_exact_dedup", "doc_id keep_id group_size kept text_sha256")} == {r[0] for r in rows}


def test_tokens(spark, folder, rows):
    got = rows_of(spark, folder, "op5_packing", "doc_id start length ids_crc32 doc_tokens sequence_id offset")
    check_pieces(got, [(r[0], r[1]) for r in rows], 2, 4096)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = library_ids([r[1] for r in order], 1)
    got = sorted(rows_of(spark, folder, "op8_token_files", "doc_id start n_tokens ids_crc32"), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r[0] for r in order] and [r.start for r in got] == [sum(map(len, ids[:k])) for k in range(len(ids))]
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((r[0] or -1, len(i), crc(i)) for r, i in zip(order, ids, strict=True))


def test_hits_and_secrets(spark, folder, rows):
    got = rows_of(spark, folder, "op9_decontamination", "doc_id n_words n_hit n_items items_sha256 contaminated")
    want = []
    for r in rows:
        own = brute_hits(r[1], [i for i in ITEMS if i[1]], 10)
        names = sorted(str(i) for i, t in ITEMS if i is not None and t and brute_hits(r[1], [(i, t)], 10)[1])
        want.append((r[0], own[0], own[1], len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), own[4]))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    longest = []
    for r in rows:
        own, best = split(r[1]), []
        for i, text in ITEMS:
            item = split(text)
            for at in range(len(own)):
                for k in range(len(item)):
                    n = 0
                    while at + n < len(own) and k + n < len(item) and own[at + n] == item[k + n]:
                        n += 1
                    if n >= min(10, len(item)) and not (at and k and own[at - 1] == item[k - 1]):
                        best.append((-n, at, i is not None, str(i), k))
        n, at, known, i, k = min(best, default=(0, None, False, None, None))
        longest.append((r[0], -n or None, i if known else None, at, k))
    assert sorted(((r.doc_id, r.match_words, r.match_item, r.match_at, r.match_item_at) for r in got), key=repr) == sorted(longest, key=repr)
    assert sum(m[1] is not None for m in longest) > 10
    want = []
    for r in rows:
        text, found = r[1] or "", []
        for k, (kind, least) in enumerate((("assign", 12), ("access", 18), ("hex", 16))):
            found += [(m.start(), k, kind, m.end()) for m in BASE[k].finditer(text) if len(m.group(2 if not k else 0)) >= least]
        base = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        want.append((r[0], *(sum(f[1] == k for f in found) for k in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    got = rows_of(spark, folder, "op10_secrets", "doc_id n_assign n_access n_hex base_sha256 spans")
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr) and sum(w[1] for w in want) > 1
    for r in got:
        at = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert at == sorted(at)


def test_archives(spark, folder):
    got = rows_of(spark, folder, "op7_warc", "page_id payload_bytes payload_digest record_type refers_to")
    body = {i: (h or "").encode() for i, _, h in PAGES}
    again = {2: 1, None: 1}
    want = [(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if i in again else "response", again.get(i)) for i, b in body.items()]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
