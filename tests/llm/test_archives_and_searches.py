"""WARC archives, hard negatives and lexical ranking against brute force, with odd tables and crafted files."""

import base64
import gzip
import hashlib
import io
import json
import math
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from marketloom.llm import hardneg, lexical, warc

# warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected_pages(rows):
    """(page_id, bytes, digest, type, refers) of (page_id, url, html) rows, as a counter."""
    groups, out = {}, Counter()
    for page_id, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in groups.items():
        ids.sort(key=lambda x: -math.inf if x is None else x)
        out[ids[-1], len(payload), sha(payload), "response", None] += 1
        for i in ids[:-1]:
            out[i, len(payload), sha(payload), "revisit", ids[-1]] += 1
    return out


ODD_PAGES = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, None, None), (4, "http://b.example/é\n?q=a b", ""), (5, "u", "é𝄞" * 30000),
    (5, "u", "é𝄞" * 30000), (5, "v", "é𝄞" * 30000), (6, "http://[bad", "\r\n\r\nWARC/1.1\r\n"), (None, "http://c.example/", "<p>one</p>"), (None, None, "null id"), (None, None, "null id"), (-7, "http://d.example:80/", "minus"), (5, "u", "other"),
]


def read_back(spark, rows, **options):
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, sha string, uid int")
    archives = warc.write_archives(pages, **options)
    return archives, warc.read_records(warc.locate(archives))


def test_archives(spark, monkeypatch):
    for rows in (ODD_PAGES, ODD_PAGES[:1], []):
        archives, records = read_back(spark, rows)
        got = records.collect()
        assert all(r["sound"] for r in got) and sum(r["records"] for r in archives.collect()) == len(rows)
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(records).collect()) == expected_pages(rows)
        assert sorted(bytes(r["payload"]) for r in got if r["record_type"] == "response") == sorted({(h or "").encode() for *_, h in rows})
        ids = [r["record_id"] for r in got]
        assert len(set(ids)) == len(ids) and {r["refers_to"] for r in got} - {None} <= set(ids)
    # an archive for each record, groups of copies sent to all tasks
    monkeypatch.setattr(warc, "HOT_LEAST", 3)
    monkeypatch.setattr(warc, "HOT_GROUPS", 1_000_000)
    archives, records = read_back(spark, ODD_PAGES, archive_bytes=1)
    assert archives.count() >= len(ODD_PAGES) - 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.digest(records).collect()) == expected_pages(ODD_PAGES)


def test_other_readers_read_the_archives(spark):
    archives, _ = read_back(spark, ODD_PAGES)
    found = 0
    for r in archives.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None
            data = z.read("archive/data.warc.gz")
            about = {x["path"]: x for x in json.loads(z.read("datapackage.json"))["resources"]}
            assert about["archive/data.warc.gz"]["hash"] == "sha256:" + hashlib.sha256(data).hexdigest()
            lines = z.read("indexes/index.cdxj").decode().splitlines()
            assert lines == sorted(lines)
            for line in lines:
                entry = json.loads(line[line.index("{") :])
                one = gzip.decompress(data[int(entry["offset"]) : int(entry["offset"]) + int(entry["length"])])
                assert one.startswith(b"WARC/1.1\r\nWARC-Type: re") and one.endswith(b"\r\n\r\n")
                found += 1
    assert found == len(ODD_PAGES)


def foreign(parts, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(zipfile.ZipInfo(name), data, method)
        z.comment = comment
    return out.getvalue()


def reader(data):
    return lambda at, length: data[at : at + length]


def test_zip_directories(monkeypatch):
    parts = {f"archive/é{i}.warc": bytes([65 + i]) * (i * 50) for i in range(9)}
    plain = foreign(parts, comment=b"a comment with PK\x05\x06 in it" * 30)
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 4)
    wide = foreign(parts)
    assert b"PK\x06\x06" in wide and b"PK\x06\x06" not in plain
    for data in (plain, wide):
        members = warc.directory(reader(data), len(data))
        got = {m.name: data[(at := warc.data_at(reader(data), m)) : at + m.size] for m in members}
        assert got == parts and all(m.stored for m in members)
    assert warc.directory(reader(foreign({})), 22) == []
    for bad in (b"", b"no archive", plain[:-3][: len(plain) // 2]):
        with pytest.raises(ValueError):
            warc.directory(reader(bad), len(bad))


def test_foreign_archives(spark, tmp_path):
    records = [warc.record(i, f"http://x.example/{i}", f"body {i}".encode() * 2000, sha(f"body {i}".encode() * 2000), None, "", warc.CAPTURED) for i in range(5)]
    packed = [gzip.compress(r) for r in records]
    places = np.cumsum([0, *map(len, packed)])
    lines = "".join(f"x 2024 {json.dumps({'offset': str(places[i]), 'length': str(len(p)), 'filename': 'a.warc.gz'})}\n" for i, p in enumerate(packed)).encode()
    cut = len(lines) // 2
    files = {
        "walked": {"archive/a.warc.gz": b"".join(packed), "archive/b.warc": b"".join(records)},
        "indexed": {"archive/a.warc.gz": b"".join(packed), "indexes/index.cdx.gz": gzip.compress(lines[:cut]) + gzip.compress(lines[cut:])},
    }
    for name, parts in files.items():
        (tmp_path / name).write_bytes(foreign(parts))
        got = warc.read_records(warc.locate(spark.createDataFrame([(str(tmp_path / name), 1), (str(tmp_path / name), 2), (None, 3)], "path string, place int"))).collect()
        assert sorted(r["payload"][:6].decode() for r in got) == sorted(f"body {i}" for i in range(5) for _ in range(len([p for p in parts if "archive" in p])))
        assert all(r["sound"] for r in got)
    broken = packed[:4] + [gzip.compress(records[4].replace(b"body 4", b"BODY 4", 1))]
    (tmp_path / "broken").write_bytes(foreign({"archive/a.warc.gz": b"".join(broken)}))
    assert sorted(r["sound"] for r in warc.read_records(warc.locate(spark.createDataFrame([(str(tmp_path / "broken"),)], "path string"))).collect()) == [False, True, True, True, True]
    (tmp_path / "deflated").write_bytes(foreign({"archive/a.warc": b"".join(records)}, zipfile.ZIP_DEFLATED))
    with pytest.raises(ValueError, match="deflated"):
        list(warc._places(str(tmp_path / "deflated")))
    (tmp_path / "deflated index").write_bytes(foreign({"indexes/index.cdxj": lines}, zipfile.ZIP_DEFLATED))
    read, size = warc._opened(str(tmp_path / "deflated index"))
    assert len(list(warc._index_lines(read, warc.directory(read, size)[0]))) == 5


# hard negatives


def negatives(rows, fold=256, every=50):
    good = [(i, lab, [math.floor(fold * float(np.float32(x))) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = max((len(v) for *_, v in good), default=0)
    good = [(i, lab, v + [0] * (d - len(v))) for i, lab, v in good]
    x = np.array([v for *_, v in good], np.int64).reshape(len(good), d)
    ids, labels = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    out = []
    for a in sorted({i for i, *_ in good if i % every == 0}):
        _, label, v = min(g for g in good if g[0] == a)
        score = x @ np.array(v, np.int64)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != a]
        for p in [j for j in order if labels[j] == label][:5]:
            n = [j for j in order if labels[j] != label and 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:3]
            out += [(a, ids[p], k + 1, ids[j], score[p], score[j]) for k, j in enumerate(n)]
    return Counter(tuple(int(y) for y in r) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, monkeypatch, seed):
    monkeypatch.setattr(hardneg, "CELL_ROWS", 3)
    monkeypatch.setattr(hardneg, "FIRST_ROUND", 2)
    monkeypatch.setattr(hardneg, "MEET", 1)
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, 7)) * 0.4
    rows = [(i * 5, (centres[i % 4] + rnd.normal(size=7) * 0.2).tolist(), int(i % 4)) for i in range(150)]
    # copies and repeated rows among and beside the anchors, nulls, short vectors, opposite and zero ones
    rows += [(50, rows[10][1], 0)] * 8 + [(1000 + k, rows[3][1], k % 2) for k in range(60)] + [(2000 + k, rows[20][1], 1) for k in range(12)]
    rows += [(None, rows[0][1], 1), (7000, None, 1), (7050, [1.0, None], 1), (7100, [float("nan")] * 7, 1), (7150, [float("inf")] * 7, 0), (7200, rows[1][1], None), (7250, [0.5, 0.25], 2), (7300, [], 2), (7350, [-x for x in rows[0][1]], 3), (-50, rows[5][1], 1)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, cell string")
    got = Counter(tuple(r) for r in hardneg.mine(df).collect())
    assert got == negatives(rows) and got


def test_hard_negatives_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hardneg.mine(spark.createDataFrame([], schema)).count() == 0
    assert hardneg.mine(spark.createDataFrame([(0, [], 1), (50, [], 1), (1, [], 2)], schema)).collect() == [(0, 50, 1, 1, 0, 0), (50, 0, 1, 1, 0, 0)]
    assert hardneg.mine(spark.createDataFrame([(50, [1.0], 1)], schema)).count() == 0
    # one cell with more rows than a block
    rows = [(i, [1.0, 0.5 + i / 20000], i % 3) for i in range(2600)]
    assert Counter(tuple(r) for r in hardneg.mine(spark.createDataFrame(rows, schema)).collect()) == negatives(rows)


def test_hard_negatives_meet_in_small_batches(spark, monkeypatch):
    """Packs and blocks of up to 2,048 vectors each don't stand in an Arrow batch by the thousand; questions leave a task in parts."""
    bounds, usual = [], hardneg.settle
    monkeypatch.setattr(hardneg, "settle", lambda df, *a: bounds.append(a) or usual(df, *a) if "rank" in df.columns else usual(df, *a))
    monkeypatch.setattr(hardneg, "ASKED", 3, raising=False)
    monkeypatch.setattr(hardneg, "CELL_ROWS", 3)
    rnd = np.random.default_rng(1)
    rows = [(i * 5, rnd.normal(size=6).tolist(), int(i % 3)) for i in range(120)]
    got = Counter(tuple(r) for r in hardneg.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == negatives(rows) and got
    assert bounds and all(a and a[0] * 2 * hardneg.BLOCK * 64 * 8 <= 1 << 26 for a in bounds)


def test_walks_go_by_falling_bound_and_bounds_hold(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, rnd.normal(size=6).tolist(), 0) for i in range(700)]
    table, d = hardneg.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    index = hardneg.Index(table.persist(), d)
    held = {}
    for b in index.blocks.collect():
        held.setdefault(b["cell"], []).append(np.frombuffer(b["vectors"], np.int64).reshape(-1, d))
    assert sum(len(v) for x in held.values() for v in x) == 700
    a = rnd.integers(-300, 300, (20, d))
    for q, cells in zip(a, index.walks()(a), strict=True):
        seen = list(cells)
        assert sorted(c for *_, c in seen) == sorted(held) and [b for b, *_ in seen] == sorted((b for b, *_ in seen), reverse=True)
        for bound, upper, lower, cell in seen:
            scores = np.concatenate(held[cell]) @ q
            assert lower <= scores.min() and scores.max() <= upper <= bound + 1e-6


# lexical ranking


def ranking(docs, items, k=10):
    """The contract, word for word."""

    def terms(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total, df = len(counts), sum(sum(c.values()) for _, c in counts), Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scores.append((-s, math.inf if i is None else i, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k])]
    return Counter(out)


def lexical_tables():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ünder", "ÉTÉ", "été", "日本", "x1y2"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 60)))) for i in range(250)]
    docs += [(300 + i, docs[7][1]) for i in range(40)] + [(9, docs[9][1])] * 3 + [(None, docs[7][1]), (None, "w1 w1"), (400, None), (401, ""), (402, " -- "), (403, "w1-W1_w2\x00w3 " * 4000), (404, "a b ÉTÉ"), (405, "Ünder")]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randrange(1, 12)))) for i in range(25)] + [(25, None), (26, ""), (27, "unknown words"), (1, docs[7][1]), (1, docs[7][1]), (None, "w2 W2 ÉTÉ")]
    return docs, items


def test_lexical_ranking(spark):
    docs, items = lexical_tables()
    table = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, terms string")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    for options in ({}, {"item_bytes": 60}):
        assert Counter(tuple(r) for r in lexical.rank(table, asked, **options).collect()) == ranking(docs, items)
    none = lexical.rank(table.limit(0), asked)
    assert none.columns == ["item_id", "rank", "doc_id", "score"] and none.count() == 0
    assert lexical.rank(table, asked.limit(0)).count() == 0 and lexical.rank(table, asked.where("item_id = 27")).count() == 0


def test_terms():
    words, row = lexical.terms(pa.array(["A-b", None, "", "ÉA9_z", "--", "日本\x7f本", "x"]))
    assert words.to_pylist() == ["a", "b", "Éa9", "z", "日本", "本", "x"] and row.tolist() == [0, 0, 3, 3, 5, 5, 6]


def test_balls_hold_their_documents_and_prune():
    rnd = np.random.default_rng(5)
    topics = [rnd.choice(400, 30, replace=False) for _ in range(12)]
    lists = [np.sort(rnd.choice(topics[i % 12], rnd.integers(5, 25), replace=False)) for i in range(1500)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    term, x = np.concatenate(lists), rnd.integers(1, 900_000, bounds[-1])
    tree = lexical.Tree(np.arange(1500), bounds, term, x)
    dense = np.zeros((1500, 400), np.int64)
    dense[np.repeat(np.arange(1500), np.diff(bounds)), term] = x

    def below(node):
        kids = tree.kids[node]
        return np.concatenate([below(k) for k in kids]) if isinstance(kids, tuple) else kids

    visited = 0
    leaves = sum(not isinstance(k, tuple) for k in tree.kids)
    for _ in range(30):
        asked = np.sort(rnd.choice(topics[rnd.integers(12)], 8, replace=False))
        w = rnd.integers(1, 9000, 8)
        scores = dense[:, asked] @ w
        q = np.zeros(len(tree.own))
        q[np.searchsorted(tree.own, asked)] = w
        for node in range(len(tree.nodes)):
            assert scores[below(node)].max() <= tree.bound(node, q)
        best, seen = tree.search(asked, w, 10, 0)
        want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:10]
        assert sorted((-s, i) for s, i in best) == want
        visited += seen
    assert visited / 30 < leaves / 2
