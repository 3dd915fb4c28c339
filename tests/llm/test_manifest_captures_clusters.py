"""Merkle manifest, WARC captures and centroid clusters against brute force."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactmill.llm import hadamard, merkle, warc

# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """(root, siblings of every node from below as (left, right))."""
    paths, level, at = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level, at = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def slow_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    root, tops = climb([trees[g][0] for g in names]) if names else ("", [])
    for g, top in zip(names, tops):
        subroot, paths = trees[g]
        for (_, _, leaf, row), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            own, path = leaf, path + top
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[4] is not None:
                lowered = row[4].translate({i: i + 32 for i in range(65, 91)})
                own = leaf_of((*row[:4], lowered))
            for left, right in path:
                own = sha(left + own + right)
            yield row[0], leaf, subroot, root, sha("".join(a + b for a, b in path)), own, own == root


SHAPE = "doc_id long, source string, lang string, n_chars long, text string"


def same_manifest(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, SHAPE).repartition(partitions)
    for name in ("leaf", "_tree", "_rank", "root", "path", "_digest"):
        docs = docs.withColumn(name, F.lit(1))
    got = Counter(tuple(r) for r in merkle.manifest(docs).collect())
    assert got == Counter(slow_manifest(rows))


def test_manifest_of_trees_of_all_heights(spark):
    draws = random.Random(1)
    sizes = {None: 9, "a": 1, "b": 8, "c": 65, "é": 512, "d": 513, "Z": 5000, **{f"g{i:03}": 2 for i in range(70)}}
    rows = [(g, i) for g, n in sizes.items() for i in range(n)]
    rows = [(doc, "S" if doc % 3 else None, g, i, f"Text {i} Ünï") for doc, (g, i) in enumerate(rows)]
    draws.shuffle(rows)
    same_manifest(spark, rows, 8)


def test_manifest_of_more_blocks_than_one_block_holds(spark):
    n = 512 * 512 + 3
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("x").alias("lang"), F.lit(1).cast("long").alias("n_chars"),
        F.lit("T").alias("text"),
    )
    out = merkle.proofs(docs).where("doc_id in (0, 511, 262143, 262144, 262146)")
    leaves = [leaf_of((i, "s", "x", 1, "T")) for i in range(n)]
    root, paths = climb(leaves)
    for r in out.collect():
        assert (r.leaf, r.subroot, r.root) == (leaves[r.doc_id], root, root)
        assert [s.others for s in r.path] == [a + b for a, b in paths[r.doc_id]]


def test_manifest_of_odd_rows(spark, odd_rows):
    rows = [(i, s, g, None if t is None else len(t), t) for i, t, g, s in odd_rows]
    same_manifest(spark, rows)
    same_manifest(spark, [(None, None, None, None, None)])
    assert merkle.manifest(spark.createDataFrame([], SHAPE)).count() == 0


# ---- WARC

TRICKY = [
    "plain", "two\r\n\r\nparts", "\r\n\r\n", "ends with\r\n", "ends with\r", "ends\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\nx",
    "", None, "Ünï ☃", "x\r\n\r\r\n\r\n\r\ny\r", "long " * 60_000,
]


def pages_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for name in ("payload", "_key", "copies", "captured", "bytes", "value"):
        pages = pages.withColumn(name, F.lit("clash"))
    return pages


def slow_captures(rows, min_bytes=0):
    first = {}
    for page, url, html in rows:
        data = (html or "").encode()
        own = (page is None, page or 0, url is not None, url or "")
        first[data] = min(first.get(data, own), own)
    seen = set()
    for page, url, html in rows:
        data = (html or "").encode()
        own = (page is None, page or 0, url is not None, url or "")
        kind, refers = "response", None
        if len(data) >= min_bytes:
            if own != first[data] or (data, own) in seen:
                kind, refers = "revisit", None if first[data][0] else first[data][1]
            seen.add((data, own))
        yield page, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, refers


@pytest.mark.parametrize("min_bytes", [0, 6])
def test_captures_of_odd_pages(spark, min_bytes):
    rows = [(i, f"http://h{i % 3}.net/p", html) for i, html in enumerate(TRICKY, 10)]
    rows += [(3, "http://h.net/", "plain"), (3, "http://h.net/", "plain"), (3, None, "plain"), (None, None, "plain"), (None, "", None)]
    rows += [(None, "http://e.net/a\r\nb", "alone"), (-5, "no scheme#x", "alone too"), (7, "", "")]
    out = warc.archived(pages_of(spark, rows), min_bytes=min_bytes).collect()
    got = Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out)
    clean = lambda url: url and url.replace("\r", "%0D").replace("\n", "%0A")
    assert got == Counter((p, clean(u), *rest) for p, u, *rest in slow_captures(rows, min_bytes))
    assert warc.archived(pages_of(spark, rows).where("false")).count() == 0


def test_archives_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(1, "http://a.b/", "pay\r\n"), (2, "http://a.b/", "pay\r\n")]), str(tmp_path / "w"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "w").glob("*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.endswith(b"\r\n\r\n")
    assert b"Content-Length: 5\r\n\r\npay\r\n\r\n\r\n" in data and b"WARC-Type: revisit\r\n" in data


def test_damaged_archives_raise(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write_archives(pages_of(spark, [(1, "http://a.b/", "payload")]), str(folder))
    (path,) = [p for p in folder.glob("*.gz") if gzip.decompress(p.read_bytes())]
    good = gzip.decompress(path.read_bytes())
    for i, bad in enumerate((good.replace(b"payload", b"paxload"), good[:-9], good.replace(b"WARC/1.1", b"WORC/1.1"))):
        other = tmp_path / f"bad{i}"
        other.mkdir()
        (other / "x.gz").write_bytes(gzip.compress(bad))
        with pytest.raises(Exception, match="damaged|inside a record|no record"):
            warc.read_archives(spark, str(other)).collect()


def test_histories_are_in_global_order(spark):
    draws = random.Random(3)
    rows = [(i, "http://www.hot.org:80/x" if i % 3 else f"http://u@H{draws.randint(0, 40)}.org/{draws.randint(0, 3)}?q#f", f"p{i}") for i in range(900)]
    index = warc.read_archives(spark, written(spark, rows))
    out = warc.capture_histories(index, range_rows=100)
    seen, got = Counter(), out.collect()
    assert out.rdd.getNumPartitions() > 1 and len(got) == 900
    order = sorted(got, key=lambda r: (r.urlkey, r.captured, r.record_id))
    for r in order:
        seen[r.urlkey] += 1
        assert r.capture == seen[r.urlkey]
    assert seen["org,hot)/x"] == 600 and all("#" not in k and "@" not in k for k in seen)


def written(spark, rows):
    import uuid

    path = f"{spark.conf.get('spark.checkpoint.dir')}/captures-{uuid.uuid4().hex}"
    warc.write_archives(pages_of(spark, rows), path)
    return path


def test_loser_tree_equals_sorting():
    draws = random.Random(5)
    for k in (0, 1, 2, 3, 7, 8, 33):
        for longest in (0, 1, 5, 40):
            runs = [sorted(draws.randint(0, 9) for _ in range(draws.randint(0, longest))) for _ in range(k)]
            want = sorted((x, r, i) for r, run in enumerate(runs) for i, x in enumerate(run))
            assert list(warc.merge_order(runs)) == [(r, i) for _, r, i in want]


def test_url_keys(spark):
    urls = ["https://User@WWW2.Example.com:8080/A?b#c", "http://a.b", "http://a.b?x=1", "ftp://x/y", "a/b#c", "", None]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    got = [r.k for r in df.select("i", warc.url_key(F.col("u")).alias("k")).orderBy("i").collect()]
    assert got == ["com,example)/A?b", "b,a)/", "b,a)/?x=1", "x)/y", "a/b", "", ""]


# ---- centroid clustering


def slow_clusters(rows, k, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v):
            bound = float(1 << 56)
            kept.append((i, [int(np.floor(max(min(float(x) * 256, bound), -bound))) for x in v]))
    seeds = sorted(kept, key=lambda r: (sha(f"2:{'' if r[0] is None else r[0]}"), hadamard.coefficients(np.array([r[1]])).tolist()))[:k]
    cents = [list(v) for _, v in seeds]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    fit = lambda x: x if x < 1 << 63 else None
    inertia = {j: sum(d for d, c in found if c == j) for j in range(len(cents))}
    big = any(fit(d) is None for d, _ in found)
    odd = {c for d, c in found if fit(d) is None}
    for (i, _), (d, c) in zip(kept, found):
        mine = None if c in odd else fit(inertia[c])
        yield i, c, fit(d), mine, None if big else fit(sum(inertia.values())), sha(",".join(map(str, cents[c])))


def vectors_of(spark, rows, kind="double"):
    table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    for name in ("cluster", "coefs", "x", "distance", "label"):
        table = table.withColumn(name, F.lit(None).cast("int"))
    return table


@pytest.mark.parametrize("scale", [0.5, 0.004, 3e4, 1e12, 1e300])
def test_clusters_equal_brute_force(spark, scale):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * scale + (i % 4) * scale).tolist()) for i in range(120)]
    rows += [rows[5], (200, rows[5][1]), (None, rows[6][1]), (201, [0.0] * 64), (202, [-0.0] * 64)]
    rows += [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [None] + [1.0] * 63), (305, [float("nan")] * 64), (306, [float("-inf")] * 64)]
    out = hadamard.clusters(vectors_of(spark, rows), k=9, rounds=3)
    assert Counter(tuple(r) for r in out.collect()) == Counter(slow_clusters(rows, 9, 3))


def test_clusters_of_few_and_no_vectors(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    out = hadamard.clusters(vectors_of(spark, rows, "float"))
    assert Counter(tuple(r) for r in out.collect()) == Counter(slow_clusters(rows, 40, 5))
    assert hadamard.clusters(vectors_of(spark, [])).count() == 0
    assert hadamard.clusters(vectors_of(spark, [(1, None)])).count() == 0


def test_search_is_exact_and_transform_inverts():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (17, 64))
    c[9] = c[3]
    assert (hadamard.components(hadamard.coefficients(x)) == x).all()
    far = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    cluster, distance = hadamard.nearest(hadamard.coefficients(x), hadamard.coefficients(c))
    assert (cluster == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
