"""Operators on documents against plain Python, on the odd rows and on none."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contactmill.llm import bpe, byte_bpe, exact_dedup, lang_id, mixing, rule_quality, set_sketch, spot_sigs, token_prefix

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_duplicates(odd_docs, odd_rows, no_docs):
    groups = defaultdict(list)
    for i, text, *_ in odd_rows:
        groups[WHITE.sub(" ", text or "")].append(i)
    want = Counter()
    for norm, ids in groups.items():
        keep, done = min((i for i in ids if i is not None), default=None), False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            want[i, keep, len(ids), kept, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact_dedup.exact_duplicates(odd_docs).collect())) == want
    assert exact_dedup.exact_duplicates(no_docs).count() == 0


def test_kept_rows_after_exact_dedup(odd_docs, odd_rows, no_docs):
    got = exact_dedup.drop_exact_duplicates(odd_docs)
    assert got.columns == odd_docs.columns
    texts = [WHITE.sub(" ", r.text or "") for r in got.collect()]
    assert Counter(texts) == Counter(WHITE.sub(" ", t or "") for t in {WHITE.sub(" ", r[1] or "") for r in odd_rows})
    assert exact_dedup.drop_exact_duplicates(no_docs).count() == 0


def near_classes(rows):
    """Smallest reachable doc_id by comparing all pairs."""
    sets = []
    for i, text, *_ in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    label = {i: i for i, s in sets if i is not None}
    linked = [(i, j) for i, a in sets for j, b in sets if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    while True:
        low = dict(label)
        for i, j in linked:
            low[i] = min(low[i], low[j])
        if low == label:
            return [(i, len(s), (label[i] if s else i) if i is not None else None) for i, s in sets]
        label = low


def test_near_duplicates(odd_docs, odd_rows, no_docs):
    got = Counter(tuple(r) for r in set_sketch.near_duplicates(odd_docs).collect())
    assert got == Counter((i, n, c, i == c) for i, n, c in near_classes(odd_rows))
    assert set_sketch.near_duplicates(no_docs).count() == 0
    kept = set_sketch.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns


def test_chains_of_near_copies(spark):
    """Only neighbours of a chain are linked, in a group too large for the first centres of its buckets."""
    text = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        text[i * 9 : i * 9 + 30] = [f"v{i}x{k}" for k in range(30)]
    want = near_classes(rows)
    got = set_sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_sketches_merge_and_estimate():
    draws = np.random.default_rng(1)
    a, b = draws.integers(0, 2**63, (2, 4000), dtype=np.uint64)
    b[:3000] = a[:3000]
    both = np.unique(np.concatenate([a, b]))
    x, y = set_sketch.sketch(a), set_sketch.sketch(b)
    assert (set_sketch.merged(x, y) == set_sketch.sketch(both)).all()
    found, _ = set_sketch.likely_similarity(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([4000]), np.array([4000]), 0.75)
    assert abs(found[0] - 0.6) < 0.12


def test_mix_reaches_targets(odd_docs, odd_rows, no_docs):
    rows = mixing.mixed_sizes(odd_docs, block_words=64).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(words(t))) for i, t, *_ in odd_rows)
    totals = defaultdict(int)
    for _, t, _, s in odd_rows:
        totals[s] += len(words(t))
    share = sum(totals.values()) * 1.5
    targets, weight = {}, dict(zip(sorted(totals, key=lambda s: (s is None, s or "")), (5, 2, 1), strict=True))
    while True:
        left = {s: w for s, w in weight.items() if s not in targets}
        rate = (share - sum(targets.values())) / sum(left.values()) if left else 0
        over = {s: 2.0 * totals[s] for s, w in left.items() if w * rate > 2 * totals[s]}
        if not over:
            break
        targets |= over
    targets |= {s: w * rate for s, w in left.items()}
    assert {r.source_size: r.target for r in rows} == pytest.approx({totals[s]: targets[s] for s in totals})
    for s in totals:
        got = sum(r.taken for r in rows if r.source_size == totals[s])
        assert abs(got - targets[s]) <= 1
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mixed_sizes(odd_docs, block_words=64).collect()))
    assert mixing.mixed_sizes(no_docs).count() == 0


def test_mixed_documents_hold_what_is_taken(odd_docs, no_docs):
    taken = sum(r.taken for r in mixing.mixed_sizes(odd_docs).collect())
    got = mixing.mixed_documents(odd_docs)
    assert got.columns == odd_docs.columns
    assert sum(len(words(r.text)) for r in got.collect()) == taken
    assert mixing.mixed_documents(no_docs).count() == 0


def test_mix_passes_follow_the_cap(spark):
    docs = spark.createDataFrame([(i, "a b c d", "ab"[i > 0]) for i in range(30)], "doc_id long, text string, source string")
    rows = mixing.mixed_sizes(docs, weights=(5, 1), cap=4.5).collect()
    assert {(r.source_size, r.target, r.taken) for r in rows if r.doc_id == 0} == {(4, 18.0, 18)}
    assert sum(r.taken for r in rows) == 180


def test_mix_tells_rows_with_equal_text_apart(spark):
    rows = [(1, "a b c", s, {"n": n}) for s in ("x", "y", None) for n in (1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, more map<string, int>")
    got = mixing.mixed_documents(docs, weights=(1,), share=2.0).collect()
    assert Counter((r.source, r.more["n"]) for r in got) == {(s, n): 2 for s in ("x", "y", None) for n in (1, 2)}


def test_schedule_interleaves_sources(spark):
    targets = spark.createDataFrame([("a", 1, 90_000, 50_000.0), ("b", 2, 90_000, 20_000.0)], "source string, source_no bigint, source_size bigint, target double")
    rows = sorted(mixing.schedule(targets, 100).collect(), key=lambda r: r.slot)
    for n in (70, 210, 700):
        assert abs(sum(r.source_no == 1 for r in rows[:n]) - n * 5 / 7) <= 3
    assert sum(r.words for r in rows if r.source_no == 1) == 50_000


def test_encode_and_decode(odd_docs, odd_rows, no_docs):
    for settings in ({}, {"block_chars": 500}):
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(byte_bpe.VOCABULARY), special_tokens={})
        got = Counter(tuple(r) for r in byte_bpe.digests(odd_docs, **settings).collect())
        want = Counter()
        for i, text, *_ in odd_rows:
            ids = np.array(encoding.encode_ordinary(text or ""), "<u4").tobytes()
            want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
        assert got == want
    texts = Counter((i, (t or "").encode()) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in byte_bpe.decode(byte_bpe.encode(odd_docs)).collect()) == texts
    assert byte_bpe.encode(no_docs).count() == byte_bpe.digests(no_docs).count() == 0


def test_token_counts(odd_docs, odd_rows, no_docs):
    library = Tokenizer.from_file(public_tokenizers.path(token_prefix.TOKENIZER))
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    got = token_prefix.token_counts(odd_docs).collect()
    want = Counter((i, len((t or "").encode()), count(t or "")) for i, t, *_ in odd_rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    texts = {i: t or "" for i, t, *_ in odd_rows if i not in (None, 10)}
    for r in got:
        if r.doc_id in texts and r.over_limit and len(texts[r.doc_id]) < 60_000:
            assert count(texts[r.doc_id][: r.fitting_chars]) <= 512 < count(texts[r.doc_id][: r.fitting_chars + 1])
    assert token_prefix.token_counts(no_docs).count() == 0
    sample = [(1, "we're  here<|endoftext|>\n\n now <|end 'll"), (2, None)]
    rows = token_prefix.prefix_counts(odd_docs.sparkSession.createDataFrame(sample, "doc_id long, text string")).collect()
    assert {r.doc_id: r.counts for r in rows} == {1: [count(sample[0][1][:k]) for k in range(1, len(sample[0][1]) + 1)], 2: []}


def test_spot_signatures(odd_docs, odd_rows, no_docs):
    rows = spot_sigs.edited_fingerprints(odd_docs).collect()
    assert len(rows) == len(odd_rows)
    order = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    by_text, want = {}, Counter()
    known = [r for r in order if sum(r[0] == q[0] for q in order) == 1]
    after = {r[0]: order[(order.index(r) + 1) % len(order)][1] or "" for r in known}
    for r in known:
        text, half = r[1] or "", len(r[1] or "") // 2
        want[r[0]] = hashlib.sha256((text[: len(text) - half] + after[r[0]][:half]).encode()).hexdigest()
    singles = {r.doc_id: r for r in rows}
    follows_one = [i for i in want if sum(after[i] == (q[1] or "") for q in odd_rows) == 1]
    assert follows_one and all(singles[i].edited_sha256 == want[i] for i in follows_one)
    texts = {i: t or "" for i, t, *_ in odd_rows if i in want}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint
        if r.doc_id in texts:
            assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert spot_sigs.edited_fingerprints(no_docs).count() == 0
    one = spot_sigs.edited_fingerprints(odd_docs.where("doc_id = 12")).collect()
    assert [r.near_next for r in one] == [1.0]


def test_near_fingerprints(odd_docs, no_docs):
    found = spot_sigs.fingerprints(odd_docs.where("doc_id > 10"))
    sets = {}
    for r in found.collect():
        sets.setdefault(frozenset(r.signatures), []).append(r.doc_id)
    heads = {min(ids): s for s, ids in sets.items()}
    want = {(i, j): len(a & b) / len(a | b) for i, a in heads.items() for j, b in heads.items() if i < j and len(a & b) >= 0.5 * len(a | b)}
    assert {(r.a, r.b): r.similarity for r in spot_sigs.near_pairs(found, 0.5).collect()} == pytest.approx(want)
    assert spot_sigs.near_pairs(spot_sigs.fingerprints(no_docs)).count() == 0


def test_language(spark, odd_docs, odd_rows, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs)
    rows = lang_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    got = lang_id.predict(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    texts = {i: t for i, t, *_ in odd_rows if i not in (None, 10)}
    for r in got:
        if r.doc_id in texts:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    untaught = lang_id.fit(no_docs)
    assert {r.lang_pred for r in lang_id.predict(odd_docs, untaught).collect()} == {"und"}
    assert lang_id.predict(no_docs, model).count() == 0


def test_language_learns_from_an_identifier_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = docs.where(~lang_id.held_out(F.col("doc_id")) & F.col("lang").isNotNull()).orderBy("doc_id").limit(1)
    copies = one.crossJoin(spark.range(1000).select("id")).drop("id")
    answers = [
        sorted((r.doc_id, r.lang_pred, r.score) for r in lang_id.predict(docs, lang_id.fit(table)).collect())
        for table in (docs, docs.unionByName(copies))
    ]
    assert answers[0] == answers[1]


def test_quality(spark, odd_docs, odd_rows, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = rule_quality.fit(docs, labels)
    rows = rule_quality.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.98
    got = rule_quality.score(odd_docs, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    kept = rule_quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r.predicted for r in got)
    untaught = rule_quality.fit(docs, labels.where("false"))
    assert {r.score for r in rule_quality.score(odd_docs, untaught).collect()} == {0.5}
    assert rule_quality.score(no_docs, model).count() == 0


def test_compiled_rules_agree_with_arrays(spark):
    draws = np.random.default_rng(2)
    columns = {c: draws.normal(size=500) for c in ("p", "q", "r")}
    label = ((columns["p"] > 0) & (columns["q"] < 0.5)).astype(int)
    model = rule_quality.fit_arrays(columns, label, trees=10)
    total = np.full(500, model.intercept) + sum(w * rule.holds(columns) for w, rule in model.rules)
    total = total + sum(w * np.clip(columns[c], low, high) for c, (w, low, high) in model.linear.items())
    frame = spark.createDataFrame(list(zip(range(500), *(map(float, columns[c]) for c in columns), strict=True)), "i int, p double, q double, r double")
    got = {r.i: r.score for r in frame.select("i", model.column({c: frame[c] for c in columns}).alias("score")).collect()}
    assert [got[i] for i in range(500)] == pytest.approx((1 / (1 + np.exp(-total))).tolist())
    assert np.mean((1 / (1 + np.exp(-total)) > 0.5) == label) > 0.97


def test_encode_scans_documents_once(spark, tmp_path):
    """The scan's partitions follow the cores known when it is planned: documents must not be cut from two scans."""
    rows = [(i, f"text {i} of {i % 7} " * (i % 5 + 1)) for i in range(400)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    blocks = byte_bpe._shuffled(spark.read.parquet(path), "doc_id", "text", byte_bpe.VOCABULARY, None, 1000, True)
    plan = blocks.count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1, plan
    encoded = byte_bpe.encode(spark.read.parquet(path), block_chars=1000, stored=True)
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in byte_bpe.decode(encoded).collect()} == set(rows)


def test_words_travel_in_bundles(spark, tmp_path, monkeypatch):
    """op3: a block sends one row a bucket and its head, not one row a word; words are any text, and tasks forget some."""
    odd = "".join(map(chr, (0, 1, 0xFF, 0x7FF, 0xFFFD, 0x10FFFF)))
    rows = [(i, f"w{i} \n{odd}{i * i} w{i % 3} \0\0 \r\n") for i in range(900)] + [(900, ""), (901, " "), (902, odd)]
    path = str(tmp_path / "documents")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    cut = docs.withColumn("key", F.lit(0).cast("long")).mapInArrow(byte_bpe._cut(None, 1 << 20), byte_bpe._CUT)
    bundles = cut.toArrow().to_batches()
    assert sum(b.num_rows for b in bundles) <= byte_bpe.BUCKETS + 1
    whole = list(byte_bpe._encode(byte_bpe.VOCABULARY)(iter(bundles)))
    monkeypatch.setattr(byte_bpe, "_KNOWN", 3)
    assert list(byte_bpe._encode(byte_bpe.VOCABULARY)(iter(bundles))) == whole
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(byte_bpe.VOCABULARY), special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in byte_bpe.encode(docs, stored=True).collect()}
    assert got == {i: encoding.encode_ordinary(text) for i, text in rows}
