"""Dedup, repeats, decontamination, licenses and mixing against brute force, with dirty rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from promptmill.llm import decontaminate, exact_dedup, license_scan, mixing, near_dedup, substring_dedup, suffix_dedup
from promptmill.llm.common import NO_ID

SCHEMA = "doc_id long, text string, source string, doc long, slice int, text_key string, marks int, node long, label int, size int"
WORDS = [f"w{i}" for i in range(4000)]


def _passage(seed, n):
    r = np.random.RandomState(seed)
    return [WORDS[k] for k in r.randint(0, len(WORDS), n)]


def _dirty_rows():
    """Nulls, empties, copies, near copies, shared passages, a long text, ties, repeated rows and doc_ids."""
    base, shared = _passage(1, 120), _passage(2, 40)
    near = list(base)
    near[60] = "changed"
    far = [w if i % 6 else "x" for i, w in enumerate(base)]
    long_text = " ".join(_passage(3, 3000) + shared + _passage(4, 3000) + shared)
    texts = [
        (5, " ".join(base)), (3, " ".join(base)), (9, "\t".join(base)), (7, " ".join(near)), (8, " ".join(far)),
        (1, " ".join(_passage(5, 30) + shared)), (2, " ".join(shared + _passage(6, 30))), (4, long_text), (6, None), (10, ""),
        (11, "  \n "), (12, "ein Käse " * 40), (13, "one two"), (14, "two  one"), (15, "One TWO"), (16, "one two"),
        (None, " ".join(shared)), (None, None), (5, " ".join(base)), (17, "a a a a a a a a a a a a a a a a a a a a"),
        (18, " ".join(shared[:13])), (18, " ".join(shared[5:20])), (19, "é" * 150), (20, "é" * 150 + "z"),
    ]
    return [(i, t, "s" + str((i or 0) % 4) if i != 6 else None, 1, 2, "k", 3, 4, 1, 5) for i, t in texts]


@pytest.fixture(scope="module")
def rows():
    return _dirty_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(doc_id):
    return NO_ID if doc_id is None else doc_id


def _got(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_exact_duplicates(docs, rows, empty):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = Counter()
    for text, own in groups.items():
        best = min((-len(r[1] or ""), _key(r[0])) for r in own)
        for r in own:
            keep = None if best[1] == NO_ID else best[1]
            want[(r[0], keep, len(own), (-len(r[1] or ""), _key(r[0])) == best, _sha(text))] += 1
    assert _got(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)


def test_exact_duplicates_with_a_clash_of_chunk_hashes(spark, docs, monkeypatch):
    want = _got(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    real = exact_dedup.chunk_table

    def with_clash(texts):
        table = real(texts)
        one = table.select("chunk_hash").first()[0]
        return table.unionByName(spark.createDataFrame([(one, bytearray(b"other"), 1)], table.schema))

    monkeypatch.setattr(exact_dedup, "chunk_table", with_clash)
    assert _got(exact_dedup.exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_long_texts_are_cut_alike():
    data = np.frombuffer(" ".join(_passage(8, 60000)).encode(), np.uint8)
    ends = exact_dedup._cuts(data, np.array([0, len(data)]))
    assert len(ends) > 20 and ends[-1] == len(data)
    shifted = exact_dedup._cuts(np.r_[np.frombuffer(b"abc", np.uint8), data], np.array([0, len(data) + 3]))
    assert set(ends[1:] + 3) <= set(shifted)


def test_repeated_words(docs, rows, empty):
    first = {}
    for r in rows:
        w = _words(r[1])
        for s in range(len(w) - 12):
            gram = tuple(w[s : s + 13])
            first[gram] = min(first.get(gram, NO_ID), _key(r[0]))
    want = Counter()
    for r in rows:
        w = _words(r[1])
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < _key(r[0]):
                gone.update(range(s, s + 13))
        want[(r[0], len(w), len(gone), _sha(" ".join(x for i, x in enumerate(w) if i not in gone)))] += 1
    assert _got(substring_dedup.remove_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_levels_double():
    assert substring_dedup.levels(13) == [7, 13]
    assert substring_dedup.levels(50) == [7, 14, 28, 50]


def _brute_bytes(rows, window):
    order = sorted({(_key(r[0]), r[1] or "") for r in rows})
    first = {}
    for doc, text in order:
        b = text.encode()
        for s in range(len(b) - window + 1):
            place = (doc, s)
            first[b[s : s + window]] = min(first.get(b[s : s + window], place), place)
    found = {}
    for doc, text in order:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if first[b[s : s + window]] < (doc, s):
                gone[s : s + window] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        found[(doc, text)] = (len(b), int(gone.sum()), spans, _sha(np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return Counter((r[0], *found[(_key(r[0]), r[1] or "")]) for r in rows)


BYTE_COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeated_bytes(docs, rows, empty):
    assert _got(suffix_dedup.remove_repeats(docs), *BYTE_COLUMNS) == _brute_bytes(rows, 100)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("limit", [0, 2])
def test_repeated_bytes_of_very_frequent_grams(docs, rows, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "MOST_PLACES", limit)
    monkeypatch.setattr(suffix_dedup, "MOST_IN_TASK", limit)
    assert _got(suffix_dedup.remove_repeats(docs), *BYTE_COLUMNS) == _brute_bytes(rows, 100)


@pytest.mark.parametrize("text", ["banana", "a" * 50, "abab" * 20, "zyx" * 9 + "a", "", "b"])
def test_suffix_array(text):
    data = np.frombuffer(text.encode(), np.uint8)
    assert suffix_dedup.suffix_array(data, len(data) + 1).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_random_runs():
    r = np.random.RandomState(3)
    data = np.repeat(r.randint(1, 4, 300), r.randint(1, 7, 300)).astype(np.uint8)
    raw = data.tobytes()
    order = suffix_dedup.suffix_array(data, len(data))
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    prefixes = suffix_dedup.common_prefixes(data, order, 20)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:20], raw[order[k] :][:20]
        n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert prefixes[k] == n


def _shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in _words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _brute_components(rows):
    sets = [(_key(r[0]), _shingles(r[1])) for r in rows]
    parent = {d: d for d, _ in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                a_, b_ = root(a), root(b)
                parent[max(a_, b_)] = min(a_, b_)
    show = lambda d: None if d == NO_ID else d
    return Counter((show(d), len(s), show(root(d) if s else d), not s or root(d) == d) for d, s in sets)


NEAR_COLUMNS = ["doc_id", "n_shingles", "component_id", "kept"]


def test_near_duplicates(docs, rows, empty):
    assert _got(near_dedup.near_duplicates(docs), *NEAR_COLUMNS) == _brute_components(rows)
    assert near_dedup.near_duplicates(empty).count() == 0
    kept = near_dedup.keep_representatives(docs)
    assert kept.columns == docs.columns


def _chain(n):
    """Texts that change a little at every step: neighbours are linked, ends are not."""
    text = _passage(9, 200)
    rows = []
    for i in range(n):
        rows.append((100 + i, " ".join(text), "s", 0, 0, "", 0, 0, 0, 0))
        text = text[3:] + _passage(1000 + i, 3)
    return rows


def test_near_duplicates_of_a_group_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SIDE_SHINGLES", 1500)
    rows = _chain(40)
    got = _got(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), *NEAR_COLUMNS)
    assert got == _brute_components(rows)
    assert len({r[2] for r in got}) < len(rows)


def _pair_at(shared, union, seed):
    """Two texts of which `shared` of `union` shingles are common: the second one ends otherwise."""
    n = shared + 4
    head, more = _passage(seed, n), (union - shared) // 2
    return " ".join(head + _passage(seed + 1, more)), " ".join(head + _passage(seed + 2, union - shared - more))


def test_near_duplicates_at_another_threshold(spark):
    rows = []
    for i in range(20):
        rows += [(2 * i, t) for t in [_pair_at(82, 100, 50 + 10 * i)[0]]] + [(2 * i + 1, t) for t in [_pair_at(82, 100, 50 + 10 * i)[1]]]
    a, b = _shingles(rows[0][1]), _shingles(rows[1][1])
    assert len(a & b) == 82 and len(a | b) == 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert near_dedup.keep_representatives(docs, 85).count() == 40
    assert {r.doc_id for r in near_dedup.keep_representatives(docs, 80).collect()} == set(range(0, 40, 2))
    assert {r.doc_id for r in corpus_pipeline.remove_near_copies(spark, docs, "").collect()} == set(range(0, 40, 2))
    for percent in (80, 85):
        bands, places = near_dedup.banding(percent)
        assert (1 - (percent / 100) ** places) ** bands < 5e-6
    assert near_dedup.banding(85) == (32, 7)


def test_different_documents_under_one_key_are_kept(spark):
    base = _passage(70, 120)
    near = base[:60] + ["changed"] + base[61:]
    texts = [_passage(80 + i, 50) for i in range(4)]
    rows = [(1, " ".join(base)), (None, " ".join(near)), *[(None, " ".join(t)) for t in texts], (2, " ".join(_passage(90, 60))), (2, " ".join(_passage(91, 60)))]
    rows += [(3, " ".join(base[:60] + ["other"] + base[61:])), (2, " ".join(_passage(91, 60))), (None, ""), (4, None)]
    kept = near_dedup.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [rows[0], *rows[2:6], rows[6], rows[7], (None, ""), (4, None)]
    assert Counter(map(tuple, kept.collect())) == Counter(want)


def test_superminhash_estimates_similarity():
    r = np.random.RandomState(1)
    a = r.randint(0, 2**62, 1000).astype(np.uint64)
    b = np.r_[a[:800], r.randint(0, 2**62, 200).astype(np.uint64)]
    signature = near_dedup.superminhash(np.r_[a, b], np.array([0, 1000, 2000]), 512)
    assert abs((signature[0] == signature[1]).mean() - 800 / 1200) < 0.06
    # in every place the smallest (rank, value): no place is left out
    assert (signature < np.uint64(512 << 48)).all()


def test_components(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8), (8, 7), (7, 9), (5, 5), (20, 1)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dedup.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def _alnum(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


@pytest.fixture(scope="module")
def benchmark(spark):
    shared, base = _passage(2, 40), _passage(1, 120)
    items = [(1, " ".join(shared[:20])), (22, " ".join(base[10:40]).upper()), (3, "one, two"), (4, None), (5, "..."), (None, " ".join(shared[20:35])), (1, "Käse ein")]
    return spark.createDataFrame(items, "item_id int, text string")


@pytest.mark.parametrize("most", [decontaminate.MOST_WINDOWS, 0])
def test_contamination(docs, rows, benchmark, empty, most):
    windows = defaultdict(set)
    for item, text in (tuple(r) for r in benchmark.collect()):
        w = _alnum(text)
        for s in range(max(1, len(w) - 12)):
            if w:
                windows[tuple(w[s : s + 13])].add(item)
    want = Counter()
    for r in rows:
        w, hit, items = _alnum(r[1]), set(), set()
        for gram, own in windows.items():
            for s in range(len(w) - len(gram) + 1):
                if tuple(w[s : s + len(gram)]) == gram:
                    hit.update(range(s, s + len(gram)))
                    items |= own - {None}
        want[(r[0], len(w), len(hit), ",".join(sorted(map(str, items))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    found = decontaminate.contamination(docs, benchmark, most_windows=most)
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in found.collect())
    assert got == want
    assert decontaminate.contamination(empty, benchmark, most_windows=most).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, benchmark.limit(0), most_windows=most).collect())


def test_removal_of_contamination(docs, rows, benchmark):
    found = decontaminate.contamination(docs, benchmark)
    clean = decontaminate.remove_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert clean.count() == found.where("not contaminated").count()
    spans = decontaminate.remove_spans(docs, benchmark)
    left = {r.doc_id: len(r.clean_words) for r in spans.where("doc_id in (1, 4)").collect()}
    assert left == {r.doc_id: r.n_words - r.n_hit for r in found.where("doc_id in (1, 4)").collect()}


def test_license_scan(spark, empty):
    texts = [
        (1, "All rights reserved.\nLicensed under CC BY-NC 4.0\nall rights reserved"), (2, None), (3, "Released under the MIT License."),
        (4, "the gnu GENERAL public,license general public"), (5, "all rights"), (6, "cc by"), (3, "Released under the MIT License."),
        (7, "Licensed under the Apache License, Version 2.0"), (8, "Licensed under the MIT License, Version 2.0"), (9, "cc\nby"), (None, ""),
    ]
    docs = spark.createDataFrame([(i, t, "s", 0, 0, "", 0, 0, 0, 0) for i, t in texts], SCHEMA)
    got = _got(license_scan.license_scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert got == Counter(
        [
            (1, 13, 3, 0, 10, "cc-by,reserved", "cc-by,cc-by-nc,reserved", 1.0), (2, 0, 0, None, None, "", "", 0.0),
            (3, 5, 0, None, None, "", "mit", 1.0), (3, 5, 0, None, None, "", "mit", 1.0), (4, 7, 1, 2, 2, "gpl", "gpl", 1.0),
            (5, 2, 0, None, None, "", "", 0.0), (6, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (7, 8, 0, None, None, "", "apache", 1.0),
            (8, 8, 0, None, None, "", "", 0.0), (9, 2, 1, 0, 0, "cc-by", "cc-by", 1.0), (None, 0, 0, None, None, "", "", 0.0),
        ]
    )
    assert license_scan.license_scan(empty).count() == 0


def test_license_notices_over_several_lines_and_in_a_very_long_one(spark):
    mit = "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    filler = _passage(95, 20000)
    scattered = list(filler)
    for at, word in [(10, "copyright"), (5000, "all"), (9000, "rights"), (19000, "reserved")]:
        scattered[at] = word
    texts = [(1, mit), (2, bsd), (3, " ".join(scattered))]
    for k in range(40):  # at every place of a block
        texts.append((10 + k, " ".join(filler[: 180 + k]) + "\n" + mit))
    texts.append((4, " ".join(filler + ["copyright", "x", "all", "rights", "y", "reserved"] + filler)))
    got = {r.doc_id: r.labels for r in license_scan.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "", 4: "reserved-notice", **{10 + k: "mit" for k in range(40)}}


def _targets(sizes, weights=(5, 2, 1)):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        now = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and now[s] > 3 * sizes[s]}
        if not over:
            return now
        capped |= over


def test_mix(docs, rows, empty):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2]] += len(_words(r[1]))
    want = _targets(sizes)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, target in want.items():
        own = [len(_words(r[1])) for r in rows if r[2] == s]
        sums = {0}
        for n in own:
            sums = {a + n * k for a in sums for k in range(4)}
        nearest = min(abs(a - target) for a in sums)
        assert abs(taken[s] - target) <= nearest + 1
    again = mixing.mix(docs.repartition(3)).select("doc_id", "size", "taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r["size"], r.taken) for r in found)
    assert mixing.mix(empty).count() == 0


def test_targets_stop_at_three_times_the_size(spark):
    sizes = {"a": 10, "b": 1000, "c": 3, "d": 500, "e": 0, None: 7}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(_targets(sizes))


def test_subset_sum_is_the_best_one():
    r = np.random.RandomState(4)
    for _ in range(30):
        sizes, counts, budget = np.unique(r.randint(3, 40, 5)), r.randint(0, 4, 5), int(r.randint(1, 150))
        counts = counts[: len(sizes)]
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {a + int(s) * k for a in sums for k in range(c + 1)}
        take = mixing.subset_sum(sizes, counts, budget)
        assert (take <= counts).all() and (take >= 0).all()
        assert (take * sizes).sum() == min(sums, key=lambda a: (abs(a - budget), a))


def test_fit_of_a_large_source_leaves_nothing():
    r = np.random.RandomState(5)
    sizes = np.unique(r.randint(1, 5000, 2000))
    counts = r.randint(1, 2000, len(sizes))
    budget = int((sizes * counts).sum() * 0.37)
    take = mixing.fit(sizes, counts, budget)
    assert (take <= counts).all() and (take * sizes).sum() == budget
