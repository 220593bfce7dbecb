"""Mixing, archives, language models, SimHash, packing, licences and the pipeline."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import licenses, lmscore, mixing, packing, simhash, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, f string, size string, target string, piece string"


def frame(spark, rows):
    """(doc_id, source, text) rows with further columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", "x", "x") for i, s, t in rows], DOCS)


def words(n, seed=0):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n))


# --- mixing --------------------------------------------------------------------------------------------------------------


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "é", "z", None]), rng.choice([None, "", words(rng.randint(1, 60), i)])) for i in range(200)]
    got = mixing.mix_sources(frame(spark, rows).repartition(5)).collect()
    size = {i: len((t or "").split()) for i, _, t in rows}
    by = collections.Counter()
    for i, s, _ in rows:
        by[s] += size[i]
    want = targets(by)
    taken = collections.Counter()
    for r in got:
        s = next(x for i, x, _ in rows if i == r.doc_id)
        taken[s] += r.taken
        assert r.size == size[r.doc_id] and r.source_size == by[s] and r.target == pytest.approx(want[s]) and r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 60 for s in by) and len(got) == 200
    again = mixing.mix_sources(frame(spark, rows).repartition(2)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_odd(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    out = mixing.mix_sources(frame(spark, [(None, None, None), (1, "a", ""), (1, "a", "")])).collect()
    assert len(out) == 3 and all(r.taken == 0 and r.target == 0 for r in out)
    whole = mixing.repeat_rows(mixing.mix_sources(frame(spark, [(i, "a", words(10, i)) for i in range(5)]), keep_row=True))
    assert whole.columns == frame(spark, []).columns and whole.count() == 5


# --- archives ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", ["gzip", None])
def test_warc(spark, tmp_path, compression):
    html = ["a", "a", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", None, "", "é" * 70_000, "a"]
    pages = spark.createDataFrame([(i, f"http://h/{i}" if i else None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, original string")
    path = str(tmp_path / "w")
    warc.write_warc(pages, path, compression=compression, records_per_file=4)
    records = warc.read_records(spark, path).cache()
    assert records.count() == 21
    first = {}
    for i, h in enumerate(html):
        first.setdefault(h or "", i)
    for r in warc.assemble(records).collect():
        i = int(r.metadata.fields["page-id"])
        data = (html[i] or "").encode()
        assert r.request.target_uri == (f"http://h/{i}" if i else "urn:none")
        assert r.response.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert int(r.metadata.fields["payload-bytes"]) == len(data)
        assert (r.response.type == "response") == (first[html[i] or ""] == i)
        assert r.response.type == "revisit" or bytes(r.response.payload) == data
    assert warc.assemble(records).count() == 7


def test_warc_members_and_directions(spark):
    one = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r>\r\nWARC-Concurrent-To: <q>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    two = b"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <q>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    import gzip

    for data in (one + two, gzip.compress(one) + gzip.compress(two)):
        assert [(dict(h)["warc-record-id"], b, whole) for h, b, whole in warc.parse_archive(data)] == [("<r>", b"hi", True), ("<q>", b"", True)]
    bad = one.replace(b"Length: 2", b"Length: x")
    seen = lambda data: [(dict(h).get("warc-record-id"), b, whole) for h, b, whole in warc.parse_archive(data)]
    packed = gzip.compress(one)
    assert seen(bad + two) == [("<r>", b"", False), ("<q>", b"", True)]
    assert seen(packed + b"garbage") == [("<r>", b"hi", True)] and seen(packed + b"\x00" * 9) == [("<r>", b"hi", True)]
    assert seen(one + one[:-5]) == [("<r>", b"hi", True), ("<r>", b"h", False)] and seen(b"") == [] and seen(b"no archive") == []
    assert seen(gzip.compress(one + two)[:-20] + packed)[:1] == [("<r>", b"hi", True)] and seen(b"\x1f\x8bjunk") == []
    rows = [("<r>", "response", ["<q>"]), ("<q>", "request", [])]
    got = warc.assemble(spark.createDataFrame(rows, "record_id string, type string, concurrent_to array<string>")).first()
    assert got.request.record_id == "<q>" and got.metadata is None


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.assemble(warc.read_records(spark, str(tmp_path / "e"))).count() == 0


# --- language models -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot, tokens", [(1 << 16, 400_000), (20, 50)])
def test_scores(spark, hot, tokens):
    rng = random.Random(3)
    rows = [(i, "s", rng.choice([None, "", words(rng.randint(1, 40), i % 20), "The cat. " * 30])) for i in range(80)]
    docs = frame(spark, rows).withColumn("good", F.expr("CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false END"))
    got = {r.doc_id: (r.n_tokens, r.score) for r in lmscore.cross_entropy_difference(docs, "good", hot=hot, block_tokens=tokens, shard_chars=500).collect()}
    pair, one, ev = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()], {}
    for i, _, t in rows:
        w = ["<", *(t or "").lower().split(), ">"]
        ev[i] = list(zip(w, w[1:]))
        pair[i % 3 == 0].update(ev[i])
        one[i % 3 == 0].update(a for a, _ in ev[i])
    v, n = len(set(one[0]) | set(one[1])), [sum(c.values()) for c in pair]
    a = [0.1 * x / sum(n) for x in n]
    for i, e in ev.items():
        mine = i % 3 == 0
        own, first = collections.Counter(e), collections.Counter(x for x, _ in e)
        # a document's own occurrences do not count
        loss = lambda m: -sum(math.log((pair[m][x] - own[x] * (m == mine) + a[m]) / (one[m][x[0]] - first[x[0]] * (m == mine) + a[m] * v)) for x in e) / len(e)
        assert got[i][0] == len(e) and got[i][1] == pytest.approx(loss(1) - loss(0), abs=1e-9)


def test_scores_odd(spark):
    docs = frame(spark, []).withColumn("good", F.lit(True))
    assert lmscore.cross_entropy_difference(docs, "good").count() == 0
    flagged = lmscore.flag_target(frame(spark, [(None, "s", "a"), (1, "s", "a"), (1, "s", "a")]), spark.createDataFrame([(1,), (None,)], "doc_id long"))
    assert sorted(r._target for r in flagged.collect()) == [False, True, True]
    assert lmscore.cross_entropy_difference(flagged, "_target").count() == 3
    odd = spark.createDataFrame([(1, "a b", 5), (2, "c " * 50_000, 6)], ["d.id", "te.xt", "_target"])
    flagged = lmscore.flag_target(odd, spark.createDataFrame([(2,)], ["_target"]), "d.id")
    assert flagged.columns == ["d.id", "te.xt", "_target"]
    assert {r[0]: r.n_tokens for r in lmscore.cross_entropy_difference(flagged, "_target", "d.id", "te.xt").collect()} == {1: 3, 2: 50_001}


def test_a_copy_elsewhere_shows(spark):
    """Own counts are taken out, so a text scores like the target when a copy of it is there, not because it is there itself."""
    rows = [(i, "s", words(60, 100 + i)) for i in range(30)] + [(30, "s", words(60, 100))]
    docs = frame(spark, rows).withColumn("good", F.col("doc_id") < 10)
    got = {r.doc_id: r.score for r in lmscore.cross_entropy_difference(docs, "good").collect()}
    assert got[30] < min(got[i] for i in range(10, 30)) and got[0] > max(got[i] for i in range(1, 10))


# --- SimHash -------------------------------------------------------------------------------------------------------------


def test_anchors_cover():
    """Fingerprints that differ in three bits at most share an anchor that is the home of one of them."""
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    b = a.copy()
    for k in range(3):
        b ^= np.where(rng.random(3000) < 0.9, np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64), np.uint64(0))
    ka, ra = simhash.anchors(a)
    kb, rb = simhash.anchors(b)
    sa, sb = collections.defaultdict(set), collections.defaultdict(set)
    for k, r in zip(ka.tolist(), ra.tolist()):
        sa[r].add(k)
    for k, r in zip(kb.tolist(), rb.tolist()):
        sb[r].add(k)
    assert all(sa[i] & sb[i] for i in range(3000)) and max(map(len, sa.values())) <= 34


@pytest.mark.parametrize("dense", [False, True])
def test_links_are_complete(spark, dense):
    rng = np.random.default_rng(int(dense))
    centres = rng.integers(0, 1 << 62, 3 if dense else 60).astype(np.uint64)
    prints = []
    for c in centres:
        for _ in range(200 if dense else 6):
            x = int(c)
            for b in rng.choice(64, size=rng.integers(0, 5), replace=False):
                x ^= 1 << int(b)
            prints.append(x)
    prints = sorted(set(prints))
    up = {p: p for p in prints}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    arr = np.array(prints, np.uint64)
    for i, p in enumerate(prints):
        for q in arr[np.bitwise_count(arr ^ np.uint64(p)) <= 3].tolist():
            x, y = find(p), find(q)
            up[max(x, y)] = min(x, y)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    edges = simhash.link_fingerprints(spark.createDataFrame([(signed(p),) for p in prints], "f long").repartition(4)).collect()
    assert len(edges) < 40 * len(prints)
    got = {p: p for p in prints}

    def root(x):
        while got[x] != x:
            x = got[x]
        return x

    for e in edges:
        x, y = root(e.a % (1 << 64)), root(e.b % (1 << 64))
        assert bin((e.a ^ e.b) & ((1 << 64) - 1)).count("1") >= 1
        got[max(x, y)] = min(x, y)
    assert {p: root(p) for p in prints} == {p: find(p) for p in prints}


def test_simhash_documents(spark):
    text = words(300, 1)
    rows = [(5, "s", text), (3, "s", text), (9, "s", words(300, 2)), (7, "s", None), (8, "s", " "), (None, "s", text), (3, "s", text), (11, "s", "Two Words"), (12, "s", "two words")]
    got = [(r.doc_id, r.component_id, r.fingerprint) for r in simhash.simhash_components(frame(spark, rows)).collect()]
    assert {(a, b) for a, b, _ in got} == {(5, 3), (3, 3), (9, 9), (7, 7), (8, 7), (None, 3), (11, 11), (12, 11)} and len(got) == 9
    assert next(f for a, _, f in got if a == 7) == "0" * 16
    kept = simhash.drop_near_copies(frame(spark, rows), shingle=3)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9, 11] and kept.columns == frame(spark, []).columns
    assert simhash.simhash_components(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        simhash.link_fingerprints(spark.createDataFrame([(1,)], "f long"), 4)


# --- packing -------------------------------------------------------------------------------------------------------------


def test_word_tokenizer_is_exact():
    from tokenizers import Tokenizer

    definition = packing.tokenizer_file()
    fast, full = packing.WordTokenizer(definition), Tokenizer.from_str(definition)
    for text in (None, "", "Hello, wörld! it's İ ΑΣ ﬁne <|endoftext|>x y\x1cz é 日本 123 ÉCOLE. ß, ×÷", words(200), "a" * 3000, "l'élève\tn’est\x0bpas. \U0001f600"):
        assert np.frombuffer(fast(text), "<u4").tolist() == full.encode(text or "", add_special_tokens=False).ids


def test_genetic_operators_keep_every_piece():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 4096, 300).tolist()
    population = packing.evolve(lengths, [], 4096, packing.Evolution(generations=20), rng)
    child = packing.crossover(population[0], population[-1], lengths, 4096, rng)
    for p in (*population, child, packing.mutate(child, lengths, 4096, rng)):
        assert sorted(i for b in p.bins for i in b) == list(range(300))
        assert p.fills == [sum(lengths[i] for i in b) for b in p.bins] and max(p.fills) <= 4096
    first = packing.best_fit([], [], packing._decreasing(list(range(300)), lengths, rng, 0.0), lengths, 4096)
    assert population[0].rank() <= first.rank()


@pytest.mark.parametrize("seed", range(4))
def test_evolution_beats_best_fit_decreasing(seed):
    """Pieces about a third of a sequence, which best-fit decreasing puts together badly: evolution needs fewer sequences."""
    lengths = np.random.default_rng(seed).integers(1100, 1600, 60).tolist()
    first = packing.best_fit([], [], packing._decreasing(list(range(60)), lengths, np.random.default_rng(0), 0.0), lengths, 4096)
    population = []
    for turn in range(3):
        population = packing.evolve(lengths, population, 4096, packing.Evolution(population=8, generations=120), np.random.default_rng(turn))
    assert population[0].rank()[0] < len(first.bins)


def test_packing(spark):
    rows = [(i, "s", words(n, i)) for i, n in enumerate([1, 3, 900, 3000, 20, 250, 5000, 40, 700])] + [(None, "s", None), (3, "s", ""), (3, "s", "")]
    out = packing.pack_documents(frame(spark, rows).repartition(3), capacity=512, plan=packing.Evolution(shard_pieces=8, islands=2, rounds=2)).collect()
    from tokenizers import Tokenizer

    full = Tokenizer.from_str(packing.tokenizer_file())
    want = []
    for i, _, t in rows:
        ids = [*full.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want.append((i, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    key = lambda r: str(r)
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out], key=key) == sorted(want, key=key)
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in out) // 512) + 2
    assert packing.pack_documents(frame(spark, [])).count() == 0


# --- licences ------------------------------------------------------------------------------------------------------------


def wrapped(text, width=9, mark="# "):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + width]) for i in range(0, len(w), width))


def test_licenses(spark):
    mit, gpl = next(t for n, full, t in licenses.TEMPLATES if full and n == "MIT"), next(t for n, _, t in licenses.TEMPLATES if n == "GPL-2.0" and "hope" in t)
    rows = [
        ("/a/LICENSE", "Released under the MIT License."), ("/a/b/c/x.py", "some code of words"), ("/a/b/own.py", words(50) + "\nLicensed under the Apache License, Version 2.0."),
        ("/z/y", "plain"), (None, "plain"), (None, "Released under the MIT License."), ("/a/b/none", None), ("/ab/x", ""), ("/a/b/c/x.py", "some code of words"),
        ("/s/x", "Released under the MIT License."), ("/s/y", "code"), ("/w/x.c", wrapped(gpl) + "\n\nint main()"), ("/w/notes", "Copyright 2020 Somebody\n\n" + wrapped(mit, 12, "")), ("/w/d/z", "code"),
        ("/t/1", "// SPDX-License-Identifier: Apache-2.0\ncode"), ("/t/2", "# SPDX-License-Identifier: GPL-2.0-only"), ("/t/3", "/* SPDX-License-Identifier: MIT */"), ("/t/4", "GNU GENERAL PUBLIC LICENSE"),
        ("/p", "MIT"), ("/p", "code"), ("/p", "The MIT License (MIT)"), ("/long", words(30_000) + "\nReleased under the MIT License.\n" + words(100)),
        ("/t/5", wrapped(licenses.ISC_TEXT, 11, " * ")), ("/t/6", wrapped(licenses.APACHE_HEADER, 8, "// ")), ("/q/COPYING.txt", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n" + words(400)), ("/q/r", "x"),
    ]
    files = spark.createDataFrame([(i, p, t, "x") for i, (p, t) in enumerate(rows)], "k long, path string, text string, license string")
    got = {r.k: r for r in licenses.scan_licenses(files, keys=("k",)).collect()}
    assert [(got[i].license, got[i].inherited_from) for i in range(len(rows))] == [
        ("MIT", None), ("MIT", "/a"), ("Apache-2.0", None), (None, None), (None, None), ("MIT", None), ("MIT", "/a"), (None, None), ("MIT", "/a"),
        ("MIT", None), (None, None), ("GPL-2.0", None), ("MIT", None), ("MIT", "/w"),
        ("Apache-2.0", None), ("GPL-2.0", None), ("MIT", None), ("LicenseRef-GPL", None),
        (None, None), (None, None), ("MIT", None), ("MIT", None),
        ("ISC", None), ("Apache-2.0", None), ("GPL-3.0", None), ("GPL-3.0", "/q"),
    ]
    assert {i for i in got if got[i].licence_file} == {0, 12, 22, 24} and got[2].own_score > 0.99
    assert licenses.scan_licenses(files.where("false"), keys=("k",)).count() == 0
    odd = spark.createDataFrame([(1, "/a/b", "Released under the MIT License.", "y")], ["the.key", "p.ath", "te.xt", "tid"])
    assert [tuple(r) for r in licenses.scan_licenses(odd, "p.ath", "te.xt", ("the.key", "tid")).select("`the.key`", "tid", "license").collect()] == [(1, "y", "MIT")]


def test_only_units_below_the_threshold_are_left_out(spark):
    """Mixtures of templates and other words: whatever reaches a threshold by plain cosines has a telling term and is weighed,
    with the norm that plain Python finds; scores equal plain cosines."""
    rows, idf, unknown = licenses.template_weights()
    vectors = collections.defaultdict(dict)
    for i, _, _, term, weight in rows:
        vectors[i][term] = weight
    rng = random.Random(8)
    texts = []
    for _ in range(400):
        own = rng.choice(licenses.TEMPLATES)[2].split()
        texts.append(" ".join(rng.sample(own, rng.randint(1, len(own))) + words(rng.randint(0, 6), rng.random()).split()))
    texts += ["", "mit", "the the", "of " * 200 + "mit", "license " * 3 + "mit", words(400) + " mit only"]
    best, norms = [], []
    for t in texts:
        q = {w: (1 + math.log(n)) * idf.get(w, unknown) for w, n in collections.Counter(licenses.re.findall(licenses.TERM, t.lower())).items()}
        norm = math.sqrt(sum(x * x for x in q.values())) or 1.0
        norms.append(norm)
        best.append((len(q) > 1) * max(sum(x * v.get(w, 0.0) for w, x in q.items()) * any(w in v and w not in licenses.COMMON for w in q) for v in vectors.values()) / norm)
    telling = set(licenses.telling_terms(0.6, False))
    passed = {i for i, t in enumerate(texts) if telling & set(licenses.re.findall(licenses.TERM, t.lower()))}
    assert {i for i, x in enumerate(best) if x >= 0.6} <= passed and any(x >= 0.6 for x in best) and len(passed) < 400
    units = spark.createDataFrame([(str(i), t, False) for i, t in enumerate(texts)], "tid string, s string, whole boolean")
    weighed = licenses.weigh_units(units, 0.6).cache()
    kept = {int(r.tid): r.norm for r in weighed.collect()}
    assert {i for i, x in enumerate(best) if x >= 0.6} <= set(kept) and len(kept) < len(texts) - 20
    assert all(abs(norms[i] - x) < 1e-9 for i, x in kept.items())
    scores = {int(r.sid): r.score for r in licenses.score_statements(weighed.select(F.col("tid").alias("sid"), "norm", "known")).collect()}
    assert all(abs(scores.get(i, 0.0) - best[i]) < 1e-8 for i in kept)


# --- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rows = [(i, "ab"[i % 2], words(120 + i, i)) for i in range(20)]
    rows += [(30, "a", rows[0][2]), (31, "a", "x " * 400), (32, None, None), (33, "b", "too short")]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame(spark, rows).select(*columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stash(stage(spark, docs, str(tmp_path)))
        seen[name] = docs
        assert name == "packing" or docs.columns == columns
    assert sorted(r.doc_id for r in seen["quality_rules"].collect()) == [*range(20), 30]
    assert {r.doc_id: r.text for r in seen["line_dedup"].collect()}[30] == ""
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"].collect())
    assert sorted(r.doc_id for r in seen["simhash_dedup"].collect()) == [*range(20), 30]
    assert {r.doc_id for r in seen["packing"].collect()} <= {*range(20), 30}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_near_copies_by_shingles(spark):
    """A text with one word changed shares over 0.8 of its five-word shingles, not 61 bits of its SimHash."""
    words = [f"w{i * 7919 % 1000}" for i in range(240)]
    texts = [" ".join(words[:120]), " ".join([*words[:60], "other", *words[61:120]]), " ".join(words[120:])]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() > 3
    assert sorted(r.doc_id for r in simhash.drop_near_copies(frame(spark, [(i, "s", t) for i, t in enumerate(texts)])).collect()) == [0, 2]


def test_near_copies_without_ids(spark):
    texts = [" ".join(f"{c}{i * 31 % 97}" for i in range(40)) for c in "abcd"]
    rows = simhash.drop_near_copies(frame(spark, [(None, "s", texts[0]), (None, "s", texts[1]), (4, "s", texts[2]), (4, "s", texts[3]), (None, "s", texts[2])])).collect()
    assert sorted((r.doc_id is None, r.text) for r in rows) == [(False, texts[2]), (False, texts[3]), (True, texts[0]), (True, texts[1])]
