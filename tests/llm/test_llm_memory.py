"""What tasks hold at once is bounded, and pairs are judged many at a time as they are one by one."""

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import lines as LN
from brindle.llm import simhash
from brindle.llm.common import map_batches, stash


def test_python_gets_stored_rows_in_small_batches(spark):
    """Rows of 100 kB do not come to Python by the thousand, and the session's setting is as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    wide = spark.range(0, 400, 1, 1).selectExpr("repeat(concat('line', id), 20000) AS text")
    sizes = stash(map_batches(wide, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long"))
    assert sizes.agg({"n": "max"}).first()[0] < 16 << 20 and spark.conf.get(name) == before


def test_rows_have_room_for_their_parities_only():
    assert LN.ROW.itemsize == 80 and LN.row_type(simhash.LIMITS).itemsize == 32
    marks = LN.parities(np.arange(1, 100, dtype=np.uint64), np.zeros(1, np.int64), np.array([99]), simhash.LIMITS)
    rows = LN.feature_rows(np.arange(5, dtype=np.uint64), 0, np.ones(5, np.uint64), np.full(5, 99), False, np.repeat(marks, 5, axis=0), simhash.LIMITS)
    assert (LN.unpack_rows(LN.pack_rows(rows, simhash.LIMITS), simhash.LIMITS) == rows).all()


def edited(rng, n, share):
    line = [b"w%d" % x for x in (300 * rng.random(n) ** 2).astype(int)]
    new = list(line)
    for _ in range(int(share * n)):
        at = int(rng.integers(0, len(new)))
        new[at : at + int(rng.integers(0, 2))] = [b"w%d" % x for x in rng.integers(0, 300, int(rng.integers(0, 2)))]
    return line, new or [b"w"]


@pytest.mark.parametrize("few", [0, 8])
def test_many_pairs_are_judged_as_one(monkeypatch, few):
    monkeypatch.setattr(LN, "FEW", few)
    rng = np.random.default_rng(few)
    pairs = [edited(rng, int(n), share) for n in (*rng.integers(1, 140, 150), 64, 65, 128, 129, 257, 400, 520, 700) for share in (0, 0.15, 0.25, 0.4, 0.9)]
    pairs += [(y, x[::-1]) for x, y in pairs[::7]]
    judge = LN.Judge(pa.array([b" ".join(x) for x, _ in pairs] + [b" ".join(y) for _, y in pairs], pa.binary()), 0.8)
    n = np.arange(len(pairs))
    want = [LN.edit_similarity(x, y) >= 0.8 - 1e-9 for x, y in pairs]
    assert judge(n, n + len(n)).tolist() == want and 100 < sum(want) < len(want) - 100
    found = LN.distances(judge.words, *(z[m] for m in [judge.sizes[n] <= judge.sizes[n + len(n)]] for z in (judge.starts[n], judge.sizes[n], judge.starts[n + len(n)], judge.sizes[n + len(n)])))
    assert found.tolist() == [LN.levenshtein(x, y) for x, y in pairs if len(x) <= len(y)]


def test_forests_of_groups_connect_what_all_pairs_do():
    rng = np.random.default_rng(4)
    groups, want = [], set()
    for g in range(12):
        lines = [b" ".join(x) for _ in range(4) for x in edited(rng, 30, 0.1) + edited(rng, 40, 0.2)]
        keys = np.arange(len(lines)) + 1000 * g
        groups.append((keys, np.array(lines, object)))
        want |= {(int(keys[i]), int(keys[j])) for i in range(len(lines)) for j in range(i) if LN.are_alike(lines[i].split(), lines[j].split(), 0.8)}
    differ = lambda n, m: 2 * LN.edits(np.maximum(n, m), 0.8) - np.abs(n - m)
    links = list(LN.forest(groups, LN._word_hashes, lambda x: LN.Judge(x, 0.8), 0.8, differ))
    from brindle.operators.components import smallest_reachable

    assert want and smallest_reachable(links) == smallest_reachable(want) and all(a // 1000 == b // 1000 for a, b in links)


def test_texts_that_share_a_common_passage_do_not_meet(spark, monkeypatch):
    """Long texts of their own with one passage in common are no candidates, so none of their contents move; near copies are."""
    passage = " ".join(f"common{i}" for i in range(60))
    texts = [" ".join(f"word{k}x{i}" for i in range(200)) + " " + passage for k in range(300)]
    texts.append(texts[0] + " and more")
    found = []
    monkeypatch.setattr(simhash, "needed_keys", lambda rows: found.append(rows.select("a", "b", "dense").collect()) or LN.needed_keys(rows))
    links = simhash.shingle_links(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), "text", 5, 0.8).collect()
    pair = {x - (1 << 64) if x >> 63 else x for x in (simhash.fingerprint(t, 5) for t in (texts[0], texts[-1]))}
    assert [set(r) for r in links] == [pair]
    assert [({r.a, r.b}, r.dense) for r in found[0]] == [(pair, False)]


def test_groups_of_many_bytes_are_compared_by_blocks(spark, monkeypatch):
    """Blocks are bounded by bytes, too, and lose no link of a group of near copies."""
    base = [f"word{i}" for i in range(300)]
    texts = [" ".join([*base[:i], f"new{i}", f"other{i}", *base[i + 1 :]]) for i in range(0, 300, 10)]
    stored = []
    monkeypatch.setattr(LN, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(LN, "stash", lambda rows: stored.append(rows) or stash(rows))
    links = simhash.shingle_links(spark.createDataFrame([(t,) for t in texts], "text string"), "text", 5, 0.8, per_text=0).collect()
    part = {x: x for x in {y for r in links for y in r}}
    for a, b in links:
        old = part[a]
        part = {x: part[b] if r == old else r for x, r in part.items()}
    assert len(part) == len({simhash.fingerprint(t, 5) for t in texts}) > 20 and len(set(part.values())) == 1
    plan = stored[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "20000" in plan
