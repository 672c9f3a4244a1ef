"""Sharding, periodic runs and whitening against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lagwise.llm import whitening
from lagwise.llm.cover import CoverExtensions
from lagwise.llm.periodic_runs import digests, find_runs, joined, periodic_runs
from lagwise.llm.sharding import shard_documents, write_shards
from lagwise.llm.workload import repeated_tail

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, size long, shard int, slot string, runs int, start long"


def texts():
    r = random.Random(5)
    out = [" ".join(r.choice(["a", "bb", "été", "ccc"]) for _ in range(r.randrange(120))) for _ in range(60)]
    out[3:7] = [None, "", " \n\t", "x" * 50_000]  # null, empty, no words, one long word
    out[8] = "lone " * 3000  # one word over and over
    out[9] = " ".join(f"w{i % 700}" for i in range(9000))  # a long period
    out[10] = out[11] = out[12] = "p q r p q r p q r p q r z p q r"
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 7, 1, "s", 2, 3) for i, t in enumerate(texts())]
    rows[20] = (None, *rows[20][1:])
    rows += [rows[10], rows[10], rows[20], (None, None, 7, 1, "s", 2, 3)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_runs(t, least=6, e=4):
    n, out = len(t), {}
    for q in range(1, n // e + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and t[i] == t[i + q]:
                i += 1
            if i > s and i - s + q >= max(least, e * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, q, length) for (s, length), q in out.items())


@pytest.mark.parametrize("least, e", [(6, 4), (2, 2), (5, 3)])
def test_runs_and_extensions_against_plain_loops(least, e):
    rng = np.random.default_rng(least)
    for _ in range(60):
        some = []
        for _ in range(rng.integers(1, 5)):
            n = int(rng.integers(0, 150))
            t = rng.integers(0, rng.integers(1, 4), n)
            if rng.random() < 0.6 and n > 8:  # a tail that repeats
                a = int(rng.integers(0, n))
                at = np.arange(n)
                at[a:] = a + np.arange(n - a) % (1 + (n - a) // int(rng.integers(3, 11)))
                t = rng.integers(0, 50, n)[at]
            some.append(t.astype(np.int64))
        found = find_runs(some, least, e)
        for k, t in enumerate(some):
            assert [(s, q, n) for _, s, n, q in found[found[:, 0] == k].tolist()] == plain_runs(t.tolist(), least, e)
        words, _ = joined(some)
        i, j = rng.integers(0, len(words), (2, 40))
        i, j = i[i != j], j[i != j]
        if len(i):
            for a, b, got in zip(i, j, CoverExtensions(words).common(i, j)):
                m = 0
                while max(a, b) + m < len(words) and words[a + m] == words[b + m]:
                    m += 1
                assert got == m


def test_periodic_runs_query_against_brute_force(docs):
    got = {}
    for r in digests(periodic_runs(docs, alter=repeated_tail)).collect():
        got.setdefault((r.doc_id, r.collapsed_sha256), []).append(r)
    assert sum(map(len, got.values())) == docs.count()
    for doc, text in {(r.doc_id, r.text) for r in docs.collect()}:
        w = WORDS.findall(text or "")
        taken = repeated_tail(doc, len(w))
        w = w if taken is None else [w[k] for k in taken]
        runs = plain_runs(w)
        gone = {k for s, q, n in runs for k in range(s + q, s + n)}
        kept = hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()
        r = got[doc, kept][0]
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, q, n in runs).encode()).hexdigest()
        best = min(((-n, s, q) for s, q, n in runs), default=None)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None,) * 3)
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)


def test_periodic_runs_of_no_rows(spark, docs):
    assert digests(periodic_runs(docs.limit(0))).collect() == []


def size_of(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("shards", [1, 3, 8, 200])
def test_shards_are_contiguous_and_balanced(docs, shards):
    rows = [(r.doc_id, size_of(r.text), zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, *(x or 0 for x in r)))
    total, before, want, heads = sum(r[1] for r in rows), 0, [], {}
    for at, r in enumerate(rows):
        shard = (2 * before + r[1]) * shards // (2 * total)
        want.append((*r, shard, at - heads.setdefault(shard, at)))
        before += r[1]
    out = shard_documents(docs, shards)
    got = [(r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out.collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(r.law, r.grown_shard) for r in out.collect()} == {("bytes", None)}


def test_one_id_for_all_rows_is_spread_and_reruns_agree(spark):
    same = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'abc' as text")
    first, second = (sorted((r.shard, r.slot) for r in shard_documents(same, 4).collect()) for _ in range(2))
    assert first == second == [(s, i) for s in range(4) for i in range(750)]


def test_shards_of_no_rows(docs):
    assert shard_documents(docs.limit(0)).collect() == []


def test_written_shards_hold_the_rows_in_order(spark, docs, tmp_path):
    plain = docs.select("doc_id", "text", "size")
    write_shards(plain, f"{tmp_path}/a", shards=3, files=4)
    back = spark.read.parquet(f"{tmp_path}/a")
    assert back.columns == ["doc_id", "text", "size", "slot", "shard"] and back.count() == docs.count()
    for s in range(3):
        ids = [r.doc_id for r in back.where(f"shard = {s}").orderBy("slot").collect()]
        assert ids == sorted(ids, key=lambda x: (x is None, x or 0))
    write_shards(docs, f"{tmp_path}/b", shards=3)  # its columns clash, so rows stay whole
    assert spark.read.parquet(f"{tmp_path}/b").select("_doc.*").columns == docs.columns


def vector_table(spark, x, extra=()):
    rows = [(i, [float(c) for c in v], 1, 5) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], "vec_id long, embedding array<float>, n long, component int")


def expected(c):
    x = np.floor(64 * np.asarray(c, dtype=np.float32).astype(np.float64))
    x = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(x.T @ x / len(x))
    return x, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("n, d, k", [(300, 20, 32), (400, 70, 32), (500, 60, 5)])
def test_whitening_against_a_full_decomposition(spark, n, d, k):
    rng = np.random.default_rng(d)
    c = rng.standard_normal((n, d)) * rng.uniform(0.5, 1, d)
    c[:, 0] *= 30  # far above the others
    c[1] = c[0]
    bad = [(None, None, 1, 5), (9, [float("nan")] * d, 1, 5), (9, [float("inf")] + [0.0] * (d - 1), 1, 5), (9, [None] + [0.0] * (d - 1), 1, 5), (9, [], 1, 5), (9, [1.0, 2.0], 1, 5)]
    got = whitening.whiten(vector_table(spark, c, bad), k).collect()
    x, values, vectors = expected(c)
    k = min(k, d)
    assert len(got) == n * k and {r.n for r in got} == {n}
    white = np.zeros((n, k))
    for r in got:
        white[r.vec_id, r.component - 1] = r.whitened
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
    want = x @ vectors[:, :k] / np.sqrt(values[:k])
    want *= np.sign((want * white).sum(axis=0))
    assert np.abs(white - want).max() < 1e-8
    assert got[0].identity_error < 1e-10
    whole = np.floor(64 * c.astype(np.float32).astype(np.float64)).astype(np.int64) + whitening.SHIFT
    sums = whole.sum(axis=0)
    for r in got[:200]:
        assert r.deviation == sum((n * int(v) - int(s)) ** 2 for v, s in zip(whole[r.vec_id], sums))


def test_whitening_of_flat_and_flawed_tables(spark):
    assert whitening.whiten(vector_table(spark, [])).collect() == []
    assert whitening.whiten(vector_table(spark, [[1.0, 2.0]] * 5)).collect() == []  # no variance
    assert whitening.whiten(vector_table(spark, [], [(1, None, 1, 5)])).collect() == []
    rank_one = whitening.whiten(vector_table(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).collect()
    assert {r.component for r in rank_one} == {1} and rank_one[0].explained == pytest.approx(1)
    huge = whitening.whiten(vector_table(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 5.0]])).collect()
    assert huge and all(r.deviation is None for r in huge if r.vec_id < 2)


def test_equal_eigenvalues_and_more_near_ones_than_the_block_holds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PATIENCE", 10)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((400, 40)))[0]
    q = q - q.mean(axis=0)
    table = whitening.whole_numbers(vector_table(spark, 2000 * np.linalg.qr(q)[0]), "embedding", "vec_id")
    fit = whitening.fit_whitening(table, 4)
    _, values, _ = expected(2000 * np.linalg.qr(q)[0])
    assert fit.values == pytest.approx(values[:4], rel=1e-9) and fit.identity_error < 1e-9


def test_many_partial_sums_are_added_on_executors(spark):
    c = np.random.default_rng(2).standard_normal((200, 12))
    table = vector_table(spark, c).repartition(40)
    stored = whitening.whole_numbers(table, "embedding", "vec_id")
    sums = [whitening.summed(stored, lambda x: x.sum(axis=0), (12,), "<i8", tasks).tolist() for tasks in (1, 100)]
    assert sums[0] == sums[1]
