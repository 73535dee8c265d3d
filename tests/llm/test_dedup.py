import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import induced
from perigee.llm.components import components
from perigee.llm.exact_dedup import drop_exact, exact_dedup
from perigee.llm.simhash import drop_near, fingerprint, links, simhash_components
from perigee.llm.substring_dedup import drop_repeats, repeat_digests

DOCS = "doc_id long, text string, lang string, at string, _salt int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a b c", "en", "x", 0), (2, "a b c", None, "y", 1), (3, None, "en", "z", 2), (4, "", "en", "z", 2), (None, "a b c", "en", "q", 3), (5, "other", "en", "q", 3), (5, "other", "en", "q", 3), (6, "x " * 40_000, "en", "q", 4)]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_dedup(docs, digest_bytes):
    got = {(r.doc_id, r.kept): r for r in exact_dedup(docs, digest_bytes=digest_bytes).collect()}
    assert len(got) == 8
    assert got[2, True].group_size == 3 and got[2, True].keep_id == 2 and got[None, False].keep_id == 2
    assert got[4, True].keep_id == 4 and got[3, False].keep_id == 4  # null counts as empty
    assert got[5, True].group_size == 2 and got[5, False].group_size == 2  # one of two equal rows stays
    assert got[6, True].text_sha256 == hashlib.sha256(("x " * 40_000).encode()).hexdigest()


def test_exact_dedup_with_colliding_digests(spark):
    rows = [(i, f"text {i % 400}") for i in range(1000)]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), digest_bytes=1).collect()
    keep = {}
    for i, t in rows:
        keep[t] = max(i, keep.get(t, -1))
    assert all(r.keep_id == keep[f"text {r.doc_id % 400}"] and r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_in_several_micro_batches(docs):
    assert exact_dedup(docs.repartition(6), batch_bytes=1).where("kept").count() == 4


def test_exact_dedup_keeps_no_threads_for_checksums(docs, spark):
    assert drop_exact(docs).count() == 4
    names = [t.getName() for t in spark._jvm.java.lang.Thread.getAllStackTraces().keySet()]  # stores stay for a while after the stream's end
    assert not [x for x in names if "hecksum" in x]


def test_drop_exact_keeps_columns_and_one_of_each(docs, spark, tmp_path):
    out = drop_exact(docs)
    assert out.columns == docs.columns and out.count() == 4
    docs.write.parquet(f"{tmp_path}/d")
    assert drop_exact(spark.read.parquet(f"{tmp_path}/d")).count() == 4


@pytest.mark.parametrize("f", [exact_dedup, simhash_components, drop_exact, drop_near, repeat_digests])
def test_empty_tables(docs, f):
    assert f(docs.limit(0)).count() == 0


def slow_fingerprint(text):
    import xxhash

    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "One two", "one TWO three", "É é x y z " * 9, "a b c d e f g " * 30])
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def brute_components(values, radius=2):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("dense", [64, 1, 3])
def test_links_connect_what_pairs_connect(spark, dense):
    rng = random.Random(1)
    values = {0, 2**63, 2**64 - 1}
    for _ in range(30):
        v = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            values.add(v)
            v ^= 1 << rng.randrange(64)
            if rng.random() < 0.3:
                v ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    values = sorted(values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    found = {r.a: r.b for r in components(links(spark.createDataFrame([(v,) for v in signed], "fp long"), dense)).collect()}
    mine = [found.get(v, v) for v in signed]
    groups = brute_components(values)
    assert len(set(zip(mine, groups))) == len(set(mine)) == len(set(groups))


def test_components_of_long_chains_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[1000 + i] == 1000 for i in range(1, 50))


def test_simhash_components(docs):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(docs).collect()]
    assert len(got) == 8
    by = {i: (f, c) for i, f, c in got}
    assert by[1] == by[2] == by[None] and by[1][1] == 1 and by[3][0] == by[4][0] == "0" * 16 and by[4][1] == 3
    assert drop_near(docs).count() == 4 and drop_near(docs).columns == docs.columns


def brute_repeats(rows, length=50):
    first, big = {}, 2**63 - 1
    data = [(i, (x or "").encode()) for i, x in rows]
    for i, b in data:
        d = big if i is None else i
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            first[w] = min(first.get(w, d), d)
    out = []
    for i, b in data:
        gone, d = np.zeros(len(b), bool), big if i is None else i
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < d:
                gone[k : k + length] = True
        edges = np.diff(np.r_[0, gone.astype(int), 0])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append(str((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.mark.parametrize("options", [{}, {"hot_runs": 3}, {"held_keys": 50, "held_runs": 20}, {"chunk": 64, "ranges": 3, "memory": 1000}])
def test_substring_dedup(spark, options):
    rng = random.Random(2)
    rows = [(1, None), (2, ""), (None, "q" * 200), (3, "q" * 120), (3, "q" * 70), (4, "ab" * 100), (5, "x" * 49), (6, "x" * 50), (7, "x" * 50)]
    base = "".join(rng.choice("abc") for _ in range(2000))
    for i in range(40):
        a = rng.randrange(1900)
        rows.append((rng.choice([10 + i, 10, None]), base[a : a + rng.randint(30, 300)] + rng.choice(["é" * 60, "zz", ""]) + base[rng.randrange(1500) :][: rng.randint(40, 90)]))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(str(tuple(r)) for r in repeat_digests(table, **options).collect()) == brute_repeats(rows)


def test_kept_bytes_are_returned(spark):
    rows = [(1, "k" * 60), (2, "head " + "k" * 60 + " tail")]
    got = {r.doc_id: bytes(r.kept) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: b"k" * 60, 2: b"head  tail"}


@pytest.mark.parametrize("block,per_range,limit", [(1 << 18, 1 << 13, 256 << 20), (16, 1, 200), (3, 8, 0), (64, 2, 5000)])
def test_induced_order_and_prefixes(monkeypatch, block, per_range, limit):
    monkeypatch.setattr(induced, "BLOCK", block)
    monkeypatch.setattr(induced, "RANGE", per_range)
    rng = np.random.default_rng(0)
    for trial in range(60):
        a = int(rng.integers(1, 6))
        t = rng.integers(1, a + 1, int(rng.integers(1, 300)))
        t = np.r_[np.tile(t[: max(1, len(t) // 7)], 7) if trial % 3 == 0 else t, 0]
        cap = int(rng.integers(1, 60))
        order, lcp = induced.sort_suffixes(t, a + 1, cap, limit)
        assert sorted(order.tolist()) == list(range(len(t)))
        for i in range(1, len(order)):
            x, y = t[order[i - 1] :][:cap].tolist(), t[order[i] :][:cap].tolist()
            same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert x <= y and lcp[i] == same


def test_a_shard_larger_than_memory_spills_and_recurses(monkeypatch):
    """A shard of 400 KB with 64 KB of memory: it goes to files, its reduced text is sorted by induction again, and removals are right."""
    import tracemalloc

    from perigee.llm import substring_dedup as sd

    monkeypatch.setattr(induced, "BLOCK", 1 << 12)
    monkeypatch.setattr(induced, "RANGE", 1 << 11)
    monkeypatch.setattr(sd, "BLOCK", 1 << 12)
    depth, deepest, true = [0], [0], induced._reduced_order

    def counted(*args):
        depth[0] += 1
        deepest[0] = max(deepest[0], depth[0])
        try:
            return true(*args)
        finally:
            depth[0] -= 1

    monkeypatch.setattr(induced, "_reduced_order", counted)
    rng = np.random.default_rng(4)
    shard = sd._Shard(sd.Options(memory=64 << 10))
    pool, rows, total = rng.integers(97, 101, 4000, dtype=np.uint8).tobytes(), [], 0
    for task in range(20):
        runs = []
        for k in range(120):
            i = int(rng.integers(0, 3900))
            runs.append(pool[i : i + 50 + int(rng.integers(0, 50))] if k % 3 == 0 else rng.integers(97, 123, 50 + int(rng.integers(0, 300)), dtype=np.uint8).tobytes())
        runs = list(dict.fromkeys(runs))
        low = rng.integers(0, 1000, len(runs))
        rows += [(task, k, int(x), r) for k, (x, r) in enumerate(zip(low, runs))]
        total += sum(map(len, runs))
        places = np.array([[k, 0] for k in range(len(runs))], np.int64)
        shard.add(task, sd._pack((b"".join(runs), np.array([len(r) for r in runs], np.int32), np.zeros(len(runs), np.uint32), low.astype(np.int64), np.ones(len(runs), np.int32), places)))
    sd._row(0, 0, 0, None).to_pandas()  # what this imports doesn't count
    tracemalloc.start()
    out = list(shard.decide())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = [(t, tuple(x)) for b in out for t, blob in zip(b.column("task").to_pylist(), b.column("blob").to_pylist()) for x in sd._unpack(blob).tolist()]
    assert total > 300_000 and shard.scratch.written > 10 * total and deepest[0] > 1 and peak < 6 * total
    shard.scratch.close()
    first = {}
    for _, _, d, r in rows:
        for k in range(len(r) - 49):
            first[r[k : k + 50]] = min(d, first.get(r[k : k + 50], d))
    gone = {}
    for t, (row, a, b) in got:
        gone.setdefault((t, row), set()).update(range(a, b))
    for t, k, d, r in rows:
        want = {j for i in range(len(r) - 49) if first[r[i : i + 50]] < d for j in range(i, i + 50)}
        assert gone.get((t, k), set()) == want


def test_whole_small_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in repeat_digests(d).collect()) == brute_repeats(rows)
    got = {r.doc_id: r for r in simhash_components(d).collect()}
    values = [slow_fingerprint(t or "") for _, t in rows]
    groups = brute_components(values)
    least = {g: min(i for (i, _), h in zip(rows, groups) if h == g) for g in set(groups)}
    assert all(got[i].fingerprint == f"{v:016x}" and got[i].component_id == least[g] for (i, _), v, g in zip(rows, values, groups))
    assert exact_dedup(d).where("kept").count() == d.select(F.coalesce("text", F.lit(""))).distinct().count()


def shingles(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("dense", [48, 1])
def test_near_copies(spark, dense):
    from perigee.llm.near_copies import drop_near_copies

    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows, groups = [(None, "tiny"), (900, None), (901, "")], []
    for g in range(25):
        base = [word() for _ in range(rng.randint(60, 400))]
        texts = [" ".join(base)]
        for _ in range(rng.choice([0, 1, 3])):
            copy = list(base)
            for _ in range(max(1, len(base) // 120)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        far = list(base)
        for i in range(0, len(far), 6):
            far[i] = word()
        ids = rng.sample(range(g * 20, g * 20 + 20), len(texts) + 1)
        rows += list(zip(ids, [*texts, " ".join(far)]))
        groups.append((texts, ids[:-1], ids[-1]))
    table = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, fp long").repartition(4)
    out = drop_near_copies(table, dense=dense)
    kept = {r.doc_id for r in out.collect()}
    assert out.columns == table.columns
    for texts, ids, far in groups:
        assert far in kept
        a = shingles(texts[0])
        if all(len(a & shingles(t)) >= 0.8 * len(a | shingles(t)) for t in texts[1:]):
            assert min(ids) in kept and not kept & (set(ids) - {min(ids)})
    assert None in kept and 900 in kept and 901 not in kept


@pytest.mark.parametrize("block", [7, 256])
def test_near_copies_in_a_crowded_key(spark, monkeypatch, block):
    from perigee.llm import near_copies

    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    common, texts = [word() for _ in range(60)], []
    for g in range(30):
        own = [word() for _ in range(40)]
        texts += [" ".join(common + own), " ".join(common + own[:-3] + [word() for _ in range(3)])]
    rng.shuffle(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_at long, text string").repartition(4)
    sets = [shingles(t) for t in texts]
    sketch = spark.createDataFrame([(i, i, 0, len(s), [1, 2]) for i, s in enumerate(sets)], "uid long, _at long, fp5 long, n long, keys array<long>")
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in near_copies.similar_links(rows, sketch, "text", dense=8).collect()}
    assert len(want) == 30 and got == want


def test_near_copies_in_hot_groups_equal_brute_force(spark):
    """One large group of near copies of all degrees, and many documents that share a passage: recall and precision are one."""
    from perigee.llm.near_copies import drop_near_copies

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    base, passage, texts = [word() for _ in range(150)], [word() for _ in range(70)], []
    for _ in range(170):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for _ in range(60):
        own = [word() for _ in range(rng.randrange(10, 60))]
        texts.append(" ".join(passage + own))
        if rng.random() < 0.5:
            own[-1] = word()
            texts.append(" ".join(passage + own))
    ids = rng.sample(range(10_000), len(texts))
    sets, prints = [shingles(t) for t in texts], [slow_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    table = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in drop_near_copies(table).collect()}
    assert len(least) < 0.6 * len(texts) and kept == set(least.values())


def test_doubling_sorts_once_a_round(monkeypatch):
    names = np.random.default_rng(2).integers(1, 4, 2000).astype(np.int32)
    names[1000:] = names[:1000]
    calls, real = [], np.argsort
    monkeypatch.setattr(induced.np, "argsort", lambda *a, **b: calls.append(1) or real(*a, **b))
    order, ranks = induced._doubled(names, 25)
    assert len(calls) == len(ranks) - 1
    assert [names[i : i + 32].tolist() for i in order] == sorted(names[i : i + 32].tolist() for i in range(2000))


def test_the_first_induction_gives_only_suffixes_smaller_than_the_next(monkeypatch):
    text = np.append(np.random.default_rng(4).integers(1, 5, 3000), 0).astype(np.int16)
    seen, real = [], induced._induce

    def watched(text, seeds, lcp, alphabet, cap, scratch):
        for at, common in real(text, seeds, lcp, alphabet, cap, scratch):
            seen.extend([] if cap else at.tolist())
            yield at, common

    monkeypatch.setattr(induced, "_induce", watched)
    places, _ = induced.sort_suffixes(text, 5, 50)
    whole = text.tolist()
    assert [whole[i : i + 50] for i in places] == sorted(whole[i : i + 50] for i in range(len(whole)))
    assert sorted(seen) == [i for i in range(len(whole)) if whole[i:] < whole[i + 1 :] or i == len(whole) - 1]
