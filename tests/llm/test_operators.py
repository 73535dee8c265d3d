import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import media, packing, pii, sentencepiece, url_filter, warc
from perigee.llm.quality import drop_poor, judge_quality
from perigee.llm import runtime
from perigee.llm.runtime import remove, settle, spread_join, work_dir

ODD = [(1, None), (2, ""), (None, "null id"), (3, "é 😀 " * 50), (3, "é 😀 " * 50), (4, "w" * 200_000), (5, "one two\n three's 12 ²")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in ODD], "doc_id long, text string, payload string, feature string, part int").repartition(3)


# -- media -----------------------------------------------------------------------------------------------------


def test_media_round_trip(odd):
    got = media.media_digests(odd).collect()
    assert len(got) == len(ODD)
    texts = {}
    for i, t in ODD:
        texts[i] = (t or "").encode()
    for r in got:
        b = texts[r.doc_id]
        padded = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        png = media.encode_png(b)
        assert r.media_sha256 == hashlib.sha256(png).hexdigest() and r.media_bytes == len(png) and r.feature == media.feature(padded)


def test_archives_are_zip_files_read_in_ranges(spark, odd, tmp_path):
    import zipfile

    media.write_media(odd, f"file://{tmp_path}/a", range_bytes=100)
    assert media.read_media(spark, f"file://{tmp_path}/a").rdd.getNumPartitions() > 3
    names = [n for p in tmp_path.glob("a/*.zip") for n in zipfile.ZipFile(p).namelist()]
    assert sorted(names) == sorted(f"{i}.png" for i, _ in ODD)
    assert all(zipfile.ZipFile(p).testzip() is None for p in tmp_path.glob("a/*.zip"))


def test_uncommitted_archives_do_not_count(spark, odd, tmp_path):
    media.write_media(odd, f"file://{tmp_path}/a")
    (tmp_path / "a" / "part-9-9-0.zip").write_bytes(b"left behind")
    assert media.read_media(spark, f"file://{tmp_path}/a").count() == len(ODD)


def test_members_are_retried_by_offset(tmp_path):
    fs, root = media.open_dir(f"file://{tmp_path}")
    archive = media._Archive(fs, f"{root}/x.zip", 1 << 20)
    for i in range(3):
        archive.add(b"%d.png" % i, media.encode_png(b"t" * i))
    archive.close()
    reader, calls = media.MediaReader({"path": f"file://{tmp_path}"}), []
    true = reader.member

    def flaky(file, at):
        calls.append(at)
        if len(calls) in (2, 3):
            raise OSError("lost")
        return true(file, at)

    reader.member = flaky
    rows = [r for b in reader.read(media.ByteRange("x.zip", 0, archive.at)) for r in b.to_pylist()]
    assert [r["n_bytes"] for r in rows] == [0, 1, 2] and calls[1] == calls[2] == calls[3] != calls[0]
    data = bytearray((tmp_path / "x.zip").read_bytes())
    data[60] ^= 1
    (tmp_path / "x.zip").write_bytes(bytes(data))
    with pytest.raises(media.MemberError):
        list(media.MediaReader({"path": f"file://{tmp_path}", "retries": "1"}).read(media.ByteRange("x.zip", 0, archive.at)))


# -- WARC --------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/\r\nb", None), (2, None, "x" * 2000), (3, "u", "x" * 2000), (None, "u", "x" * 2000), (3, "u", "x" * 2000), (4, "é", "y" * 999), (5, "é", "y" * 999), (6, "z", "é" * 500), (7, "z", "é" * 500)]


def test_warc_round_trip(spark):
    got = warc.warc_round_trip(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == len(PAGES)
    html = {i: (h or "").encode() for i, _, h in PAGES}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == hashlib.sha1(html[r.page_id]).hexdigest()
        target = {2: 3, None: 3, 6: 7}.get(r.page_id)
        assert (r.record_type, r.refers_to) == (("revisit", target) if target else ("response", None))


def test_warc_filters_are_pushed_and_payloads_skipped(spark, monkeypatch):
    path = work_dir(spark, "warc-test")
    warc.write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), path)
    read = warc.read_warc(spark, path)
    assert read.where("warc_type = 'revisit'").count() == 3
    assert read.where("payload_bytes >= 1000 AND warc_type = 'response'").select("page_id").distinct().count() == 2
    plan = read.where("warc_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan.replace("RuntimeFilters", "")
    decoded = []
    monkeypatch.setattr(warc.WarcReader, "body", staticmethod(lambda block: decoded.append(1)))
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("page_id",), 6)])) == []
    assert [r["page_id"] for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()] == [6] and not decoded
    assert warc.read_warc(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    remove(spark, path)


@pytest.mark.parametrize("f,schema", [(media.media_digests, "doc_id long, text string"), (warc.warc_round_trip, "page_id long, url string, html string"), (packing.pack, "doc_id long, text string"), (pii.find_pii, "doc_id long, text string"), (pii.redact, "doc_id long, text string"), (sentencepiece.encode_and_check, "doc_id long, text string"), (url_filter.judge_urls, "page_id long, url string")])
def test_empty_tables(spark, f, schema):
    assert f(spark.createDataFrame([], schema)).count() == 0


# -- personal data -------------------------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def slow_base(text):
    out = []
    for k, (_, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn, 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(out))


TEXTS = ["", None, "a@b.c.+x@y.z", "1.2.3.4.5.6.7.8 999.1.1.1", "4111 1111 1111 1111", "x" * 30_000, "1" * 30_000, "a.b@c" * 500, "é 😀 +1 (234) 567-8901, 10.0.0.1", "+1234567890123456789 +12345 6789", "12-34" * 30 + "@a.b", "0000255.1.1.1", "a@b.c@d.e", "1.2.3.4@a.b +1 2.3.4.5 6789"]


def test_base_spans(spark):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab1.2@+ -()é:4") for _ in range(rng.randrange(200))) for _ in range(300)]
    got = {r.doc_id: r for r in pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        expected = slow_base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(expected.encode()).hexdigest(), t
        assert set(filter(None, expected.split(","))) <= set(filter(None, got[i].spans.split(",")))
        assert sum((got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone)) == len(list(filter(None, expected.split(","))))


def test_native_plan_has_no_python(spark):
    d = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    for frame in (pii.find_pii(d), pii.redact(d)):
        assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_redaction(spark):
    rows = [(1, "write a@b.cd or +1 (234) 567-8901.", "k"), (2, None, None), (3, "nothing", "k")]
    got = {r.doc_id: r for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string, _x string")).collect()}
    assert got[1].text == "write [EMAIL] or [PHONE]." and got[2].text is None and got[3].text == "nothing" and got[1]._x == "k"


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 2**19, 4000))
    good = (codes >> 5 & 1) == 1
    hits, misses = np.where(good, 20, 0), np.where(good, 0, 20)
    model = pii.boost(codes, hits, misses, np.arange(len(codes)) % 2 == 0)
    assert np.isfinite(model.thresholds).all() and len(model.trees) > 0
    none = pii.boost(codes, 0 * hits, hits + misses, np.arange(len(codes)) % 2 == 0)
    assert np.isinf(none.thresholds).all()
    assert np.isinf(pii.boost(codes[:0], hits[:0], misses[:0], np.zeros(0, bool)).thresholds).all()


# -- packing -------------------------------------------------------------------------------------------------------


def test_packing(spark, odd, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    texts = [(r[0], r[1] or "") for r in docs.collect()]
    got = packing.pack(docs).collect()
    expected = []
    for i, t in texts:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        expected += [(i, p, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for p, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= sum(r.length for r in got) / 4096 * 1.05 + 2


@pytest.mark.parametrize("capacity", [1, 7, 64, 500])
def test_plans_place_every_piece_once(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(20):
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < 0.3)
        slots = packing.plan(counts, capacity)
        fill, seen = {}, set()
        for n in range(1, capacity + 1):
            own = slots[slots[:, 0] == n]
            for rank in range(counts[n]):
                s = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
                i = rank - s[1]
                sequence, offset = s[3] + i // s[2], s[4] + i % s[2] * n
                assert (sequence, offset) not in seen
                seen.add((sequence, offset))
                fill.setdefault(sequence, []).append((offset, n))
        for parts in fill.values():
            assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sum(n for _, n in parts) <= capacity


def test_exact_complements_are_used():
    counts = np.zeros(101, np.int64)
    counts[[60, 25, 15]] = 5
    counts[[50]] = 4
    slots = packing.plan(counts, 100)
    assert slots[:, 3].max() + 1 <= 7


@pytest.mark.parametrize("text", ["it's we've O'Neil !!'s ''s x'", "ÀÉÎ ßſ ŸŶ", "12 ³½ a1b2", "tab\tnew\nline\r\x0b", "<|endoftext|> x", "日本 한국 עברית", "İstanbul Ω", "a\u0301 ﬁ", "price–5€ … “q”", "nbsp\xa0x\x85y"])
def test_word_tokens_equal_the_tokenizer(text):
    encode = packing._tokens(packing.default_tokenizer())
    assert encode(text) == np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_words_of_few_texts_are_held_at_once():
    import tracemalloc

    encode, text = packing._tokens(packing.default_tokenizer()), "some plain words of a text, more of them. " * 500
    expected = encode(text)
    tracemalloc.start()
    got = encode.many([text] * 300)  # 6 million characters, 1.6 million words and marks
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [expected] * 300 and peak < 3 * 300 * len(expected), peak  # three times what is returned


# -- SentencePiece ---------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark, odd, sf):
    import sentencepiece as library

    reference = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    rng = random.Random(1)
    texts = ["", "a", "  a  b\nc ", "x" * 500, "日本語 😀 é́ ﬁ z", "▁▁a", "\t\0b", " " * 300, "aaaa bbbb" * 200, "ab" * 100 + " " + "the" * 80]
    texts += ["".join(rng.choice("ab the éxyz\n0.▁漢") for _ in range(rng.randint(1, 200))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(100).collect()]
    model = sentencepiece.piece_model(sentencepiece.default_model())
    got = model.encode_batch(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == reference.encode(texts)
    assert [model.decode(x) for x in got] == [t.replace("▁", " ") for t in texts]
    table = sentencepiece.encode(odd)
    back = {r.doc_id: r.text for r in sentencepiece.decode(table).collect()}
    assert back == {i: t or "" for i, t in ODD}
    checked = sentencepiece.encode_and_check(odd)
    assert checked.where("round_trip").count() == len(ODD)


def test_long_units_are_cut_where_no_piece_reaches():
    """Texts without spaces: a border in every few characters, and the library's identifiers all the same."""
    import base64

    import sentencepiece as library

    reference = library.SentencePieceProcessor(model_file=sentencepiece.default_model())
    model, rng = sentencepiece.PieceModel(sentencepiece.default_model()), random.Random(3)
    kana = "".join(rng.choice("日本語のテキストは空白なしで続くことが多い漢字é") for _ in range(60_000))
    coded = base64.b64encode(rng.randbytes(150_000)).decode()
    latin = "".join(rng.choice("the ing tion er".replace(" ", "")) for _ in range(20_000))
    texts = [kana, coded, latin, "a " + coded + " b", "x" * 3000]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode_batch(texts)] == reference.encode(texts)
    assert max(map(len, model.parts(kana))) < 200 and max(map(len, model.parts(coded))) < 2000
    assert "".join(model.parts(latin)) == latin


def test_a_very_long_text_takes_little_memory(monkeypatch):
    import resource

    monkeypatch.setattr(sentencepiece, "BLOCK_CHARS", 1 << 16)
    model, rng = sentencepiece.PieceModel(sentencepiece.default_model()), random.Random(4)
    kana = "".join(rng.choice("日本語のテキストは空白なしで続くことが多い漢字é") for _ in range(2_000_000))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    ids = model.encode_batch(["short", kana])
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert model.decode(ids[1]) == kana and grown < 250  # MB


def test_suffix_array_to_a_depth():
    codes = np.random.default_rng(0).integers(0, 3, 300)
    order = sentencepiece.suffix_array(codes, 16)
    parts = [codes[i : i + 16].tolist() for i in order]
    assert parts == sorted(parts)


@pytest.mark.parametrize("letters,depth,sorts", [(100, 16, 2), (2, 16, 1), (100_000, 16, 4), (100, 5, 1), (1, 3, 1)])
def test_suffix_array_takes_few_sorts(monkeypatch, letters, depth, sorts):
    codes = np.random.default_rng(3).integers(0, letters, 500)
    codes[::50] = -2
    codes[300:360] = codes[100:160]
    calls, real = [], np.argsort
    monkeypatch.setattr(sentencepiece.np, "argsort", lambda *a, **b: calls.append(1) or real(*a, **b))
    got = sentencepiece.suffix_array(codes, depth).tolist()
    whole = 1 << (depth - 1).bit_length()  # doubled lengths reach as far
    assert got == sorted(range(500), key=lambda i: codes[i : i + whole].tolist()) and len(calls) <= sorts
    assert sentencepiece.suffix_array(codes[:0], depth).size == 0


# -- quality -----------------------------------------------------------------------------------------------------------


def test_quality_separates_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = judge_quality(d, known).join(held, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in judged}
    assert kept[1] > 0.97 and kept[0] < 0.2
    assert drop_poor(d, labels).columns == d.columns


def test_quality_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    rows = spark.createDataFrame([(1, None, None, None, 1.0), (1, "", "a", "b", 2.0), (None, "x " * 10, "a", None, 3.0), (2, "y" * 100_000, "a", "b", 4.0)], "doc_id long, text string, source string, lang string, p double")
    got = judge_quality(rows, labels).collect()
    assert len(got) == 4 and all(r.keep for r in got) and all(0 <= r.score <= 1 for r in got)
    assert judge_quality(rows.limit(0), labels).count() == 0 and drop_poor(rows, labels.limit(0)).count() == 4


# -- URLs ----------------------------------------------------------------------------------------------------------------


def slow_judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and (slash + path).startswith(r.path)]
    return host, slash + path, max(fit, key=lambda r: len(r.name), default=None)


URLS = [None, "", "no scheme", "http://x.com", "HTTP://X.Com/En/", "http://example.com/en/1", "https://www.example.com/en/1?x=/", "http://a.net/es/2#f", "http://net/fr/", "http://a.net/fr", "http://x?y/z", "http://h#/p", "ftp://É.com/é", "http://a://b/c", "://com/"]


def test_rules_and_parts(spark, sf):
    urls = URLS + [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    for i, u in enumerate(urls):
        host, path, rule = slow_judge(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.name if rule else None), u
        if rule:
            assert got[i].verdict == rule.verdict


def test_impure_templates_are_rejected(spark):
    rows = [(i, f"http://shop.xy/item/{i}") for i in range(60)] + [(100 + i, f"http://shop.xy/blog/post-{i:04d}") for i in range(60)] + [(300, None)]
    labels = [(i, 1) for i in range(0, 60, 2)] + [(100 + i, 0) for i in range(0, 60, 2)] + [(5, None)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=(), labels=spark.createDataFrame(labels, "page_id long, bad int")).collect()}
    assert len(got) == len(rows) and got[1].template == "/item/{n}" and got[101].template == "/blog/{slug}"
    assert all(got[i].verdict == "block" for i in range(60)) and all(got[100 + i].verdict == "allow" for i in range(60)) and got[300].verdict == "allow"


def test_many_values_become_a_wildcard(spark):
    words = ["".join(random.Random(i).choices("abcdefgh", k=9)) for i in range(200)]
    got = url_filter.judge_urls(spark.createDataFrame([(i, f"http://h.xy/u/{w}/about") for i, w in enumerate(words)], "page_id long, url string"), rules=()).select("template").distinct().collect()
    assert [r.template for r in got] == ["/u/*/about"]


@pytest.mark.parametrize("most", [0, 200_000])
def test_join_with_a_hot_key(spark, monkeypatch, most):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", most)
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.lit(7)).when(F.col("id") % 2 > 0, F.col("id")).alias("k"), "id")
    lookup = settle(spark.createDataFrame([(7, "x"), (9, "y")], "k long, v string"))
    out = spread_join(rows, lookup, "k", ["id"])
    assert out.columns == ["k", "id", "v"] and out.count() == 1000 and out.where("v = 'x'").count() == rows.where("k = 7").count() and out.where("v = 'y'").count() == 1
    assert spread_join(rows, lookup, "k", ["id"], "inner").count() == rows.where("k IN (7, 9)").count()
    if not most:
        hot = runtime.hot_keys(rows.where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n")), "k", 4).collect()
        assert [(r["_hot"], r["_copies"]) for r in hot] == [(7, 11)]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        get = staticmethod(lambda name: None)

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: Conf)

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        class O:
                            isEmpty = staticmethod(lambda: True)

                        return O

                return S

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context}))
