"""Each operator against its plain-Python version, with nulls, empties, ties, repeats, very long texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import time
import weakref

import pytest

from skysift.llm import decontaminate, nn_descent, pieces, pii, suffix_dedup, token_counts, warc
from tests.llm import brute
from tests.llm.conftest import rows

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, n_bytes string, block string"


def texts(n: int = 60, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    words = ["the", "ciónos", "Éaux", "ing", "x1", "<|endoftext|>", "</s>", "\n", "  ", "日本", "😀", "don't", "12,5", "▁", "a" * 30]
    passage = " ".join(r.choice(words) for _ in range(40))
    out = []
    for k in range(n):
        t = " ".join(r.choice(words) + r.choice("abcdefghij") for _ in range(r.randrange(0, 60)))
        out.append(t + passage[: r.randrange(0, 200)] + t[:50] if k % 3 == 0 else t)
    out += ["", None, out[0], out[0], passage, passage + " " + passage, "ab" * 120, "z" * 99, "z" * 100, "z" * 101]
    out.append(" ".join(r.choice(words) for _ in range(30_000)))
    return [(i, t, "clash", "clash") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return texts(), spark.createDataFrame(texts(), DOCS).repartition(3)


def test_suffix_dedup(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    data, df = docs
    assert rows(suffix_dedup.remove_repeats(spark, df)) == brute.repeats([d[:2] for d in data])


def test_suffix_dedup_deals_hot_buckets_again(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4000)
    monkeypatch.setattr(suffix_dedup, "HOT", 500)
    data, df = docs
    assert rows(suffix_dedup.remove_repeats(spark, df)) == brute.repeats([d[:2] for d in data])


def test_suffix_dedup_does_not_trust_fingerprints(spark):
    """Two different strings of 100 bytes with one fingerprint: nothing repeats."""
    a, b = colliding_strings(100)
    assert a != b
    got = rows(suffix_dedup.remove_repeats(spark, spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")))
    assert [x[1] for x in got.values()] == [0, 0] and got == brute.repeats([(1, a), (2, b)])


def test_suffix_groups_with_one_name_are_settled_by_bytes():
    import numpy as np

    r = random.Random(4)
    raw = "".join(r.choice("ab") for _ in range(4000)).encode()
    data = np.frombuffer(raw, np.uint8)
    for length in (3, 7, 8, 13):
        at = np.arange(0, len(raw) - length + 1)
        seen, want = set(), []
        for i in at.tolist():
            want.append(raw[i : i + length] in seen)
            seen.add(raw[i : i + length])
        for names in (suffix_dedup.hashes_at, lambda d, p, n: np.zeros(len(p), np.uint64), lambda d, p, n: d[p].astype(np.uint64)):
            assert suffix_dedup.repeated(data, at, length, names).tolist() == want


def test_suffix_dedup_leaves_nothing_behind(spark, docs):
    before = {t.name for t in spark.catalog.listTables()}
    suffix_dedup.remove_repeats(spark, docs[1]).count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_suffix_dedup_orders_any_key(spark):
    from datetime import date

    t = "q" * 150
    pair = [(date(2024, 1, 2), t), (date(2024, 1, 1), t)]
    assert {k: v[1] for k, v in rows(suffix_dedup.remove_repeats(spark, spark.createDataFrame(pair, "doc_id date, text string"))).items()} == {date(2024, 1, 1): 149, date(2024, 1, 2): 150}


def colliding_strings(length: int) -> tuple[str, str]:
    """Strings of ASCII letters whose fingerprints agree, though no byte does in a good part of them.

    The fingerprint is linear in the table's entries modulo 2**64, so a small combination of byte changes that sums to
    zero is found by meeting in the middle over pairs of letters, first in low bits, then in all (Wagner's tree).
    """
    import numpy as np

    from skysift.llm._bytes import BASE, TABLE, U

    r = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)
    power = np.multiply.accumulate(np.concatenate(([U(1)], np.full(length - 1, BASE))))
    while True:
        # eight lists of changes over disjoint stretches of 12 positions; lists are merged on 16, 16 and the last 32 bits
        n = 1 << 17
        lists = []
        for k in range(8):
            at = np.arange(12 * k, 12 * k + 12)
            x, y = letters[r.integers(0, 52, (n, 12))], letters[r.integers(0, 52, (n, 12))]
            lists.append(((x, y), ((TABLE[x] - TABLE[y]) * power[at]).sum(1, dtype=np.uint64)))
        for bits in (16, 32, 64):
            merged = []
            for (p, u), (q, w) in zip(lists[::2], lists[1::2], strict=True):
                mask = U(2**bits - 1)
                want, have = (U(0) - w) & mask, u & mask
                order = np.argsort(have)
                lo, hi = np.searchsorted(have[order], want, "left"), np.searchsorted(have[order], want, "right")
                j = np.repeat(np.arange(len(w)), hi - lo)
                i = order[np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo) + np.arange(len(j))]
                keep = slice(0, 1 << 18)
                i, j = i[keep], j[keep]
                merged.append((tuple(np.hstack((a[i], b[j])) for a, b in zip(p, q, strict=True)), u[i] + w[j]))
            lists = merged
        (x, y), total = lists[0]
        if len(total):
            tail = b"z" * (length - 96)
            return (x[0].tobytes() + tail).decode(), (y[0].tobytes() + tail).decode()


def test_suffix_dedup_many_blocks_at_once():
    import numpy as np

    for length in (12, 30, 60, 100):
        v, residue = suffix_dedup.cover_for(length)
        at = np.flatnonzero(residue)
        assert {(a - b) % v for a in at for b in at} == set(range(v)) and length - v + 1 > 0


def test_suffix_dedup_empty_and_bytes(spark):
    assert suffix_dedup.remove_repeats(spark, spark.createDataFrame([], DOCS)).collect() == []
    pair = [(None, "q" * 150, None, None), (5, "q" * 150, None, None), (5, "r" * 10, None, None)]
    got = suffix_dedup.remove_repeats(spark, spark.createDataFrame(pair, DOCS), with_bytes=True).collect()
    assert sorted((r.doc_id or 0, bytes(r.kept)) for r in got) == [(0, b"q"), (5, b""), (5, b"r" * 10)]


def test_decontamination(spark, docs):
    data, df = docs
    items = [(1, data[3][1]), (2, "the ing"), (10, data[-1][1][:300]), (3, None), (4, "..."), (5, data[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate.contamination(spark, df, bench)) == brute.contamination([d[:2] for d in data], items)
    assert rows(decontaminate.contamination(spark, df, bench, broadcast_bytes=0)) == brute.contamination([d[:2] for d in data], items)
    assert rows(decontaminate.contamination(spark, df, bench.limit(0))) == brute.contamination([d[:2] for d in data], [])
    clean = decontaminate.clean_documents(spark, df, bench)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, x in brute.contamination([d[:2] for d in data], items).items() if not x[-1]}
    assert decontaminate.contamination(spark, df.limit(0), bench).collect() == []
    odd = spark.createDataFrame([(1, items[1][1], 7), (1, items[1][1], 7), (None, items[1][1], 8), (1, "far away", 9), (None, None, 9)], "doc_id long, text string, __row int")
    got = sorted(decontaminate.contamination(spark, odd, bench).collect(), key=str)
    assert [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in got] == [(1, 2, 0, False), (1, 2, 2, True), (1, 2, 2, True), (None, 0, 0, False), (None, 2, 2, True)]
    assert sorted(r["__row"] for r in decontaminate.clean_documents(spark, odd, bench).collect()) == [9, 9]


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    data, df = docs
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = {d[0]: (len((d[1] or "").encode()), n := len(library.encode(d[1] or "", add_special_tokens=False).ids), n > 1024) for d in data}
    assert rows(token_counts.count_tokens(spark, df, path, P.PATTERN)) == want


def test_token_cache_overflows(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_counts, "CACHE_SIZE", 3)
    counter = token_counts.PreTokenCounter(P.path("byte_bpe_50k.json"), P.PATTERN)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for t in ("a bb ccc dddd eeee", "a bb", "ffff gg a", "x" * 500):
        assert counter.count([t, t]) == [len(library.encode(t).ids)] * 2


def test_pieces(spark, docs):
    import sentencepiece

    data, df = docs
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d in data:
        ids = library.encode(d[1] or "", add_eos=True)
        want[d[0]] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert rows(pieces.digests(spark, df, path)) == want
    both = pieces.decode(spark, pieces.encode(spark, df, path), path).collect()
    assert {(r.doc_id, r.decoded_text) for r in both} == {(d[0], library.decode(library.encode(d[1] or ""))) for d in data}


def test_pieces_encode_a_word_once_for_all_its_neighbours(monkeypatch):
    """The cost of a text is that of its new words: not again after other marks, nor in the process's next task of the query."""
    path = P.path("piece_bpe_32k.model")
    made = []
    encode = pieces.Pieces.ids_of
    monkeypatch.setattr(pieces.Pieces, "ids_of", lambda self, chunk: made.append(chunk) or encode(self, chunk))
    for task in range(2):
        with pieces.worker(path, "query") as worker:
            for mark in (",", ".", "%%%", '"', "²."):
                worker.digest(f"a zqunretiouly{mark} zqunretiouly")
        assert made.count("▁zqunretiouly") == (not task)
        made.clear()


def test_pieces_of_an_idle_process_are_dropped(monkeypatch):
    """Caches that stay in Spark's idle Python processes took a later stage of the pipeline over an executor's memory."""
    monkeypatch.setattr(pieces, "IDLE", 0.1)
    with pieces.worker(P.path("piece_bpe_32k.model"), "idle") as worker:
        worker.digest("a b")
    held = weakref.ref(worker)
    del worker
    end = time.monotonic() + 10
    while held() is not None and time.monotonic() < end:
        time.sleep(0.05)
    assert held() is None


def test_pieces_cut_only_where_no_piece_reaches():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model, worker = pieces.Pieces(path), pieces.Worker(path)
    assert model.chunks("ab, c²._d") == [" ab", ",", " c", "²._", "d"]
    assert all(len(model.cut.findall(p)) == 1 for p in model.id)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    chars, some = sorted({c for p in model.id for c in p}), sorted(model.id)
    for n in range(2000):
        t = "".join(r.choice((r.choice(chars), r.choice(some).replace("▁", " "), r.choice([" ", "▁", "²", ".", "\n", "\x00", "😀", "x̄", "1"]))) for _ in range(r.randrange(1, 30)))
        ids = library.encode(t, add_eos=True)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids))]
        assert worker.digest(t) == (len(ids), *sha) and worker.encode(t) == ids[:-1], t
    # letters that some piece joins to a mark are no words; those that meet them aren't either
    model.id = {p: i for i, p in enumerate(["a", "b", "c", ".", "▁", "a.", "ab", "▁c"])}
    assert model.cutter(set("abc.▁")).findall(" ab.c c.b\n") == [" ab.", "c", " c", ".b", "\n"]
    model.id["bc"] = 8
    assert model.cutter(set("abc.▁")).findall(" ab.c c.b\n ") == [" ab.c", " c.b", "\n", " "]


def test_personal_data(spark):
    odd = [
        "mail a.b@c.d and x@y..z @q.r a@b.c.d@e.f", "1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 007.0.0.300", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567 +12 +49.30.1234567 ext",
        "ssn: 123-45-6789 tel 555-867-5309", "é😀 a@b.co", "a" * 5000 + "@", "1." * 4000, "9" * 3000, None, "", "dear Dr. Anna Smith, call 212-555-0199",
    ]
    data = [(i, t, "c", "c") for i, t in enumerate(odd)]
    df = spark.createDataFrame(data, DOCS)
    got, want = rows(pii.report(spark, df)), brute.personal([d[:2] for d in data])
    assert {k: v[:5] for k, v in got.items()} == {k: v[:5] for k, v in want.items()}
    assert all(set(filter(None, want[k][5].split(","))) <= set(got[k][5].split(",")) for k in want)
    red = {r.doc_id: r.text for r in pii.redact(spark, df).collect()}
    assert red[5] == "é😀 <email>" and red[9] is None and red[1].startswith("<ip> 999.1.1.1 <ip>.<ip> ")
    assert pii.report(spark, df.limit(0)).collect() == []
    clash = spark.createDataFrame([(1, "x a@b.co", 5, "p", "q"), (1, "x a@b.co", 6, "p", "q")], "doc_id long, text string, __email int, base string, t string")
    assert sorted(map(tuple, pii.redact(spark, clash).collect())) == [(1, "x <email>", 5, "p", "q"), (1, "x <email>", 6, "p", "q")]


def test_span_classifier_learns_shape():
    good, bad = "-nmhdwyn", "xnmldddy"
    weights = pii.fit_classifier([("ssn", good, 0.97, 40), ("ssn", bad, 0.04, 60), ("iban", bad, 0.1, 5)])
    z = lambda k, s: sum(weights.get(x, 0.0) for x in pii.features(k, s))
    assert z("ssn", good) > 0 > z("ssn", bad) and z("iban", good) > z("iban", bad)


def test_labelers_learn_reliability():
    patterns = [("ssn", "+0+0+", 50), ("ssn", "-0-0-", 50), ("ssn", "+0-0+", 3), ("ssn", "00000", 4)]
    post = pii.fit_labelers(patterns)
    assert post["ssn", "+0+0+"] > 0.9 > 0.1 > post["ssn", "-0-0-"]
    assert pii.fit_labelers([]) == {} and pii.fit_classifier([]) == {}


def test_vectors(spark):
    r = random.Random(2)
    base = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    vectors = [*base, *([x + r.gauss(0, 0.03) for x in base[k % 5]] for k in range(60)), base[0], base[0], [2 * x for x in base[1]]]
    data = [(i, v, 0) for i, v in enumerate(vectors)]
    data += [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] * 16, 0), (203, [None] * 16, 0), (204, [], 0), (205, [1.0, 0.0], 0), (206, [2.0, 0.0], 0), (207, [float("inf")] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    assert rows(nn_descent.near_vectors(spark, df)) == brute.vectors([d[:2] for d in data])
    assert nn_descent.near_vectors(spark, df.limit(0)).collect() == []


def test_archives(spark):
    r = random.Random(3)
    html = ["<p>" + "x" * r.randrange(0, 50) + "é\r\n\r\nWARC/1.1\r\n" for _ in range(12)]
    data = [(i, f"http://h/ {i}\n", r.choice(html)) for i in range(40)] + [(100, None, None), (101, "u", ""), (102, "u", "y" * 300_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    assert rows(warc.round_trip(spark, df)) == brute.pages([(d[0], d[2]) for d in data])
    assert warc.round_trip(spark, df.limit(0)).collect() == []


def test_archives_are_bounded_and_named_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    monkeypatch.setattr(warc, "BROADCAST_BYTES", -1)
    data = [(i, "u", ("same" if i % 3 == 0 else f"{i}") * 100) for i in range(40)] + [(None, "u", "same" * 100), (None, "v", "lone"), (39, "u", "same" * 100), (7, "w", "another")]
    warc.archive_pages(spark, spark.createDataFrame(data, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).collect()
    whole = {r.record_id for r in found if r.record_type == "response"}
    assert all(r.refers_to_id in whole and r.refers_to_page == 39 for r in found if r.record_type == "revisit") and len(found) == len(data)
    assert len({r.record_id for r in found}) == len(data) - 1  # (39, u, same) is there twice
    assert len(list((tmp_path / "w").rglob("part-*"))) >= 4


def test_convert_a_folder_of_archives(spark, tmp_path):
    import gzip

    (tmp_path / "in").mkdir()
    body = b"HTTP/1.0 200 OK\r\n\r\n\xff\xfe bytes"
    records = [warc.ArcRecord("http://a/", "1.2.3.4", "20010203040506", "text/html", body), warc.ArcRecord("dns:x", "0.0.0.0", "2001", "text/dns", b"1.1.1.1")]
    whole = warc.write_arc(records, "n.arc", 2)
    for name, raw in (("a.arc", whole), ("b.arc.gz", gzip.compress(warc.write_arc(records, "n.arc", 1))), ("cut.arc", whole[:-20]), ("none.arc", b"hello")):
        (tmp_path / "in" / name).write_bytes(raw)
    got = {r.source.rsplit("/", 1)[1]: r for r in warc.convert_archives(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert {k: (r.records, r.problem is None) for k, r in got.items()} == {"a.arc": (3, True), "b.arc.gz": (3, True), "cut.arc": (2, False), "none.arc": (0, False)}
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["a.warc.gz", "b.warc.gz", "cut.warc.gz"]
    info, page, dns = list(warc.read_warc((tmp_path / "out" / "a.warc.gz").read_bytes()))
    assert page.body == body and page.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and dns.headers["WARC-Type"] == "resource" and info.headers["WARC-Type"] == "warcinfo"
    back = warc.read_archives(spark, str(tmp_path / "out")).where("url = 'http://a/'").collect()
    assert len(back) == 3 and {r.payload_digest for r in back} == {warc.digest(b"\xff\xfe bytes")}


def test_legacy_archives():
    body = b"HTTP/1.0 200 OK\r\nA: b\r\n\r\npay\nload"
    for version in (1, 2):
        records = [warc.ArcRecord("http://a/b c", "1.2.3.4", "20010203040506", "text/html", body), warc.ArcRecord("dns:x", "0.0.0.0", "2001", "text/dns", b"\n\n1.1.1.1")]
        data = warc.write_arc(records, "n.arc", version)
        head, *got = list(warc.read_arc(data))
        assert head.version == version and [g.body for g in got] == [body, b"\n\n1.1.1.1"] and got[0].url == "http://a/b%20c"
        out = [warc.convert(g, warc.record_id(g.url)) for g in got]
        assert [o.headers["WARC-Type"] for o in out] == ["response", "resource"]
        assert out[0].headers["WARC-Date"] == "2001-02-03T04:05:06Z" and out[1].headers["WARC-Date"] == "2001-01-01T00:00:00Z"
        assert out[0].headers["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"pay\nload")
        again = list(warc.read_warc(b"".join(o.encode() for o in out)))
        assert [a.body for a in again] == [o.body for o in out]
        for cut in (len(data) - 3, 20, data.index(b"pay") + 1):
            with pytest.raises(warc.BadArchive):
                list(warc.read_arc(data[:cut]))
    for bad in (b"no archive", b"filedesc://x 0.0.0.0 20000101000000 text/plain 4\n9 0 \n"):
        with pytest.raises(warc.BadArchive):
            list(warc.read_arc(bad))
