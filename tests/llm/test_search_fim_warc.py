"""Ranked search, fill-in-the-middle and archives against plain versions on small rows."""

import base64
import hashlib
import math
import random
import re
import struct
from collections import Counter

import pytest

pytest.importorskip("docgraph.llm")
import zstandard  # noqa: E402

from docgraph.llm import fim, reversed_search, warc  # noqa: E402

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score double, n long, item_id long, terms string, h1 string, form string"
ITEMS = "item_id long, text string, doc_id long, score long"


def texts(n=80):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdeéÉ日") for _ in range(r.randint(1, 4))) for _ in range(120)]
    sentence = lambda k: r.choice([" ", ", ", "-"]).join(r.choice(vocabulary) for _ in range(k))
    return [sentence(r.randint(1, 60)) for _ in range(n)] + [None, "", " .,- ", "A", "a", sentence(30_000), "🙂x🙂 é", "has <S> inside", "<P", "ends <"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 0.5, 3, 1, "x", "y", "z") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (None, rows[4][1], 0.1, 1, 2, "x", "y", "z"), (7, "another text é under an id", 0.0, 1, 1, "x", "y", "z")]
    return spark.createDataFrame(rows, DOCS).repartition(5), rows


# ---- 11 search


def plain_search(docs, items, k=10):
    counts = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    held = [(d, c) for d, c in counts if c]
    all_terms = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in held:
            m = 10 + (90 * c.total() * len(held)) // all_terms
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(TERM.findall((text or "").translate(FOLD))) if c[t]
            )
            if score:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


ASKED = [(1, "abc É a b c d"), (2, None), (3, "zzz"), (4, "A A a"), (None, "日 c"), (4, "b"), (5, " ".join(str(t) for t in texts()[:30])), (5, " ".join(str(t) for t in texts()[:30]))]


@pytest.mark.parametrize("item_bytes", [8 << 20, 6000])
def test_search(spark, docs, item_bytes):
    df, rows = docs
    items = spark.createDataFrame([(*x, 1, 1) for x in ASKED], ITEMS)
    got = sorted((tuple(r) for r in reversed_search.search(df, items, item_bytes=item_bytes).collect()), key=str)
    assert got == plain_search([r[:2] for r in rows], ASKED)


def test_terms_in_pieces(monkeypatch):
    monkeypatch.setattr(reversed_search, "CUT_BYTES", 7)
    for text in filter(None, texts()):
        assert [t.decode() for part in reversed_search.terms_of(text.encode()) for t in part] == TERM.findall(text.translate(FOLD))


def test_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(*x, 1, 1) for x in ASKED], ITEMS)
    assert reversed_search.search(none, items).count() == 0
    assert reversed_search.search(docs[0], spark.createDataFrame([], ITEMS)).count() == 0
    assert reversed_search.search(spark.createDataFrame([(1, None, 0.0, 1, 1, "", "", "")], DOCS), items).count() == 0


def test_search_with_equal_scores(spark):
    d = spark.range(500).selectExpr("499 - id AS doc_id", "'same words' AS text").repartition(7)
    out = reversed_search.search(d, spark.createDataFrame([(1, "words", 1, 1)], ITEMS)).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in out] == []  # a term of all documents weighs 0: ln(1002 / 1001) * 1000 is below 1
    d = d.union(spark.range(500).selectExpr("1000 + id AS doc_id", "'others' AS text"))
    out = reversed_search.search(d, spark.createDataFrame([(1, "words", 1, 1)], ITEMS)).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in out] == [(i + 1, i) for i in range(10)]


def test_long_documents_do_not_overflow():
    import numpy as np

    n = np.array([10, 1 << 40])
    assert reversed_search.lengths_of(n, 1 << 30, 1 << 50).tolist() == [10 + (90 * int(x) * (1 << 30)) // (1 << 50) for x in n]


# ---- 12 fill-in-the-middle


def plain_fim(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return doc_id, n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(docs):
    from pyspark.sql import functions as F

    df, rows = docs
    out = fim.transform(df)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted((plain_fim(*r[:2]) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fim.restored(F.col("form"), F.col("output")).alias("t"))
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((r[0], r[1] or "")) for r in rows)
    assert fim.transform(df.limit(0)).count() == 0


def test_cuts_of_multibyte_texts():
    import numpy as np

    text = "a🙂é日b" * 50
    data = ("pre" + text + "é").encode()
    e = fim.Exceptions(np.frombuffer(data, np.uint8))
    n, positions, excess = e.of(3, len(data) - 2)
    assert n == len(text)
    assert [fim.to_byte(c, positions, excess) for c in range(n + 1)] == [len(text[:c].encode()) for c in range(n + 1)]


# ---- 13 archives


def pages(spark, n=120):
    r = random.Random(2)
    html = [f"<html><p>{' '.join(r.choice(['alpha', 'beta', 'gamma', 'é日']) for _ in range(r.randint(20, 400)))}</p></html>" for _ in range(n)]
    rows = [(i, f"http://h{i % 3}.example/a b\r\n{i}", h) for i, h in enumerate(html)]
    rows += [(200 + i, None, html[0]) for i in range(30)] + [(300, "u", None), (301, "u", ""), (None, "u", html[1]), (None, "u", "alone"), (229, "again", html[0]), (302, "u", "x" * 3_000_000), (303, "", "\r\n\r\nWARC/1.1\r\n\x00")]
    return spark.createDataFrame([(*x, "kept out", b"no") for x in rows], "page_id long, url string, html string, archive string, frame binary").repartition(3), rows


def plain_records(rows):
    first = {}
    for i, _, html in rows:
        h = html or ""
        first[h] = i if first.get(h) is None else first[h] if i is None else max(first[h], i)
    out = []
    for i, _, html in rows:
        h = (html or "").encode()
        own = first[html or ""]
        digest = base64.b32encode(hashlib.sha1(h).digest()).decode()
        out.append((i, len(h), digest, "response" if own == i else "revisit", None if own == i else own))
    return sorted(out, key=str)


@pytest.mark.parametrize("archive_bytes", [32 << 20, 4000])
@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_archives(spark, tmp_path, archive_bytes, broadcast, monkeypatch):
    from docgraph.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    df, rows = pages(spark)
    path = str(tmp_path / "w")
    warc.write(df, path, archive_bytes=archive_bytes)
    files = [f for f in (tmp_path / "w").rglob("part-*") if f.stat().st_size]
    assert all(struct.unpack("<I", f.read_bytes()[:4])[0] == warc.DICTIONARY_FRAME for f in files)
    assert (len(files) > 10) == (archive_bytes == 4000)
    out = warc.read(spark, path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out.collect()), key=str)
    assert got == plain_records(rows)
    assert {r.fault for r in out.collect()} == {None}
    whole = sorted(str((r.page_id, bytes(r.payload).decode())) for r in warc.resolved(out).collect())
    assert whole == sorted(str((i, h or "")) for i, _, h in rows)


def test_payloads_below_the_least_are_responses(spark, tmp_path):
    df, _ = pages(spark)
    warc.write(df, str(tmp_path / "w"), least=1)
    out = {r.page_id: r.record_type for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert (out[300], out[301], out[0], out[229]) == ("response", "response", "revisit", "response")


def test_few_pages_have_no_dictionary(spark, tmp_path):
    df, rows = pages(spark)
    one = df.where("page_id = 5").coalesce(1)
    warc.write(one, str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").rglob("part-*") if f.stat().st_size]
    assert [struct.unpack("<I", f.read_bytes()[:4])[0] for f in files] == [warc.FRAME]
    assert [r.page_id for r in warc.read(spark, str(tmp_path / "w")).collect()] == [5]
    assert warc.round_trip(df.limit(0)).count() == 0


def archive(*frames, dictionary=b"", packed=True):
    head = b""
    if dictionary:
        stored = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        head = struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored
    return head + b"".join(frames)


def test_foreign_archives_and_faults(spark, tmp_path):
    good = [warc.record(i, "http://a/", b"<p>%d</p>" % i, warc.digest_of(b"<p>%d</p>" % i), None, False, "2020-01-01T00:00:00Z") for i in range(40)]
    trained = zstandard.train_dictionary(2000, [g * 3 for g in good] * 5).as_bytes()
    by_dictionary = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    plain = zstandard.ZstdCompressor(write_content_size=False)
    f = [by_dictionary.compress(g) for g in good]
    cases = {
        "packed": archive(*f, dictionary=trained),
        "bare": archive(*f, dictionary=trained, packed=False),
        "none": archive(*map(plain.compress, good)) + warc.PAUSE,
        "cut": archive(*f, dictionary=trained)[:-7],
        "length": archive(plain.compress(good[0].replace(b"Content-Length: ", b"Content-Length: 1", 1)), plain.compress(good[1])),
        "digest": archive(plain.compress(good[0].replace(b"<p>0", b"<p>7")), plain.compress(good[1])),
        "two": archive(plain.compress(good[0] + good[1]), plain.compress(good[2])),
        "version": archive(plain.compress(b"WARC/0.9" + good[0][8:])),
        "field": archive(plain.compress(good[0].replace(b"WARC-Date", b"Date"))),
        "bytes": b"no archive at all",
        "late": plain.compress(good[0]) + archive(f[1], dictionary=trained),
        "lost": b"".join(f),
    }
    for name, data in cases.items():
        (tmp_path / f"{name}.warc.zst").write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    faults = {n: sum(1 for r in rows if r.fault and f"/{n}.warc" in r.fault) for n in cases}
    assert faults == {n: 0 if n in ("packed", "bare", "none") else 1 for n in cases}
    assert sum(r.fault is None for r in rows) == 40 * 3 + 39 + 1 + 1 + 1 + 0 + 0 + 0 + 1
    assert all(r.payload == b"<p>%d</p>" % r.page_id for r in rows if r.fault is None)
