"""Each operator against a plain version on small rows: nulls, empty and long texts, ties, repeated rows, extra columns, empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("docgraph.llm")
from docgraph.llm import bwt_merge, common, decontaminate, langid, minhash, mixing, quality_cnn, quality_rules, sharding, shingles, suffix_dedup, tokens, url_rules  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, score double, n long"
WORDS = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(seed=3, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    sentence = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    base = [sentence(r.randint(3, 120)) for _ in range(n)]
    near = []
    for b in base[:15]:
        w = b.split(" ")
        w[r.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return base + near + base[:5] + [None, "", " \t\n ", "One", "one", sentence(6000), "Tab\tand\x0bform\x0cfeed NBSP\u00a0stays", "ÀÉ Éa\nline\nline\n\nline"]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i, x, ["en", "fr", None][i % 3], None if i % 11 == 0 else f"s{i % 4 if i % 3 else 0}", 0.5, 1) for i, x in enumerate(t)]
    return out + [out[3], (None, t[4], "en", "s1", 0.1, 2), (7, "another text under an id", None, None, 0.0, 3)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- 2 sharding


def test_sharding(docs, rows, nothing):
    out = sharding.assign(docs, shards=5, ranges=16).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    total, largest = sum(r.size for r in out), max(r.size for r in out)
    for s in range(5):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 5) <= 2 * largest
    assert got(sharding.assign(docs, 5, 16)) == got(sharding.assign(docs, 5, 16))
    assert sharding.assign(nothing).count() == 0


def test_sharding_of_one_text(spark):
    """A hot group of copies is spread as evenly as anything else."""
    d = spark.range(3000).selectExpr("id AS doc_id", "'the same text' AS text")
    n = Counter(r.shard for r in sharding.assign(d, shards=8, ranges=16).collect())
    assert max(n.values()) - min(n.values()) <= 1


def test_sharding_of_one_repeated_row(spark):
    d = spark.range(5000).selectExpr("if(id < 4000, 1, id) AS doc_id", "'the same text' AS text")
    out = sharding.assign(d, shards=8, ranges=16).collect()
    assert len({r.copy_part for r in out}) > 1
    for s in range(8):
        own = [r for r in out if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own))) and abs(len(own) - 625) <= 1


def test_shards_are_written_in_order(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/shards", 3)
    back = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1]) for r in rows)
    for s in range(3):
        own = [r.slot for r in back if r.shard == s]
        assert sorted(own) == list(range(len(own)))


# ---- 4 quality rules


def plain_figures(text):
    t = text or ""
    w = WORDS.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_rules(spark, docs, rows, nothing):
    extra = [(900, "a b c d e f g h " * 4, None, None, 0.0, 0), (901, "x#y $ %|<> " * 9 + "\nq\nq\n q\n", None, None, 0.0, 0)]
    d = docs.union(spark.createDataFrame(extra, SCHEMA))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (3, 1, 1), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(d, labels).collect()
    expect = Counter((r[0], *plain_figures(r[1])) for r in rows + extra)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == expect
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    assert quality_rules.judge(nothing, labels.limit(0)).count() == 0


# ---- 5 decontamination


def plain_contamination(doc_rows, items):
    cut = lambda t: [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD)) if w]
    out = []
    for r in doc_rows:
        w, hit, found = cut(r[1]), set(), set()
        for item, text in items:
            iw = cut(text)
            n = min(10, len(iw))
            wanted = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, rows, nothing, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    t = [r[1] for r in rows]
    items = [(1, t[0]), (2, " ".join(t[1].split(" ")[:14]).upper()), (10, "one"), (11, None), (12, "..."), (3, "Line line line"), (4, " ".join(t[2].split(" ")[:3])), (1, t[0]), (5, "nowhere at all is this")]
    out = decontaminate.contamination(docs, spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int"))
    assert got(out) == plain_contamination(rows, items)
    if limit:
        assert decontaminate.contamination(nothing, spark.createDataFrame(items, "item_id long, text string")).count() == 0
        assert not any(r.contaminated for r in decontaminate.contamination(docs, spark.createDataFrame([], "item_id long, text string")).collect())


# ---- 6 mixing


def plain_targets(by):
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight, open_, target, left = {s: i % 3 + 1 for i, s in enumerate(names)}, set(names), {}, float(sum(by.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] > 3 * by[s]]
        if not over:
            return names, target | {s: share * weight[s] for s in open_}
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
            open_.discard(s)
    return names, target


def plain_taken(names, target, total, block, lines):
    """What the slots read of each document; lines: source to (start, size) of its documents."""
    drawn, k = Counter(), 0
    while k * block < total:
        u, end = k * mixing.GOLDEN % 1.0, 0.0
        for s in names:
            end += target[s] / total
            if u < end or s == names[-1]:
                drawn[s] += 1
                break
        k += 1
    out = Counter()
    for s in names:
        size = sum(n for _, n in lines[s])
        reach = min(drawn[s] * block, 3 * size)
        for start, n in lines[s]:
            out[s, start, n] += sum(max(0, min(start + e * size + n, reach) - (start + e * size)) for e in range(3))
    return out


@pytest.mark.parametrize(("slots", "bucket"), [(mixing.SLOTS_PER_SOURCE, mixing.ROWS_PER_BUCKET), (20, 3), (600, 10)])
def test_mixing(docs, rows, nothing, slots, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS_PER_SOURCE", slots)
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", bucket)
    monkeypatch.setattr(mixing, "BUCKETS_PER_RUN", 2)
    out = mixing.mix(docs).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], size(r[1])) for r in rows)
    by = Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    names, target = plain_targets(by)
    total = sum(by.values())
    block = max(1, total // (slots * len(names)))
    lines = {s: sorted((r.start, r.size) for r in out if r.source == s) for s in names}
    for s in names:  # the documents lie end to end on their source's line
        at = 0
        for start, n in lines[s]:
            assert start == at
            at += n
        own = [r for r in out if r.source == s]
        assert own[0].target == pytest.approx(target[s]) and own[0].source_size == by[s] == at
        assert abs(sum(r.taken for r in own) - target[s]) <= 4 * block
        assert all(r.taken <= 3 * r.size for r in own)
    expect = plain_taken(names, target, total, block, lines)
    got_ = Counter()
    for r in out:
        got_[r.source, r.start, r.size] += r.taken
    assert got_ == expect
    assert got(mixing.mix(docs)) == got(mixing.mix(docs))
    assert mixing.mix(nothing).count() == 0


def test_mixing_of_one_repeated_row(spark):
    d = spark.range(9000).selectExpr("if(id < 7000, 1, id) AS doc_id", "'three words here' AS text", "'s' AS source")
    out = mixing.mix(d).collect()
    assert len(out) == 9000 and len({r.start for r in out}) == 9000 and {r.taken for r in out} == {3}


# ---- 7 suffix dedup


def test_merge_against_counting():
    r = random.Random(5)
    for _ in range(60):
        w = r.choice([3, 8, 16])
        base = bytes(r.choice(b"ab") for _ in range(60))
        strings = []
        for _ in range(r.randint(1, 6)):
            x = r.randrange(60)
            strings.append(bytes(r.choice(b"abc") for _ in range(r.randrange(9))) + base[x : r.randrange(x, 61)] * r.choice([1, 2]))
        k = Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
        for s, f in zip(strings, bwt_merge.repeated(strings, w, r.choice([1, 2, 4, 7])), strict=True):
            assert f.tolist() == [k[s[i : i + w]] > 1 for i in range(len(s) - w + 1)]


def plain_removal(doc_rows, width):
    bs = [(r[1] or "").encode() for r in doc_rows]
    k = Counter(b[i : i + width] for b in bs for i in range(len(b) - width + 1))
    out = []
    for r, b in zip(doc_rows, bs, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if k[b[i : i + width]] > 1:
                gone[i : i + width] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((r[0], len(b), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("hot", "segment"), [(suffix_dedup.HOT_STRINGS, suffix_dedup.SEGMENT), (1, 50)])
def test_suffix_dedup(spark, docs, rows, nothing, hot, segment, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", segment)
    extra = [(500, "ab " * 40, None, None, 0.0, 0), (501, "x" + "ab " * 30, None, None, 0.0, 0), (502, "é" * 50, None, None, 0.0, 0)]
    d = docs.union(spark.createDataFrame(extra, SCHEMA))
    assert got(suffix_dedup.dedup(d, width=24, gram=8).drop("kept")) == plain_removal(rows + extra, 24)
    if hot > 1:
        assert suffix_dedup.dedup(nothing).count() == 0


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_STRINGS, 4])
def test_suffix_dedup_at_its_width(spark, hot, monkeypatch):
    """Passages of 199, 200 and 201 bytes, copies, one template with many fillings, a period, and a very long text."""
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    r = random.Random(8)
    line = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    t = [line(r.randint(0, 900)) for _ in range(20)]
    for n in (199, 200, 201, 260):
        p = line(n)
        t += [line(50) + p + line(70), p, line(9) + "#" + p]
    template = line(150)
    t += [template + line(90) for _ in range(12)] + [line(60) + template[:120] + line(r.randint(70, 200)) for _ in range(12)]
    t += ["xyz" * 150, "yzx" * 90 + "!", line(300_000) + t[0] + "xyz" * 70, None, "", t[3], t[3], "é" * 101 + "z", "ü" + "é" * 99]
    rows_ = [(i if i % 9 else None, x) for i, x in enumerate(t)]
    out = suffix_dedup.dedup(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3))
    assert got(out.drop("kept")) == plain_removal(rows_, 200)


# ---- 8 token ids


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_token_ids(docs, rows, nothing):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocabulary())
    plain = sorted(((r[0], [*tk.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], "<u2").tobytes()))
    expect, at = [], 0
    for doc, ids in plain:
        expect.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got(tokens.round_trip(docs, vocabulary())) == sorted(expect, key=str)
    assert tokens.round_trip(nothing, vocabulary()).count() == 0


def test_words_are_encoded_as_in_their_text():
    e = tokens.Encoder(vocabulary())
    odd = ["a~b ~ ~~", "It's THE <|endoftext|> x<|ENDOFTEXT|>", "İstanbul ΣΑΣ\tfoo 123 don't!!'s", "", None, "\u0301 \u0300a", "ﬁ Ǆ ß ÷ ª", "x!!y a., B?", "１２"]
    for t, ids in zip(odd, e.encode(pa.array(odd)).to_pylist(), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1]


def test_random_strings_are_encoded_as_the_tokenizer_does(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3000)
    monkeypatch.setattr(tokens, "CALL", 50)
    e, r = tokens.Encoder(vocabulary()), random.Random(7)
    signs = [*"abzAZ09 \n\t.,!?#*$%&:;~<|>'-_éÉßöÖñçµªº×÷ÿĀőЖλ中あ", "\u0301", "\u0300", "\u00a0", "ﬁ", "<|", "|>", "🙂", "\u200d"]
    some = ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(6000)]
    for at in range(0, len(some), 1000):
        part = some[at : at + 1000]
        for t, ids in zip(part, e.encode(pa.array(part)).to_pylist(), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1], t


def test_capitals_with_combining_marks_are_encoded_as_in_their_text():
    e = tokens.Encoder(vocabulary())
    pairs = [c + m for c, m in zip("HJTWY", "\u0331\u030c\u0308\u030a\u030a", strict=True)]
    words = [f(p) for p in pairs for f in (str, str.lower, lambda p: f"a{p}b!", lambda p: f"{p}aB,", lambda p: f"X{p}\u0323")]
    words += [chr(c) + chr(m) for c in range(65, 91) for m in range(0x300, 0x370)]
    for t, ids in zip([" ".join(words), *words], e.encode(pa.array([" ".join(words), *words])).to_pylist(), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*e.tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_blocks_decode_from_any_checkpoint_and_notice_damage():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 49_000).astype("<u2")
    freq = tokens.scaled(np.bincount(ids, minlength=1 << 16))
    start = np.cumsum(freq, dtype=np.uint64) - freq
    lookup = np.repeat(np.arange(1 << 16, dtype=np.uint16), freq.astype(np.int64))
    block = tokens.encode_block(ids, freq, start)
    for k in range(int.from_bytes(block[12:16], "little")):
        part = tokens.decode_block(block, freq, start, lookup, k)
        assert (part == ids[len(ids) - len(part) :]).all()
    assert len(tokens.decode_block(block, freq, start, lookup)) == len(ids)
    with pytest.raises(ValueError):
        tokens.decode_block(block[:-1] + bytes([block[-1] ^ 1]), freq, start, lookup)
    assert len(tokens.encode_block(ids[:3], freq, start)) > 0


# ---- 9 url rules


def test_url_rules(spark):
    urls = ["https://A.example.com/en/1?x", "http://www.example.com/en/#t", "http://example.com", "ftp://fr.net/fr/x", "x.net/fr/", None, "", "http://u.org/fr/z", "http://bexample.com/en/1", "a://b://c/d", "http://EXAMPLE.com/en/"]
    out = {r.page_id: r for r in url_rules.judge(spark.createDataFrame([(i, u, "h", "n") for i, u in enumerate(urls)], "page_id long, url string, html string, tokens string")).collect()}
    seen = [(out[i].host, out[i].path, out[i].rule) for i in range(len(urls))]
    assert seen == [
        ("a.example.com", "/en/1", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("example.com", "", None), ("fr.net", "/fr/x", "net/fr/"), ("", "", None),
        ("", "", None), ("", "", None), ("u.org", "/fr/z", None), ("bexample.com", "/en/1", "com/"), ("b:", "//c/d", None), ("example.com", "/en/", "example.com/en/"),
    ]
    assert out[0].verdict == "block" and out[1].verdict == "allow" and out[3].verdict == "block"
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def pages_of(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")


def mined_plainly(urls, listed):
    """All token sets that pass the limits, without those that another one implies."""
    from itertools import combinations

    tokens = []
    for u in urls:
        host, path = re.fullmatch(r"\w+://([^/]*)(/.*)?", u).groups()
        own = [f"h:{x}" for x in host.split(".")] + [f"p:{re.sub('[0-9]+', '0', x)}" for x in (path or "").split("/")]
        tokens.append((host, {x for x in own if len(x) > 2}))
    n, found = sum(x is not None for x in listed), set()
    base = sum(x == "block" for x in listed) / n
    for k in range(1, 8):
        for c in {c for _, t in tokens for c in combinations(sorted(t), k)}:
            have = [i for i, (_, t) in enumerate(tokens) if t.issuperset(c)]
            known = [i for i in have if listed[i] is not None]
            blocked = [i for i in have if listed[i] == "block"]
            if len(blocked) >= url_rules.MIN_SUPPORT * n and known and len(blocked) >= url_rules.MIN_CONFIDENCE * len(known) and len(known) >= url_rules.MIN_COVERAGE * len(have):
                if (1 - base) * (len(known) + 2) >= url_rules.MIN_CONVICTION * (len(known) - len(blocked) + 1) and len({tokens[i][0] for i in blocked}) >= url_rules.MIN_HOSTS:
                    found.add(c)
    found = {c for c in found if not any(set(d) < set(c) for d in found)}
    return [any(t.issuperset(c) for c in found) for _, t in tokens]


def test_mined_verdicts_against_all_token_sets(spark):
    r = random.Random(4)
    urls = [f"http://{r.choice(['a', 'b', 'c', 'd'])}{r.randrange(6)}.{r.choice(['ads', 'shop', 'news'])}.{r.choice(['net', 'org', 'com'])}/{r.choice(['fr', 'es', 'en'])}/{r.choice(['x', 'promo', 'y'])}{r.randrange(50)}" for _ in range(600)]
    urls += [u.replace(".net", ".org") for u in urls[:150] if "ads" in u]
    urls += [f"http://q{i % 7}.deals.net/fr/offer{i}" for i in range(150)] + [f"http://q1.deals.org/fr/offer{i}" for i in range(4)]
    out = {x.page_id: x for x in url_rules.judge(pages_of(spark, urls)).collect()}
    listed = [out[i].verdict if out[i].rule else None for i in range(len(urls))]
    hit = mined_plainly(urls, listed)
    assert {h for h, x in zip(hit, listed, strict=True) if x is None} == {True, False}
    for i, (h, x) in enumerate(zip(hit, listed, strict=True)):
        assert out[i].verdict == (x or ("block" if h else "allow")) and (out[i].mined is not None) == (x is None and h)


def test_mined_rules_match_by_index(spark):
    urls = [f"http://s{i % 5}.spam.net/fr/{i}" for i in range(60)] + [f"http://good.com/fr/{i}" for i in range(60)] + ["http://spam.org/x", "http://fine.org/fr/"]
    out = {r.page_id: r for r in url_rules.judge(pages_of(spark, urls)).collect()}
    assert out[120].verdict == "block" and "h:spam" in out[120].mined
    assert out[121].verdict == "allow" and out[121].mined is None
    one_host = [u.replace(f"s{i % 5}.", "") for i, u in enumerate(urls)]
    assert {r.mined for r in url_rules.judge(pages_of(spark, one_host)).collect()} == {None}


def test_a_list_that_blocks_all_it_covers_mines_nothing(spark):
    rows = [(i, f"http://a{i}.net/es/{i}") for i in range(30)] + [(100 + i, f"http://a{i}.org/en/{i}") for i in range(30)]
    rows += [(200 + i, f"http://b{i}.net/en/{i}") for i in range(30)] + [(300, "http://www.example.com/en/"), (301, "http://example.com/en/1")]
    out = {r.page_id: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert {i for i, r in out.items() if r.verdict == "block"} == {*range(30), 301}


@pytest.mark.parametrize("limit", [common.BROADCAST_BYTES, 0])
def test_no_mined_rule_is_dropped(spark, limit, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows = [(100 * i + k, f"http://u{k % 4}.{w}.net/fr/x") for i, w in enumerate(words) for k in range(40)] + [(90_000 + i, f"http://{w}.org/x") for i, w in enumerate(words)]
    rows += [(95_000 + i, "http://u.com/it/x") for i in range(4000)]
    out = url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert {r.page_id for r in out if 90_000 <= r.page_id < 95_000 and r.verdict == "block"} == {90_000 + i for i in range(100)}


def test_mostly_unlisted_tokens_make_no_rule(spark):
    """Blocked wherever the list covers them: 'offer' is covered to a third, 'deal' to a tenth; a long combination alone tells 'bad' from 'good'."""
    rows = [f"http://a{i}.net/fr/offer" for i in range(30)] + [f"http://a{i}.org/x/offer" for i in range(60)] + [f"http://b{i}.net/fr/deal" for i in range(30)] + [f"http://b{i}.org/x/deal" for i in range(300)]
    rows += [f"http://c{i}.com/de/y" for i in range(200)]
    out = {r.page_id: r for r in url_rules.judge(pages_of(spark, rows)).collect()}
    assert {out[i].verdict for i in range(30, 90)} == {"block"} and {out[i].mined for i in range(30, 90)} == {"p:offer"}
    assert {out[i].verdict for i in range(120, 420)} == {"allow"}


def test_url_rules_edges(spark):
    long = "http://a.net/fr/" + "x/" * 50_000
    d = spark.createDataFrame([(1, long, "v", "m", 0), (1, long, "v", "m", 0), (2, None, "v", "m", 0), (None, "http://a.net/es/", "v", "m", 0)], "page_id long, url string, verdict string, mined string, row int")
    out = url_rules.judge(d).collect()
    assert sorted((str(r.page_id), r.verdict) for r in out) == [("1", "block"), ("1", "block"), ("2", "allow"), ("None", "block")]
    h = url_rules.held_out(pages_of(spark, [f"http://h{i}.net/fr/{k}" for i in range(40) for k in range(3)] + [f"http://h{i}.com/fr/{k}" for i in range(40) for k in range(6)])).first()
    assert h.right == h.blocked > 0 and h.missed == 0
    assert url_rules.held_out(pages_of(spark, [None])).first() == (0, 0, 0)


# ---- 10 minhash


def plain_components(doc_rows, n):
    sets = {}
    for r in doc_rows:
        w = WORDS.findall((r[1] or "").translate(FOLD))
        sets[r[0]] = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                k = len(sets[a] & sets[b])
                if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("block", [minhash.BLOCK_MEMBERS, 2])
def test_minhash(spark, rows, nothing, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", block)
    r = random.Random(9)
    base = rows[0][1].split(" ") * 2
    drift = []
    for i in range(30):  # a chain of copies that change step by step
        base[r.randrange(len(base))] = f"w{i}"
        drift.append((1000 - i, " ".join(base), "en", "s", 0.0, 0))
    one_each = [x for x in rows[:-2] if rows.index(x) == [y[0] for y in rows].index(x[0])] + drift
    expect = plain_components(one_each, 2)
    d = spark.createDataFrame(rows[:-1] + drift, SCHEMA)
    out = minhash.near_duplicates(d, words=2).collect()
    assert len(out) == len(rows) - 1 + len(drift)
    for x in out:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == expect[x.doc_id]
    if block > 2:
        assert minhash.near_duplicates(nothing).count() == 0


def test_rows_of_one_id_are_one_node(spark):
    t = [" ".join(f"{a}{i}" for i in range(40)) for a in "abc"]
    rows_ = [(1, t[0]), (9, t[0] + " more"), (9, t[1]), (2, t[1] + " more"), (3, t[2]), (9, ""), (4, None), (4, t[2])]
    out = minhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), words=2).collect()
    assert Counter((x.doc_id, x.component_id, x.kept) for x in out) == Counter(
        [(1, 1, True), (9, 1, False), (9, 1, False), (2, 1, False), (3, 3, True), (9, 9, True), (4, 4, True), (4, 3, False)]
    )


def test_buckets_of_many_regions_are_compared_throughout(spark, monkeypatch):
    """Documents that share half of their words meet in buckets whose pivot is like none of them, but pairs among them are alike."""
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 8)
    r = random.Random(3)
    common_ = [f"c{i}" for i in range(110)]
    rows_ = []
    for k in range(40):
        own = [f"k{k}x{i}" for i in range(60)]
        rows_ += [(2 * k + 5000 * (k % 2), " ".join(common_ + own)), (2 * k + 1 + 5000 * (k % 3), " ".join(common_ + own[:-3] + [f"z{r.random()}"]))]
    expect = plain_components([(i, t) for i, t in rows_], 2)
    out = minhash.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string"), words=2).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in out} == expect


def test_similarity_counts_unequal_values():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 3, (50, minhash.HASHES)).astype(np.uint8) for _ in range(2))
    same = (a == b).mean(axis=1)
    words = lambda x: np.ascontiguousarray(x).view(np.uint64)
    assert np.allclose(minhash.similarity(words(a), words(b)), (same - 1 / 256) / (1 - 1 / 256))


def test_shingles():
    t = ["One two  three", "one TWO three", "", None, "one", "éÉ \t é"]
    b = [x.encode() if x is not None else None for x in t]
    s = shingles.batch_shingles(b, 2)
    assert [len(x) for x in s] == [2, 2, 0, 0, 1, 1]
    assert (s[0] == s[1]).all() and all((x == shingles.shingle_set(y or b"", 2)).all() for x, y in zip(s, b, strict=True))


# ---- 1 and 3: trained models


def test_language_id(spark, nothing):
    r = random.Random(2)
    of = {"en": ["the", "and", "thing", "over", "would"], "de": ["und", "nicht", "schon", "über", "wäre"]}
    rows = [(i, " ".join(r.choice(of[x]) for _ in range(r.randint(3, 40))), x) for i in range(300) for x in [("en", "de")[i % 2]]]
    rows += [(500, None, "en"), (501, "123 !! _", "en"), (502, "", None), (503, "the and", None), (None, "und nicht", "de"), (504, "the and " * 200_000, "en")]
    out = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and all(0 <= x.score <= 1 for x in out)
    assert [by[i].lang_pred for i in (500, 501, 502, 503, 504)] == ["und", "und", "und", "en", "en"]
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (i in held) for i in range(300))
    assert sum(by[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.98
    assert langid.identify(nothing).count() == 0


def plain_bayes(learn, text):
    """Log-probabilities (language to sum) of multinomial naive Bayes over the same buckets, one n-gram after the other."""
    counts, docs_ = {}, Counter()
    for t, lang in learn:
        if t is None or lang is None:
            continue
        docs_[lang] += 1
        c = counts.setdefault(lang, np.ones(1 << langid.BITS))
        for b in langid.buckets(f" {t.lower()} "):
            c[b] += 1
    return {x: np.log(docs_[x] / sum(docs_.values())) + sum(np.log(c[b] / c.sum()) for b in langid.buckets(f" {text.lower()} ")) for x, c in counts.items()}


@pytest.mark.parametrize("block", [langid.BLOCK_LANGUAGES, 2, 1])
def test_language_id_against_plain_bayes(spark, block, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", block)
    monkeypatch.setattr(langid, "SCORED_BYTES", 300)
    r = random.Random(12)
    of = {"en": "the and thing over would", "de": "und nicht schon über wäre", "fr": "les des une dans été"}
    rows_ = [(i, " ".join(r.choice(of[x].split()) for _ in range(r.randint(1, 30))), x) for i in range(120) for x in [r.choice([*of])]]
    rows_ += [(900, "½ ² ①", "de"), (901, "Ⅷ ½", "fr"), (902, "１２ _", "en"), (903, "½ ª", None), rows_[3], rows_[3], (904, "日本", None), (None, "nicht", None)]
    d = spark.createDataFrame([(*x, "s", 1, True) for x in rows_], "doc_id long, text string, lang string, lang_pred string, score int, held_out boolean")
    out = langid.identify(d).collect()
    learn = [(t, x) for i, t, x in rows_ if zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2]
    by = Counter((x.doc_id, x.lang_pred, round(x.score, 4)) for x in out)
    expect = Counter()
    for i, t, _ in rows_:
        if not any(c.isalpha() for c in t):
            expect[i, "und", 0.0] += 1
            continue
        p = plain_bayes(learn, t)
        best = max(sorted(p), key=p.get)
        expect[i, best, round(float(1 / sum(np.exp(v - p[best]) for v in p.values())), 4)] += 1
    assert by == expect
    assert {x.lang_pred for x in out if x.doc_id in (900, 901, 902)} == {"und"}


def test_chunks_cover_documents_alike_alone_and_together():
    net = quality_cnn.Network(3)
    w = net.weights()
    r = random.Random(4)
    some = [bytes(r.randrange(256) for _ in range(n)) for n in (0, 1, 31, 32, 33, 64, 5000, 200_000)]
    together = quality_cnn.pooled(some, w[0], w[1])
    for t, m in zip(some, together, strict=True):
        assert np.allclose(quality_cnn.pooled([t], w[0], w[1])[0], m, atol=1e-5)
    late = b"a" * 150_000 + b"#&%$" * 40  # what stands at the end counts
    assert not np.allclose(quality_cnn.pooled([late], w[0], w[1]), quality_cnn.pooled([b"a" * 150_000], w[0], w[1]))


def plain_score(text, weights):
    """The network's value chunk by chunk and filter by filter."""
    table, bias, v, c = weights
    hop, step, width = quality_cnn.HOP * quality_cnn.STEP, quality_cnn.STEP, quality_cnn.WIDTH
    hops = max(2, -(-len(text) // hop))
    cells = [b + 1 for b in text] + [0] * (hops * hop - len(text))
    value = lambda at: np.maximum(sum(table[w][cells[at + w]] for w in range(width)) + bias, 0) if at + width <= len(cells) else 0 * bias
    chunks = [sum(value(k * hop + s * step) for s in range(2 * quality_cnn.HOP)) / (2 * quality_cnn.HOP) for k in range(hops - 1)]
    return 1 / (1 + np.exp(-(np.max(chunks, axis=0) @ v + c[0])))


def test_quality_scores_against_a_plain_network(spark):
    r = random.Random(3)
    some = [None, "", "a", "é" * 40, "x" * 63, "y" * 64, "z" * 65, "".join(r.choice("abc #$\n") for _ in range(700)), "long " * 300_000]
    rows_ = [(i, t) for i, t in enumerate(some)] + [(7, some[7]), (7, some[7]), (None, "no id")]
    d = spark.createDataFrame([(*x, 0.5, True, 3, "r") for x in rows_], "doc_id long, text string, score double, held_out boolean, predicted int, row string")
    learn = sorted((i, t) for i, t in rows_[:-1] if t is not None and len(t.encode()) <= quality_cnn.SAMPLE_BYTES and zlib.crc32(str(i).encode()) % 3 != 1)
    mark = {i: k % 2 for k, i in enumerate(sorted({i for i, _ in learn}))}
    assert set(mark.values()) == {0, 1}
    labels = spark.createDataFrame([(i, mark.get(i, 0), 0) for i in range(9)], "doc_id long, quality int, toxic int")
    out = quality_cnn.classify(d, labels).collect()
    net = quality_cnn.fit([t.encode() for _, t in learn], np.array([float(mark[i]) for i, _ in learn]))
    expect = Counter()
    for i, t in rows_:
        if t is None or len(t) < 10_000:
            expect[i, round(float(plain_score((t or "").encode(), net.weights())), 4)] += 1
    assert Counter((x.doc_id, round(x.score, 4)) for x in out if x.doc_id != 8) == expect
    assert len(out) == len(rows_) and all(0 <= x.score <= 1 for x in out)
    kept = quality_cnn.kept(d, labels)
    assert kept.columns == d.columns and Counter(x.doc_id for x in kept.collect()) == Counter(x.doc_id for x in out if x.predicted)


def test_quality_network(spark, nothing):
    r = random.Random(6)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    bad = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) + "###" for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(240)] + [(None, 1, 0), (1, None, 0)]
    d = spark.createDataFrame([*rows, (500, None), (501, ""), (None, good())], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality_cnn.classify(d, lab).collect()
    by = {x.doc_id: x for x in out}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) == 243 and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in out)
    assert all(by[i].held_out == (i in held) for i in range(240))
    assert sum(by[i].predicted == int(i % 3 > 0) for i in held) / len(held) > 0.95
    assert quality_cnn.classify(nothing, lab).count() == 0
    assert {x.score for x in quality_cnn.classify(d, lab.limit(0)).collect()} == {0.5}
