"""Archives, alignment and spelling variants on small hard tables, against brute force."""

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from skein.llm import alignment, spelling, warc
from skein.llm.common import Workspace
from skein.llm.queries import PIECES, vocabulary

PAGES = "page_id long, url string, html string, record_type double"


# --- archives ----------------------------------------------------------------

BIG, OTHER = "<p>é😀</p>" * 200, "x" * 1000
ROWS = [
    (1, "http://a/1", BIG, 0.0), (7, "http://a/7 b\r\nX: y", BIG, 0.0), (3, None, BIG, 0.0), (None, "http://n", BIG, 0.0), (7, "http://a/7 b\r\nX: y", BIG, 0.0),
    (4, "http://b", "x" * 999, 0.0), (5, "http://b", "x" * 999, 0.0), (6, "http://b", OTHER, 0.0), (8, "", OTHER, 0.0), (9, "u", None, 0.0), (10, "u", "", 0.0),
    (None, "u", "y" * 2000, 0.0), (None, "u", "y" * 2000, 0.0), (2**63 - 1, "u", "\r\n\r\n" * 400 + "WARC/1.1\r\n\r\n", 0.0), (-5, "u", "z\x00" * 300_000, 0.0),
]


def expected_pages(rows, least=1000):
    payloads = [(x[0], (x[2] or "").encode()) for x in rows]
    head = {}
    for page, p in payloads:
        if len(p) >= least and page is not None:
            head[p] = max(page, head.get(p, page))
    out = []
    for page, p in payloads:
        to = head.get(p) if len(p) >= least else None
        to = None if to == page else to
        out.append((page, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def pages_got(frame):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect()), key=str)


@pytest.mark.parametrize("few", [1 << 20, 1, 0])
def test_archives_round_trip(spark, few, tmp_path):
    table = spark.createDataFrame(ROWS, PAGES).repartition(3)
    work = Workspace(spark, "test")
    rows = warc.with_heads(spark, table, work, few=few)
    manifest = work.table(warc.write_archives(rows, str(tmp_path), archive_bytes=900), "manifest")
    records = work.table(warc.read_archives(manifest, payloads=True), "records")
    assert pages_got(warc.resolved(records, work)) == expected_pages(ROWS)
    kept = records.collect()
    assert all(r.verified for r in kept) and sum(r.record_type == "warcinfo" for r in kept) == manifest.count() > 3
    by_id = {r.record_id: r for r in kept if r.record_type == "response"}
    want = Counter((x[0], (x[2] or "").encode()) for x in ROWS)
    assert Counter((r.page_id, bytes((r if r.record_type == "response" else by_id[r.refers_to_record]).payload)) for r in kept if r.page_id is not None or r.record_type != "warcinfo") == want
    # every record is a member of its own, and the whole file is plain gzip
    for row in manifest.collect():
        data = open(row.path, "rb").read()
        assert len(data) == row.bytes and gzip.decompress(data).count(b"WARC-Record-ID") == row.records + 1
        places = sorted(r.position for r in kept if r.path == row.path)
        for start, end in zip(places, [*places[1:], len(data)], strict=True):
            member = zlib.decompressobj(31)
            assert member.decompress(data[start:end]).startswith(b"WARC/1.1\r\n") and member.eof and not member.unused_data


def test_archives_of_an_empty_table(spark):
    assert warc.archive_pages(spark, spark.createDataFrame([], PAGES)).collect() == []


def test_damaged_archives(tmp_path, spark):
    good = [warc._member(warc.page_record(i, f"http://{i}", bytes([97 + i]) * 5000), 6) for i in range(5)]
    cut = bytearray(good[1])
    cut[40] ^= 255
    lying = warc._member(warc.page_record(8, "u", b"abc" * 50).replace(b"abcabc", b"abcxbc", 1), 6)
    short = warc._member(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc\r\n\r\n", 6)
    long = warc._member(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nabc\r\n\r\n", 6)
    none = warc._member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc\r\n\r\n", 6)
    data = good[0] + bytes(cut) + good[2] + b"junk" * 20000 + lying + short + good[3] + long + none + good[4][:-9]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    rows = warc.read_archives(spark.createDataFrame([(str(path),)], "path string"), payloads=True).collect()
    assert [r.page_id for r in rows if r.error is None] == [0, 2, 3]
    assert [r.page_id for r in rows if r.error and "digest" in r.error] == [8]
    assert all(bytes(r.payload) == bytes([97 + r.page_id]) * 5000 for r in rows if r.error is None)
    assert sum(r.error is not None and "digest" not in r.error for r in rows) == 5 - 1  # short and what follows it are told apart by the good record between them
    assert not any(r.verified for r in rows if r.error)


def test_revisits_without_a_response(spark):
    work = Workspace(spark, "test")
    schema = "page_id long, record_type string, record_id string, refers_to_record string, payload_bytes long, payload_digest string, verified boolean"
    rows = [
        (1, "revisit", "<r1>", "<gone>", None, "d1", True), (2, "revisit", "<r2>", None, None, "d1", True), (3, "response", "<r3>", None, 5, "d3", True), (4, "revisit", "<r4>", "<r3>", None, "d4", True),
        (5, "revisit", "<r5>", "<r3>", None, "d3", True), (6, "warcinfo", "<r6>", None, 1, "x", True),
    ]
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes, r.verified) for r in warc.resolved(spark.createDataFrame(rows, schema), work).collect()}
    lost = ("revisit", None, None, False)
    assert got == {1: lost, 2: lost, 3: ("response", None, 5, True), 4: lost, 5: ("revisit", 3, 5, True)}


# --- alignment ---------------------------------------------------------------


@pytest.fixture(scope="module")
def hard_texts():
    rng = random.Random(3)
    letters = "abc éü漢字\n\t  '’s😀123<>/|" + "▁" * 0 + "\x1c\x85\xa0"
    texts = [None, "", " ", "  ", "a ", " a", "a  b", "a\n b", "a \n\n  b c\n", "it's  </s> <|endoftext|> <0x41> <unk>", "▁x", "x ▁", "\x00", "漢字漢字 😀😀", "=" * 700, "a" * 3000, "word " * 400 + "\n", "Straße naïve coöperate"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    texts += ["".join(rng.choice("qxzjkv=-") for _ in range(4000))]
    return texts


def plain_alignment(texts):
    """By the libraries on whole texts, position by position."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_codec = Tokenizer.from_file(vocabulary())
    a_codec.encode_special_tokens = True
    b_codec = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    from skein.llm.token_counts import byte_symbols

    back = {s: b for b, s in byte_symbols().items()}
    found = []
    for text in texts:
        if not text:
            found.append(None)
            continue
        whole = (" " + text).encode()
        a, b = a_codec.encode(" " + text, add_special_tokens=False).ids, b_codec.encode(text)
        bytes_a = [bytes(back[c] for c in a_codec.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b_codec.id_to_piece, b)]
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            found.append(None)
            continue
        ends = []
        for parts in (bytes_a, bytes_b):
            at, out = 0, []
            for p in parts:
                at += len(p)
                out.append(at)
            ends.append(out)
        both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
        for end in both:
            k, m = ends[0].index(end, i) + 1, ends[1].index(end, j) + 1
            groups.append((a[i:k], b[j:m], end))
            i, j = k, m
        found.append((a, b, groups))
    return found


def expected_alignment(texts):
    found, count, best = plain_alignment(texts), Counter(), defaultdict(int)
    links = [[(x, y) for a, b, _ in (f[2] if f else []) for x in a for y in b] for f in found]
    for each in links:
        count.update(set(each))
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for f, each in zip(found, links, strict=True):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), len(each), sum(count[x] == best[x[0]] for x in each), sum(count[x] for x in each), hashlib.sha256(told.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("most, memo, part_pairs, large", [(1 << 21, 1 << 17, 1 << 18, 1 << 12), (0, 5, 7, 1), (1 << 21, 50, 7, 1)])
def test_alignment(spark, hard_texts, most, memo, part_pairs, large, monkeypatch):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    rows = [(i, t, "x") for i, t in enumerate(hard_texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = alignment.alignment_report(spark, frame, vocabulary(), vocabulary(PIECES), most, memo, part_pairs).collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got}
    assert got == dict(enumerate(expected_alignment(hard_texts)))


def test_alignment_of_repeated_ids_and_of_nothing(spark):
    frame = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one"), (2, "three")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.count_sum) for r in alignment.alignment_report(spark, frame, vocabulary(), vocabulary(PIECES)).collect())
    assert got[0] == (0, 3) and got[1] == got[2] and len(got) == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_report(spark, empty, vocabulary(), vocabulary(PIECES)).collect() == []


def test_token_groups(spark, hard_texts):
    frame = spark.createDataFrame(list(enumerate(hard_texts)), "doc_id long, text string")
    got = defaultdict(list)
    for r in alignment.token_groups(frame, vocabulary(), vocabulary(PIECES)).orderBy("doc_id", "number").collect():
        assert r.number == len(got[r.doc_id])
        got[r.doc_id].append((r.a_ids, r.b_ids, r.end_byte))
    assert {k: v for k, v in got.items()} == {i: f[2] for i, f in enumerate(plain_alignment(hard_texts)) if f}


# --- spelling ----------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_variants(rows, every=97, shortest=5, fewest=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= fewest}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def variants(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


@pytest.fixture(scope="module")
def spelled():
    rng, rows = random.Random(5), []
    base = ["colour", "color", "aaaaa", "aaaaaa", "aaaaaaa", "abababab", "Éclairé", "straßen", "x" * 400] + ["".join(rng.choice("abcé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    for i in range(1500):
        w = rng.choice(base)
        if rng.random() < 0.4:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcé") + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k:], w.upper()])
        rows.append((i % 40, " ".join([w] * rng.choice([1, 2, 3, 5]))))
    rows += [(None, "anyone anyone anyone"), (None, "anyone"), (41, None), (42, ""), (43, "12 34 ,, ×÷×÷× ×÷×÷×÷ ×÷×÷×"), (44, "shared " * 2000 + "sharer " * 900 + "sharers " * 400 + "shares " * 100)]
    return rows


@pytest.mark.parametrize("large", [spelling.LARGE, 40, 1])
def test_spelling_variants(spark, spelled, large):
    frame = spark.createDataFrame([(*r, 1) for r in spelled], "doc_id long, text string, word int").repartition(3)
    want = expected_variants(spelled)
    assert variants(spelling.spelling_variants(spark, frame, large=large)) == want
    assert sum(r[1] is not None for r in want) > 40 and any(r[2] != r[1] for r in want if r[1])


def test_deleted_code_points_count(spark):
    rows = [(i, " ".join(f"word{'abcdefghij'[i % 10]}{'klmnop'[k % 6]}" for k in range(30))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert variants(spelling.spelling_variants(spark, frame, every=7)) == expected_variants(rows, every=7)


def test_words_that_share_a_beginning_are_split(spark):
    """A third and more of all words under one prefix: parts stay small and no pair is lost."""
    rng = random.Random(9)
    words = sorted({"interna" + "".join(rng.choice("abcdef") for _ in range(7)) for _ in range(3000)})
    table = spark.createDataFrame([(w, 3 + i % 50) for i, w in enumerate(words)], "word string, n long")
    rows = spelling.parts(table, Workspace(spark, "test"), 200)
    assert max(r["count"] for r in rows.groupBy(*spelling._KEY).count().collect()) <= 200
    deletions = defaultdict(set)
    for w in words:
        for i in range(len(w)):
            deletions[i, w[:i] + w[i + 1 :]].add(w)
    want = {(a, b) for group in deletions.values() for a in group for b in group if a != b}
    got = [(r.word, r.near) for r in spelling.near_words(table, Workspace(spark, "test"), 200).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_no_words(spark):
    assert spelling.spelling_variants(spark, spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")).collect() == []


# --- quality -----------------------------------------------------------------


def test_quality_holds_a_block_of_cosines_only():
    import tracemalloc

    import numpy as np

    from skein.llm import quality

    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["good", "bad", "word", "!!", "42"], 6)).encode() for _ in range(10_000)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    data = np.frombuffer(b"".join(texts), np.uint8)
    codes = np.unique(quality.terms(data, bounds)[0])
    model = quality.Model(codes, np.ones(len(codes)), rng.normal(size=(len(codes), 32)), quality._project(rng.normal(size=(4096, 32)), np.eye(32)), rng.integers(0, 2, 4096).astype(float), 25, 8)
    tracemalloc.start()
    got = model.scores(data, bounds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 10_000 and peak < 200 << 20
    # a row of a block gets what it gets alone
    some = [0, 511, 512, 9_999]
    alone = [model.scores(np.frombuffer(texts[i], np.uint8), np.array([0, len(texts[i])]))[0] for i in some]
    assert np.allclose(got[some], alone, atol=1e-9)
    assert len(model.scores(np.zeros(0, np.uint8), np.zeros(1, np.int64))) == 0
