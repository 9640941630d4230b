"""Operators that SQL can't express, against plain versions of their own."""

import math
import random

import numpy as np

from skein.llm import ann, decontamination, language_id, quality, secrets

EMPTY = "doc_id long, text string"


def prose(seed, n, size=3000):
    rng = random.Random(seed)
    return [f"word{rng.randrange(size)}" for _ in range(n)]


def passage_distance(item, text):
    """Least edits between the item and any passage of the text, row by row."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        out = [i]
        for j, y in enumerate(text, 1):
            out.append(min(row[j - 1] + (x != y), row[j] + 1, out[-1] + 1))
        row = out
    return min(row)


def test_decontamination_finds_what_brute_force_finds(spark):
    """Items with exactly as many edits as are allowed: at least the stated recall, and never anything else."""
    rng, rows = random.Random(2), []
    items = [(i, prose(500 + i, (6, 9, 14, 22, 35, 60)[i % 6])) for i in range(18)] + [(90, prose(1, 900))]
    for n in range(120):
        item = list(items[n % 19][1])
        for _ in range(decontamination.allowed(len(item), 0.2)):
            at = rng.randrange(len(item))
            item[at] = f"x{rng.getrandbits(40)}"
        rows.append((n, prose(n, 25) + item + prose(n + 1, 25)))
    rows += [(1000, []), (1001, prose(1, 900)), (1001, prose(1, 900))]
    want = {}
    for i, text in rows:
        near = {k: passage_distance(item, text) for k, item in items if len(item) < 100 or i >= 1000 or i % 19 == 18}
        near = {k: d for k, d in near.items() if d <= decontamination.allowed(len(dict(items)[k]), 0.2)}
        if near:
            want[i] = (sorted(near), min(near.values()))
    docs = spark.createDataFrame([(i, " ".join(t) if t else None) for i, t in rows], EMPTY)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in items], "item_id long, text string")
    got = {r.doc_id: (r.item_ids, r.least_distance) for r in decontamination.contaminated(spark, docs, bench).collect()}
    assert set(got) <= set(want) and all(set(got[i][0]) <= set(want[i][0]) for i in got)
    pairs = sum(len(ids) for ids, _ in want.values())
    assert sum(len(ids) for ids, _ in got.values()) >= decontamination.RECALL * pairs
    assert all(got[i] == want[i] for i in (1001,))
    assert decontamination.contaminated(spark, docs.limit(0), bench).count() == 0


def test_lsh_reaches_its_recall_and_filters():
    rng = np.random.default_rng(3)
    for m in (10, 20, 40, 80):
        k, hit, stray = decontamination.allowed(m, 0.2), 0, 0
        for _ in range(200):
            item = rng.integers(1, 1 << 62, m).astype(np.uint64)
            window, other = item.copy(), rng.integers(1, 1 << 62, m).astype(np.uint64)
            window[rng.choice(m, k, replace=False)] = rng.integers(1, 1 << 62, k).astype(np.uint64)
            keys = decontamination.lsh_keys(np.stack([item, window, other]), 8, 8, 2, most_bytes=1)
            hit, stray = hit + (keys[0] == keys[1]).any(), stray + (keys[0] == keys[2]).any()
        assert hit >= 198 and stray <= 4


def test_votes_are_those_of_all_neighbours(spark):
    """Scores by blocked products equal votes counted one by one; ties and repeated rows are judged alike."""
    rows = [(i, " ".join(prose(i, 40, 50 if i % 2 else 2000)).upper() if i % 3 else " ".join(prose(i, 40, 80))) for i in range(90)]
    rows += [(200, None), (201, ""), (202, rows[0][1]), (202, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, EMPTY)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(80)] + [(3, 1), (None, 1), (4, None), (999, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels, neighbours=7)
    got = quality.score(spark, docs, model, names=("_s", "_p")).collect()
    for r in got:
        data = np.frombuffer((r.text or "").encode(), np.uint8)
        v = model.embed(data, np.array([0, len(data)]))[0]
        near = sorted((-float(v @ w), float(y)) for w, y in zip(model.vectors, model.labels))[:7]
        weight = [max(0.0, -c) ** quality.SHARP for c, _ in near]
        vote = (sum(w * y for w, (_, y) in zip(weight, near)) + 1e-3 * model.prior) / (sum(weight) + 1e-3)
        assert abs(vote - r._s) < 1e-6 and r._p == int(r._s >= 0.3), r.doc_id
    assert len({r._s for r in got if r.text == rows[0][1]}) == 1
    assert quality.quality_scores(spark, docs.limit(0), labels).count() == 0


def test_language_is_the_product_of_its_evidence(spark):
    say = {"aa": "the thing and that with", "bb": "le que une dans pour les"}
    docs = [(i, lang, " ".join(random.Random(i).choices(say[lang].split(), k=12)), f"s{i % 3}", "x") for i in range(60) for lang in [("aa", "bb")[i % 2]]]
    docs += [(70, None, None, None, "x"), (71, "aa", docs[0][2], "s0", "x"), (71, "aa", docs[0][2], "s0", "x")]
    table = spark.createDataFrame(docs, "doc_id long, lang string, text string, source string, host string")
    pages = spark.createDataFrame([(i, f"http://h{i % 2}.org/bb/{i}", f"<html lang='{'bb' if i % 4 else 'zz'}'><p>{say['bb' if i % 3 else 'aa']}</p>", "q") for i in range(12)], "page_id long, url string, html string, domain string")
    model = language_id.fit_text(table)
    evidence = language_id.evidence_of_pages(pages).unionByName(language_id.evidence_of_documents(table))
    rows = [r.asDict() for r in evidence.collect()]
    for r in rows:
        text = (language_id.visible(r["text"] or "") if r["is_html"] else r["text"] or "").encode()
        r["logs"] = model.likelihoods(np.frombuffer(text, np.uint8), np.array([0, len(text)]), language_id.TEMPER, language_id.TOP)[0]
        r["soft"] = np.exp(r["logs"]) / np.exp(r["logs"]).sum()
    sums = lambda test: sum((r["soft"] for r in rows if test(r)), np.zeros(2))
    overall = (sums(lambda r: True) + 1) / (len(rows) + 2)
    lean = lambda n, base: (n + language_id.LEAN * base) / (n.sum() + language_id.LEAN)
    want = []
    for r in rows:
        domain = lean(sums(lambda x: x["domain"] == r["domain"]), overall)
        score = r["logs"] + np.log(lean(sums(lambda x: (x["domain"], x["host"]) == (r["domain"], r["host"])), domain))
        for name in ("markup", "suffix"):
            if r[name]:
                kinds = {x[name] for x in rows if x[name]}
                score = score + np.log((sums(lambda x: x[name] == r[name]) + 1) / (sums(lambda x: bool(x[name])) + len(kinds) + 1))
        best = int(np.argmax(score))
        want.append((r["page_id"], r["doc_id"], model.languages[best], round(float(1 / np.exp(score - score.max()).sum()), 4)))
    got = [(r.page_id, r.doc_id, r.lang, round(r.confidence, 4)) for r in language_id.identify(spark, evidence, model).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    none = language_id.identify(spark, evidence.limit(0), model)
    assert none.count() == 0 and set(none.columns) == {"page_id", "doc_id", "lang", "confidence"}


def test_hidden_text_in_linear_time():
    assert language_id.visible("a<script>x</SCRIPT >b<!-- y --><nav>z</nav>c").split() == ["a", "b", "c"]
    assert language_id.visible("k<article><p>one</p><b>two</b></article>rest").split() == ["one", "two"]
    assert language_id.visible("a<script>b").split() == ["a", "b"] and language_id.visible("a<!-- b").split() == ["a"]
    for hostile in ("<script>" * 200_000, "<!--" * 200_000, "<" * 400_000, "<article>" * 200_000, "İ<p>" * 100_000):
        language_id.visible(hostile)


def test_secrets_of_a_text_with_very_many(spark):
    text = "deadbeefdeadbeef é " * 30_000
    docs = spark.createDataFrame([(1, text), (2, "password=abcdefghijkl0123456789abcdef0")], EMPTY)
    scanned = secrets.scan(spark, docs)
    rows = {r.doc_id: r for r in secrets.report(scanned).collect()}
    assert rows[1].n_hex == 30_000 and rows[1].spans.endswith(f"hex:{19 * 29_999}:{19 * 29_999 + 16}") and rows[2].spans == "assign:0:38,hex:21:38"
    clean = {r.doc_id: r.text for r in secrets.redact(scanned).collect()}
    assert clean[1] == "[SECRET] é " * 30_000 and clean[2] == "[SECRET]"


def test_nearest_reaches_its_recall_at_low_contrast(spark):
    """Unit vectors whose neighbours are hardly nearer than the average; and long vectors close to each other."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = np.repeat(centres, 50, 0) + 1.2 * rng.normal(size=(2000, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype("f4").astype("f8")
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(spark, table).toPandas()
    hit = 0
    for i in range(0, 2000, 100):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        hit += len(set(np.argsort(d, kind="stable")[1:11]) & set(got[got.query_id == i].vec_id))
    assert len(got) == 200 and hit >= 180
    far = [(i, [1e8 + math.sin(i), 1e8 + math.cos(3 * i)]) for i in range(60)]
    got = ann.nearest(spark, spark.createDataFrame(far, "vec_id long, embedding array<double>"), every=20, k=3).toPandas()
    for i in (0, 20, 40):
        d = {j: math.dist(far[i][1], v) for j, v in far if j != i}
        assert list(got[got.query_id == i].sort_values("rank").vec_id) == sorted(d, key=lambda j: (d[j], j))[:3]


def test_settings_are_fitted():
    rng = np.random.default_rng(1)
    sample = np.repeat(rng.normal(size=(100, 8)), 40, 0) + 0.01 * rng.normal(size=(4000, 8))
    near = [sample[(i // 40) * 40 : (i // 40) * 40 + 10] for i in range(0, 4000, 100)]
    tight = ann.choose(sample, sample[::100], near, 1e9, 1e7)
    family = ann.Hashes(8, tight.tables, tight.hashes, tight.width)
    share = np.mean([(family.visited(t, sample[::100], near, sample)[1] < tight.probes).mean() for t in range(tight.tables)])
    assert share < 0.1
    flat = rng.normal(size=(500, 64))
    assert ann.choose(flat, flat[:20], [flat[20:30]] * 20, 1e4, 1e2) == ann.choose(flat, flat[:20], [flat[20:30]] * 20, 1e4, 1e2)


def test_packs_are_tiered_and_balanced(spark):
    """Windows are as long as their tier, long ones are filled from shorter tiers, and step groups hold equal numbers of tokens."""
    from skein.llm import packing
    from skein.llm.queries import vocabulary

    docs = spark.createDataFrame([(i, " ".join(prose(i, 20 + (i * 37) % 400))) for i in range(300)], EMPTY).coalesce(1)
    got = packing.pack(docs, vocabulary(), step_tokens=4096).toPandas()
    windows = got.groupby("sequence_id").agg(n=("length", "sum"), tier=("tier", "first"), group=("step_group", "first"), cost=("length", lambda x: (x**2).sum()), pieces=("length", "size"))
    assert (windows.tier == windows.n).all() and (windows[windows.tier == 1024].pieces > 1).any()
    # only what is left at the end is cut into powers of two
    full = windows[windows.tier.isin(packing.TIERS)]
    assert len(windows) - len(full) <= 10 and len(set(full.tier)) > 2
    groups = full.groupby("group").agg(n=("n", "sum"), tiers=("tier", "nunique"))
    assert (groups.tiers == 1).all() and groups.n.max() <= 4096 and (groups.n >= 2048).sum() >= len(groups) - 2 * len(packing.TIERS)


def test_a_very_long_conversation(spark):
    from skein.llm import chat_format

    rows = [(1, t, "assistant" if t % 2 else "user", "</s>" if t % 3 == 0 else f"turn {t} [INST]") for t in range(4000)] + [(2, 0, "user", "x" * 2_000_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(table)).collect()}
    assert got[1].n_turns == 4000 and got[1].loss_chars == sum(len(x) for _, t, r, x in rows[:4000] if r == "assistant") and got[2].formatted_chars > 2_000_000
