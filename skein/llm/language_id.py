"""Language identification by Bayesian evidence fusion.

The posterior of a language is the product of

* the text's likelihood under a hashed byte-trigram model, learned from a bounded
  sample of rows whose language is known and tempered by ``temper``;
* the likelihood of the language that the markup declares;
* the likelihood of the address suffix (the host's last label and the first part of
  the path), each counted against the text's own verdict and smoothed;
* the host's prior, smoothed hierarchically: a host's counts lean on its domain's,
  these on those of all rows. Counts are grouped sums, made before any shuffle.

Results: a row without text, markup and address gets the overall prior. Nulls stand
for missing evidence. Markup languages that the model doesn't know count as another
declared value. Ties go to the language that sorts first. Equal rows are judged
alike; extra columns are ignored; without known languages there is no verdict.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, join_hot, text_buffers

SAMPLE, BINS, TEMPER, LEAN, TOP, FOLDS = 4096, 1 << 14, 0.05, 5.0, 60.0, 5
_NAME = re.compile(r"<(/?)([a-z]+)", re.I)
_HIDDEN = ("script", "style", "nav", "noscript", "template")
_BODIES = ("article", "main")
#: The pattern of a declared language, as HTML writes it.
DECLARED = r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})"""


def visible(html: str) -> str:
    """The text outside tags, comments and hidden elements: of the first article or main element, if there is one.

    One pass from left to right. What is never closed is searched for once: an open comment or
    tag ends the text, the start of a hidden element that is never closed counts as a plain tag.
    """
    parts, body, low = [], None, html.lower()
    at, never, inside = 0, set(), None
    if len(low) != len(html):  # some letters grow; ends of tags are ASCII
        low = "".join(c.lower() if c.isascii() else c for c in html)

    def find(text: str, start: int) -> int:
        if text in never:
            return -1
        found = low.find(text, start)
        if found < 0:
            never.add(text)
        return found

    while at < len(html):
        open_ = find("<", at)
        if open_ < 0:
            parts.append(html[at:])
            break
        parts.append(html[at:open_])
        if low.startswith("<!--", open_):
            end = find("-->", open_ + 4)
            at = len(html) if end < 0 else end + 3
            continue
        end = find(">", open_)
        if end < 0:
            break
        name = _NAME.match(html, open_)
        kind = name[2].lower() if name else ""
        at = end + 1
        if name and not name[1] and kind in _HIDDEN:
            close = find("</" + kind, at)
            if close >= 0:
                close = find(">", close)
                at = len(html) if close < 0 else close + 1
        elif name and kind in _BODIES and body is None:
            if not name[1] and inside is None:
                inside, parts = kind, []
            elif name[1] and kind == inside:
                body = " ".join(parts)
                break
    return " ".join(parts) if body is None else body


def _codes(data: np.ndarray, bounds: np.ndarray, bins: int):
    """Hashed trigrams of letters, and the text each belongs to."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    low = np.where(((low >= 97) & (low <= 122)) | (low >= 128), low, 32).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = (low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA77) ^ low[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    good = (text[:-2] == text[2:]) & (low[1:-1] != 32)
    return (codes >> np.uint32(32 - bins.bit_length() + 1)).astype(np.int64)[good], text[:-2][good]


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.bins = languages, counts.shape[1]
        smooth = counts + 0.5
        self.logs = np.log(smooth / smooth.sum(1, keepdims=True)).T

    def likelihoods(self, data: np.ndarray, bounds: np.ndarray, temper: float, top: float) -> np.ndarray:
        """Tempered log likelihoods, the best at 0 and none under -``top``."""
        codes, text = _codes(data, bounds, self.bins)
        n = len(bounds) - 1
        out = np.stack([np.bincount(text, self.logs[codes, i], minlength=n) for i in range(len(self.languages))], 1)
        out = (out - out.max(1, keepdims=True)) * temper
        return np.maximum(out, -top)


def fit_text(documents: DataFrame, sample: int = SAMPLE, bins: int = BINS, folds: int = FOLDS) -> TextModel:
    """From at most ``sample`` rows of known language whose crc32(doc_id) mod ``folds`` is not 0."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == 0
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held)
    ids = rows.select(F.col("doc_id").alias("_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    rows = rows.join(F.broadcast(ids), rows.doc_id == ids["_id"], "left_semi").select("lang", "text")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for row, n, data, bounds in text_buffers(batch.column("text")):
                codes, text = _codes(data, bounds, bins)
                for i in range(n):
                    total.setdefault(langs[row + i], np.zeros(bins, np.int64))
                    total[langs[row + i]] += np.bincount(codes[np.searchsorted(text, i) : np.searchsorted(text, i, "right")], minlength=bins)
        at = {k: np.flatnonzero(v) for k, v in total.items()}
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k in total for _ in at[k]], pa.string()), pa.array(np.concatenate([*at.values(), np.zeros(0, np.int64)])), pa.array(np.concatenate([*(total[k][at[k]] for k in total), np.zeros(0, np.int64)]))],
            ["lang", "bin", "n"],
        )

    table = rows.mapInArrow(run, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(languages), bins))
    counts[[languages.index(x) for x in table.column("lang").to_pylist()], table.column("bin").to_numpy()] = table.column("n").to_numpy()
    return TextModel(languages, counts)


def evidence_of_pages(pages: DataFrame) -> DataFrame:
    """page_id, doc_id (null), text (HTML), markup, host, domain, suffix."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2,3})(?:[/?#]|$)", 1))
    last = F.regexp_extract(host, r"([^.]+)$", 1)
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.lit(None).cast("long").alias("doc_id"), F.col("html").alias("text"), F.lit(True).alias("is_html"),
        F.lower(F.regexp_extract("html", DECLARED, 1)).alias("markup"), host.alias("host"),
        F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"), F.concat_ws("/", last, path).alias("suffix"),
    )


def evidence_of_documents(documents: DataFrame) -> DataFrame:
    """The same for plain documents: the source is the host, and there is no markup."""
    none = F.lit("")
    return documents.select(
        F.lit(None).cast("long").alias("page_id"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(False).alias("is_html"),
        none.alias("markup"), F.coalesce("source", none).alias("host"), F.lit("documents").alias("domain"), none.alias("suffix"),
    )


def _shares(rows: DataFrame, keys: list[str], languages: list[str], *more) -> DataFrame:
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("soft")[i]) for i in range(len(languages))]).alias("n"), *more)


def identify(spark: SparkSession, evidence: DataFrame, model: TextModel, temper=TEMPER, lean=LEAN, top=TOP, space: Workspace | None = None) -> DataFrame:
    """page_id, doc_id, lang, confidence for every row."""
    space = space or Workspace(spark, "language")
    languages = model.languages
    if not languages:
        return evidence.select("page_id", "doc_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"))
    shared = spark.sparkContext.broadcast(model)
    names = ["page_id", "doc_id", "markup", "host", "domain", "suffix"]

    def run(batches):
        model = shared.value
        for batch in batches:
            html = batch.column("is_html").to_pylist()
            texts = batch.column("text")
            if any(html):
                texts = pa.array([visible(t.as_py() or "") if h else t.as_py() for t, h in zip(texts, html)], pa.large_string())
            logs = [model.likelihoods(data, bounds, temper, top) for _, _, data, bounds in text_buffers(texts)]
            logs = np.concatenate([*logs, np.zeros((0, len(languages)))])
            soft = np.exp(logs)
            soft /= soft.sum(1, keepdims=True)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(languages)), pa.array(x.ravel())) for x in (logs, soft)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *lists], [*names, "logs", "soft"])

    schema = "page_id long, doc_id long, markup string, host string, domain string, suffix string, logs array<double>, soft array<double>"
    filled = evidence.select("page_id", "doc_id", "text", "is_html", *[F.coalesce(c, F.lit("")).alias(c) for c in names[2:]])
    rows = space.table(filled.mapInArrow(run, schema), "likelihoods")
    k = len(languages)
    total = _shares(rows, [], languages).first()["n"] or [0.0] * k
    overall = [((x or 0.0) + 1) / (sum(y or 0.0 for y in total) + k) for x in total]
    prior = F.array(*map(F.lit, overall))
    add = lambda column: F.aggregate(column, F.lit(0.0), lambda a, x: a + x)
    leaning = lambda counts, base: F.zip_with(counts, base, lambda x, p: (x + lean * p) / (add(counts) + lean))
    domains = _shares(rows, ["domain"], languages).select("domain", leaning(F.col("n"), prior).alias("p"))
    hosts = _shares(rows, ["domain", "host"], languages, F.count("*").alias("rows")).join(domains, "domain")
    hosts = hosts.select("domain", "host", leaning(F.col("n"), F.col("p")).alias("prior"), "rows")
    # how likely a declared language or suffix is, given the language
    def likely(column, name):
        n = _shares(rows.where(F.col(column) != ""), [column], languages)
        kinds = F.lit(1.0) * n.count()
        sums = [x or 0.0 for x in (_shares(n.withColumn("soft", F.col("n")), [], languages).first()["n"] or [0.0] * k)]
        return n.select(column, F.array(*[(F.col("n")[i] + 1.0) / (F.lit(sums[i]) + kinds + 1.0) for i in range(k)]).alias(name))

    # one host may hold a third of all rows: those of hot hosts stay where they are, the few priors are broadcast
    hosts = space.table(hosts, "hosts")
    rows = join_hot(rows, hosts, ["domain", "host"], "rows")
    rows = rows.join(likely("markup", "m"), "markup", "left").join(likely("suffix", "s"), "suffix", "left")
    score = F.zip_with("logs", F.coalesce("prior", prior), lambda a, p: a + F.log(p))
    for name in ("m", "s"):
        score = F.when(F.col(name).isNull(), score).otherwise(F.zip_with(score, F.col(name), lambda a, p: a + F.log(p)))
    rows = rows.select("page_id", "doc_id", score.alias("score"))
    best = F.array_max("score")
    return rows.select(
        "page_id", "doc_id",
        F.element_at(F.array(*map(F.lit, languages)), F.array_position("score", best).cast("int")).alias("lang"),
        F.round(1.0 / add(F.transform("score", lambda x: F.exp(x - best))), 6).alias("confidence"),
    )
