"""Functions on query texts and symbol names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words (whole, lower case) and phrases (anywhere) that name an intent, in the order
#: in which intents are tried. Words of a pair count only together.
INTENTS = (
    ("precise_dataflow", ("taint", "taints"), ("source to sink", "source→sink", "污点", "用户输入", "shell 参数"), ()),
    (
        "history",
        ("history", "commit", "commits", "committed", "blame"),
        ("历史", "什么时候改", "何时改", "谁改", "提交"),
        (
            ("words", ("why",), ("added", "changed", "introduced", "removed", "deprecated", "renamed", "deleted", "modified", "reverted")),
            ("phrases", ("为什么", "为何"), ("修改", "改动", "引入", "添加", "删除", "重命名", "弃用")),
        ),
    ),
    ("impact", ("impact", "affected"), ("影响", "会破坏", "哪些地方会"), (("words", ("break", "breaks"), ("if", "when")),)),
    ("trace", ("trace", "traces", "lifecycle"), ("data movement", "调用链", "链路", "流向", "生命周期"), ()),
    ("architecture", ("architecture", "subsystem", "boundary", "responsibility"), ("架构", "模块", "职责", "边界"), ()),
    ("issue_localization", ("bug", "fail", "fails", "failure", "error", "broken", "occasionally"), ("错误", "失败", "偶发", "不生效"), ()),
)
#: What makes a query with some code-like token one for an exact entity.
ENTITY_WORDS = ("defined", "definition", "references", "implemented", "decided")
ENTITY_PHRASES = ("where is", "在哪定义", "谁引用", "在哪里", "定义", "引用")


def _words(text: Column, words: tuple) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}_]+"), F.array(*map(F.lit, words)))


def _phrases(text: Column, phrases: tuple) -> Column:
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))


def code_like(token: Column) -> Column:
    """Snake or camel case, a ``::`` path, or a name with a short ending."""
    return token.contains("_") | token.contains("::") | token.rlike(r"\p{Ll}\p{Lu}") | token.rlike(r"^.+\.[A-Za-z0-9]{1,5}$")


def intent(text: Column) -> Column:
    """The intent of a query; a null query has none."""
    out = None
    for name, words, phrases, pairs in INTENTS:
        test = _words(text, words) | _phrases(text, phrases)
        for kind, first, second in pairs:
            has = _words if kind == "words" else _phrases
            test = test | (has(text, first) & has(text, second))
        out = F.when(test, name) if out is None else out.when(test, name)
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    code = F.size(F.filter(tokens, code_like))
    exact = (F.size(tokens) > 0) & ((2 * code >= F.size(tokens)) | ((code > 0) & (_words(text, ENTITY_WORDS) | _phrases(text, ENTITY_PHRASES))))
    return F.when(text.isNotNull(), out.when(exact, "exact_entity").otherwise("natural_language_behavior"))


def identifier_parts(name: Column) -> Column:
    """Parts of an identifier in order, repeats included."""
    cut = F.regexp_replace(name, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.filter(F.split(F.lower(cut), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def name_witness(name: Column, term: str) -> Column:
    """Whether the folded term equals a run of neighbouring parts of the name."""
    parts, last = identifier_parts(name), F.size(identifier_parts(name))
    wanted = "".join(c for c in term.lower() if c.isalnum())
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda i: F.exists(F.sequence(F.lit(1), last - i + 1), lambda n: F.array_join(F.slice(parts, i, n), "") == wanted))


def perturbations(symbol: Column) -> Column:
    """One-edit look-alikes of a symbol as (op, probe): a plural, a cut, a doubled and a swapped end."""
    size = F.length(symbol)
    short = F.concat(symbol, F.lit("x"))
    swapped = F.concat(F.substring(symbol, F.lit(1), size - 2), F.right(symbol, F.lit(1)), F.substring(symbol, size - 1, F.lit(1)))
    probes = {
        "pluralize": F.concat(symbol, F.lit("s")),
        "truncate": F.when(size > 2, F.left(symbol, size - 1)).otherwise(short),
        "double-last": F.concat(symbol, F.right(symbol, F.lit(1))),
        "swap-last": F.when(size > 2, swapped).otherwise(short),
    }
    return F.array(*[F.struct(F.lit(op).alias("op"), probe.alias("probe")) for op, probe in probes.items()])
