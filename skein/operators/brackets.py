"""Source texts of brace languages as tables of tokens with matched brackets: units, calls and structural patterns.

Nothing here walks a text. A text is cut into tokens by one regular expression; sums of openings less closings
give each token its depth; the last opening of a depth is what encloses the tokens of that depth that follow, and
the next bracket of the same depth closes it. Tokens that have one enclosing bracket are siblings: ``fn f(a) { b }``
has the siblings ``fn``, ``f``, ``(``, ``)``, ``{`` and ``}``, so what a grammar says about them is said by a few
neighbours in that order. Units and calls take them from one pass over the tokens of a file (``siblings``), as a window
holds all rows of its group; ``bracket_table`` has every token.

Not told apart, for want of a grammar: regular expressions of scripts (their brackets count), nested block comments,
call-like patterns of Rust (counted as calls), attributes of C# before a unit (not part of it).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import Workspace, ship, union

from . import matching as M
from . import siblings as S
from .joins import resolve
from .siblings import CLASSES, CLOSE, CONTINUED, CONTINUES, HEADS, MODIFIERS, OPEN, SCRIPTS, TYPED

LANGUAGES = ("rust", "go", *SCRIPTS, *CLASSES)
_TEXT = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'
_COMMENT = r"//[^\n]*+|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
_QUOTED = {
    "rust": r'b?r#"(?:[^"]|"(?!#))*+"#|b?r"[^"]*+"|b?' + _TEXT + r"|b?'(?:[^'\\\n]|\\[^\n']{1,10}|\\')'|'[A-Za-z_]\w*+",
    "go": _TEXT + r"|`[^`]*+`|'(?:[^'\\\n]|\\[^\n]{1,9}?)'",
    "csharp": r'\$?@"[^"]*+(?:""[^"]*+)*+"|\$?' + _TEXT + r"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'",
    "java": r'"""[\s\S]*?"""|' + _TEXT + r"|'(?:[^'\\\n]|\\[^\n]{1,9}?)'",
}
_SCRIPT = _TEXT + r"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
_REST = r"\s++|[\p{L}_$][\p{L}\p{N}_$]*+|\p{N}[\p{L}\p{N}_]*+|=>|->|::|\?\.|\.\.\.|[\s\S]"
_UNSEEN = r"^(?:\s|//|/\*)"
#: How many tokens are cut from a text at once.
RUN = 256
_NOT_CALLED = (
    "if", "while", "for", "switch", "match", "catch", "return", "fn", "func", "function", "super", "this", "synchronized", "lock", "using", "fixed", "foreach", "typeof", "sizeof", "nameof",
    "in", "await", "async", "throw", "else", "do", "try", "let", "const", "var", "new", "case", "yield", "interface", "struct", "chan", "where", "loop", "move", "impl", "pub", "Fn", "FnMut", "FnOnce",
)


def _pattern(language: Column) -> Column:
    out = F.lit(f"{_COMMENT}|{_SCRIPT}|{_REST}")
    for name, quoted in _QUOTED.items():
        out = F.when(language == name, F.lit(f"{_COMMENT}|{quoted}|{_REST}")).otherwise(out)
    return out


def _following(condition: Column, value: Column, first: int = 1) -> Column:
    """The value at the nearest sibling from ``first`` places on that meets the condition.

    Asked backwards: a frame that grows is kept up row by row, one that shrinks is read anew for every row.
    """
    back = Window.partitionBy("path", "parent").orderBy(F.desc("n"))
    return F.last(F.when(condition, value), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -first))


def byte_blocks(files: DataFrame, size: int = 2048) -> DataFrame:
    """(path, block, data): the bytes of texts in blocks of ``size``, so that a place is looked up without its whole text."""
    cut = files.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\s\S]{1,%d}" % size), F.lit(0))).alias("k", "t")).select("path", "k", F.col("t").cast("binary").alias("t"))
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("s", F.coalesce(F.sum(F.length("t")).over(before), F.lit(0)))
    cut = cut.select("path", "s", "t", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.col("s") + F.length("t") - 1) / size))).alias("block"))
    low, high = F.greatest(F.col("s"), F.col("block") * size), F.least(F.col("s") + F.length("t"), (F.col("block") + 1) * size)
    cut = cut.select("path", "block", "s", F.substring("t", (low - F.col("s") + 1).cast("int"), (high - low).cast("int")).alias("t"))
    return cut.groupBy("path", "block").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("s", "t"))), F.lit(b""), lambda acc, x: F.concat(acc, x["t"])).alias("data"))


def texts_at(spans: DataFrame, files: DataFrame, start: Column, end: Column, size: int = 2048) -> DataFrame:
    """Adds ``cut``, the text between two bytes of the file ``path``; the other columns tell the spans apart."""
    names = spans.columns
    low, high = F.col("_from"), F.greatest(F.col("_from"), F.col("_to"))
    rows = spans.withColumns({"_from": start.cast("long"), "_to": end.cast("long")})
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(low / size), F.floor(F.greatest(low, high - 1) / size))))
    rows = rows.join(byte_blocks(files, size), ["path", "block"], "left")
    first, last = F.greatest(low, F.col("block") * size), F.least(high, (F.col("block") + 1) * size)
    part = F.substring("data", (first - F.col("block") * size + 1).cast("int"), (last - first).cast("int"))
    whole = F.aggregate(F.array_sort(F.collect_list(F.struct("block", F.coalesce(part, F.lit(b"")).alias("t")))), F.lit(b""), lambda acc, x: F.concat(acc, x["t"]))
    return rows.groupBy(*names).agg(whole.cast("string").alias("cut"))


def _runs(files: DataFrame) -> DataFrame:
    """(path, language, run, text): a run of tokens cut alone gives the same tokens, and no array holds those of a whole text."""
    runs = F.regexp_extract_all("text", F.concat(F.lit("(?:"), _pattern(F.col("language")), F.lit(f"){{1,{RUN}}}+")), F.lit(0))
    return files.where(F.col("language").isin(*LANGUAGES)).select("path", "language", F.posexplode(runs).alias("run", "text"))


def siblings(files: DataFrame) -> DataFrame:
    """Names of files (path, language, text) that may be heads, members or calls, with what their siblings say (``siblings.SIBLINGS``)."""
    ship(files.sparkSession)
    tokens = F.regexp_extract_all("text", _pattern(F.col("language")), F.lit(0))
    return S.in_order(_runs(files), "run").select("path", "language", tokens.alias("tokens")).mapInArrow(S.siblings, S.SIBLINGS)


def bracket_table(files: DataFrame, only_brackets: bool = False) -> DataFrame:
    """(path, language, n, token, kind, start, end, line, last_line, depth, parent, close, i, size) from (path, language, text).

    ``n`` numbers the tokens of a file without white space and comments; ``start`` and ``end`` are bytes; ``parent`` is the ``n`` of the
    opening bracket around a token (-1 at the top), ``close`` that of the bracket that closes an opening one, ``i`` the place
    among the ``size`` siblings. A null text has no tokens. With ``only_brackets`` other tokens are left out before anything is sorted,
    but for one of each run of ``RUN`` tokens, so that no file is lost; ``n``, ``i``, ``size``, ``start`` and lines then say nothing.
    """
    token, per_file = F.col("token"), Window.partitionBy("path").orderBy("run", "pos")
    before = per_file.rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.regexp_extract_all("text", _pattern(F.col("language")), F.lit(0))
    if only_brackets:
        seen = F.filter(tokens, lambda x: ~x.rlike(_UNSEEN))
        tokens = F.concat(F.slice(seen, 1, 1), F.filter(F.slice(seen, 2, RUN), lambda x: x.isin(*OPEN, *CLOSE)))
    rows = _runs(files).select("path", "language", "run", F.posexplode(tokens).alias("pos", "token")).repartition("path")
    newlines = F.length(token) - F.length(F.replace(token, F.lit("\n"), F.lit("")))
    start, line = F.coalesce(F.sum(F.octet_length(token)).over(before), F.lit(0)), 1 + F.coalesce(F.sum(newlines).over(before), F.lit(0))
    rows = rows.select("path", "language", "run", "pos", "token", start.alias("start"), line.alias("line"), newlines.alias("more"))
    rows = rows.where(~token.rlike(_UNSEEN))
    kind = F.when(token.isin(*OPEN), "open").when(token.isin(*CLOSE), "close").when(token.rlike(r"^(?:[\p{L}_$][\p{L}\p{N}_$]*)$"), "name").when(token.rlike(r"^(?:[\"'`]|[br$@]{1,2}[#\"'])"), "text").otherwise("other")
    rows = rows.select("path", "language", (F.row_number().over(per_file) - 1).alias("n"), "token", kind.alias("kind"), "start", (F.col("start") + F.octet_length(token)).alias("end"), "line", (F.col("line") + F.col("more")).alias("last_line"))
    by_place = Window.partitionBy("path").orderBy("n")
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    rows = rows.withColumn("inner", F.sum(step).over(by_place) + F.when(F.col("kind") == "close", 1).otherwise(0))
    bracket = F.col("kind").isin("open", "close")
    rows = rows.withColumn("depth", F.when(bracket, F.col("inner") - 1).otherwise(F.col("inner")))
    # an opening bracket stands twice: among its siblings, and as what encloses the tokens one deeper
    roles = F.when(F.col("kind") == "open", F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("own")), F.struct(F.col("inner").alias("level"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("depth").alias("level"), F.lit(True).alias("own"))))
    rows = rows.select("*", F.explode(roles).alias("role")).select("*", "role.level", "role.own").drop("role", "inner")
    in_level = Window.partitionBy("path", "level").orderBy("n", "own")
    rows = rows.withColumn("parent", F.coalesce(F.last(F.when(~F.col("own"), F.col("n")), ignorenulls=True).over(in_level), F.lit(-1)))
    rows = rows.where("own").drop("own", "level")
    siblings = Window.partitionBy("path", "parent").orderBy("n")
    # the closing bracket is the next sibling of the one that it closes
    close = F.when((F.col("kind") == "open") & (F.lead("kind").over(siblings) == "close"), F.lead("n").over(siblings))
    rows = rows.withColumn("close", close).withColumn("i", F.row_number().over(siblings) - 1)
    return rows.withColumn("size", F.count("*").over(Window.partitionBy("path", "parent")))


def balance(table: DataFrame) -> DataFrame:
    """(path, balanced): whether every bracket of a file has its partner, of its own kind."""
    partner = F.lead("token").over(Window.partitionBy("path", "parent").orderBy("n"))
    fits = F.concat("token", partner).isin("()", "[]", "{}")
    rows = table.select("path", "depth", F.when(F.col("kind") == "open", F.coalesce(fits, F.lit(False))).otherwise(True).alias("fits"), F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0).alias("step"))
    return rows.groupBy("path").agg((F.min("fits") & (F.sum("step") == 0) & (F.min("depth") >= 0)).alias("balanced"))


def _with_neighbours(table: DataFrame) -> DataFrame:
    """What a token's siblings say: the tokens around it, whether it begins a line, where its statement and its body end."""
    s = Window.partitionBy("path", "parent").orderBy("n")
    token, language = F.col("token"), F.col("language")
    rows = table
    for k in (1, 2, 3, 4):
        rows = rows.withColumns({f"prev{k}": F.lag("token", k).over(s), f"next{k}": F.lead("token", k).over(s)})
    rows = rows.withColumns({"next_kind": F.lead("kind").over(s), "next_n": F.lead("n").over(s)})
    rows = rows.withColumn("begins", F.lag("last_line").over(s).isNull() | ((F.col("kind") != "close") & (F.col("line") > F.lag("last_line").over(s)) & ~token.isin(*CONTINUES) & ~F.col("prev1").isin(*CONTINUED)))
    # a brace after these belongs to a type
    typed = F.col("prev1").isin(*TYPED) & ~(language == "rust")
    body = (token == "{") & ~F.coalesce(typed, F.lit(False))
    rows = rows.withColumns({
        "stop": _following(body | (token == ";"), F.struct("n", "token", "close", "start", "end")),
        "semicolon": _following(token == ";", F.struct("n", "end")),
        "next_line": _following(F.col("begins"), F.col("i")),
        "next2_start": F.lead("start", 2).over(s),
    })
    # words before a unit that belong to it run up to it without a break
    pub = (F.col("prev1") == "pub") & (token == "(") | (F.col("prev2") == "pub") & (token == ")")
    belongs = F.when(language == "rust", token.isin(*MODIFIERS["rust"]) | F.coalesce(pub, F.lit(False)) | ((F.col("prev1") == "extern") & (F.col("kind") == "text"))).when(language.isin(*CLASSES), ~token.isin(";", "}", "{")).otherwise(token.isin(*MODIFIERS["script"]))
    run = F.coalesce(F.sum(F.when(F.coalesce(belongs, F.lit(False)), 0).otherwise(1)).over(s.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("run", run)
    first = Window.partitionBy("path", "parent", "run").orderBy("n")
    return rows.withColumns({"run_start": F.first("start").over(first), "run_line": F.first("line").over(first)})


def _siblings_of(files: DataFrame, table: DataFrame | None, space: Workspace) -> DataFrame:
    """The table if it is one of ``siblings``, else such a table of the files."""
    return table if table is not None and "opened_end" in table.columns else space.table(siblings(files), "siblings")


def units(files: DataFrame, table: DataFrame | None = None, signatures: bool = True) -> DataFrame:
    """(path, unit, kind, name, start_byte, end_byte, start_line, end_line, parent, signature, head, body), numbered in the order of their starts.

    ``parent`` is the innermost unit around a unit, ``head`` and ``body`` are numbers of tokens. The signature is what stands before the body, of at most 2048 bytes;
    of units without a body the first 512. Without ``signatures`` that column is left out and no text is read for it.
    """
    space = Workspace(files.sparkSession, "units")
    rows = _siblings_of(files, table, space)
    token, language, name = F.col("token"), F.col("language"), F.col("next1")
    kind = F.lit(None).cast("string")
    for lang, heads in HEADS.items():
        for word, what in heads.items():
            kind = F.when((language == lang) & (token == word), what).otherwise(kind)
    named = F.col("named")
    receiver = (language == "go") & (token == "func") & (F.col("parent") == -1) & (F.col("next1") == "(") & (F.col("next4") == "(")
    star = language.isin(*SCRIPTS) & (token == "function") & (F.col("next1") == "*")
    heads = rows.withColumn("what", F.when(receiver, "method").otherwise(kind)).where("what IS NOT NULL").where(named | receiver | star)
    # words that only look like heads: ``const fn``, ``*const T``, ``A.class``, abstract classes and expressions of scripts
    prev = F.coalesce(F.col("prev1"), F.lit(";"))
    heads = heads.where(~((token == "const") & (name.isin("fn", "unsafe", "async", "extern") | prev.isin("<", ",", "*", "("))) & ~prev.isin(".", "?.", "::", "@"))
    heads = heads.where(~language.isin(*SCRIPTS) | ((F.col("begins") | prev.isin(";", "{", "}", ")", "export", "default", "async", "declare")) & (prev != "abstract")))
    heads = heads.where(~(language.isin(*SCRIPTS) & (token == "type") & ~F.col("next2").isin("=", "<")))
    called = F.when(receiver, F.col("next3")).when(star, F.col("next2")).otherwise(name)
    has_body = (F.col("stop_token") == "{") & ~F.col("what").isin("constant", "schema")
    go_type = (language == "go") & (token == "type")
    fields = (token == "struct") & ~has_body & (F.col("next2") == "(")
    place = lambda start, line: F.struct(F.col(start).alias("s"), F.col(line).alias("l"))
    start = F.when(go_type, place("next_start", "next_line")).when(language.isin("rust", *CLASSES) | ((language.isin(*SCRIPTS)) & (token == "function")), place("run_start", "run_line")).otherwise(place("start", "line"))
    heads = heads.where(F.when(F.col("what").isin("function", "method"), has_body).otherwise(True))
    # where a unit without a body ends: at its semicolon, or with its line
    semicolon, line = place("semicolon_end", "semicolon_row"), place("line_end", "line_row")
    until = F.when(has_body, place("stop_end", "stop_row")).when(language == "go", line).when(language.isin(*SCRIPTS), F.when(F.col("semicolon_n") < F.col("line_n"), semicolon).otherwise(line)).otherwise(semicolon)
    heads = heads.select("path", "language", "what", called.alias("name"), start.alias("from"), until.alias("to"), F.when(has_body, F.col("stop_n")).alias("body"), F.when(has_body, F.col("stop_start")).when(fields, F.col("next2_start")).alias("body_start"), F.col("n").alias("head"))
    found = space.table(heads.select("path", "language", "what", "name", F.col("from.s").alias("start_byte"), F.col("to.s").alias("end_byte"), F.col("from.l").alias("start_line"), F.col("to.l").alias("end_line"), "body", "body_start", "head").where("end_byte IS NOT NULL"), "heads")
    found = space.table(S.by_nesting(union(found, _members(rows, found)), "numbered"), "units")
    out = ["path", "unit", F.col("what").alias("kind"), "name", "start_byte", "end_byte", "start_line", "end_line", "parent", "head", "body"]
    if not signatures:
        return found.select(out)
    upto = F.least(F.coalesce("body_start", F.col("start_byte") + 512), "end_byte", F.col("start_byte") + 2048)
    signed = texts_at(found, files, F.col("start_byte"), upto).withColumn("signature", F.trim(F.regexp_replace("cut", r"\s+$", "")))
    return space.table(signed, "out").select(*out[:-2], "signature", *out[-2:])


def _members(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Methods: names before parentheses right inside the body of a class or interface."""
    bodies = heads.where(F.col("what").isin("class", "interface", "enum", "struct") & F.col("language").isin(*SCRIPTS, *CLASSES)).select(F.col("path").alias("_p"), F.col("body").alias("_b"), F.col("what").alias("owner"), F.col("name").alias("owner_name"))
    m = rows.where(F.col("next1").isin("(", "<") & F.col("stop_n").isNotNull()).join(bodies, (F.col("path") == F.col("_p")) & (F.col("parent") == F.col("_b"))).drop("_p", "_b")
    script, own = F.col("language").isin(*SCRIPTS), F.col("token") == F.col("owner_name")
    before = F.coalesce(F.col("prev1"), F.lit("{"))
    typed = F.col("prev1").rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$|^[>\]?]$") & ~F.col("prev1").isin("new", "return", "throw", "extends", "implements")
    made = own & before.isin("{", "}", ";", "public", "private", "protected", "internal", ")")
    has_body = F.col("stop_token") == "{"
    in_script = script & F.col("owner").isin("class", "interface") & (F.col("begins") | before.isin("{", "}", ";", *MODIFIERS["script"])) & ~before.isin("=", ".", "?.", ",", "@", "abstract", "new", "(")
    in_class = ~script & (F.col("next1") == "(") & F.coalesce(F.when(own, made & has_body).otherwise(typed), F.lit(False))
    m = m.where(in_script | in_class)
    end = F.when(script & ~has_body, F.col("stop_end") - 1).otherwise(F.col("stop_end"))  # a signature leaves out its semicolon
    return m.select("path", "language", F.lit("method").alias("what"), F.col("token").alias("name"), F.col("run_start").alias("start_byte"), end.alias("end_byte"), F.col("run_line").alias("start_line"), F.col("stop_row").alias("end_line"), F.when(has_body, F.col("stop_n")).alias("body"), F.when(has_body, F.col("stop_start")).alias("body_start"), F.col("n").alias("head")).where("end_byte IS NOT NULL")


def calls(files: DataFrame, table: DataFrame, found: DataFrame) -> DataFrame:
    """(path, caller, name, start_byte, end_byte): names before parentheses that aren't declared there, with the innermost unit around each.

    Made objects count by their class in Java and C#, not in scripts. A call starts at its name.
    """
    language, none = F.col("language"), F.lit(False)
    rows = _siblings_of(files, table, Workspace(files.sparkSession, "calls")).where("opened_end IS NOT NULL AND NOT attribute")
    reserved = F.col("token").isin(*_NOT_CALLED) & ~F.coalesce(F.col("prev1").isin(".", "?.", "::"), none)
    rows = rows.where(~reserved & ~F.coalesce((F.col("prev1") == "*") & (F.col("prev2") == "function"), none) & ~F.coalesce(F.col("prev1").isin("fn", "func", "function", "struct", "abstract", "@"), none))
    rows = rows.where(~F.coalesce((language == "go") & (F.col("prev1") == ")") & (F.col("prev3") == "func"), none) & ~F.coalesce(language.isin(*SCRIPTS) & (F.col("prev1") == "new"), none))
    values = found.where("kind = 'enum'").select("path", F.col("body").alias("parent"))  # values of an enumeration only look like calls
    rows = rows.join(values, ["path", "parent"], "left_anti").join(found.select("path", F.col("head").alias("n")), ["path", "n"], "left_anti")
    # calls are nested or apart, and so are calls and units: a call is placed by its start
    marks = union(
        found.select("path", F.col("start_byte").alias("at"), F.col("end_byte").alias("end"), "unit", F.lit(None).cast("string").alias("name")),
        rows.select("path", F.col("start").alias("at"), F.col("opened_end").alias("end"), F.lit(None).cast("int").alias("unit"), F.col("token").alias("name")),
    )
    return S.by_nesting(marks, "placed")


# --- structural patterns -----------------------------------------------------


def template_items(template: str) -> list:
    """A template as nested items: ``("token", x)``, ``("group", open, items)``, ``("one", name)`` and ``("many", name)``.

    ``$NAME`` and ``:[name]`` are one, ``$$$``, ``$$$NAME`` and ``...`` many. A bracket without a partner is an error.
    """
    holes = r":\[\w*\]|\.\.\.|\$\$\$[A-Z_][A-Z0-9_]*|\$\$\$|\$[A-Z_][A-Z0-9_]*"
    rest = _SCRIPT.replace("*+", "*").replace("++", "+") + r"|[^\W\d]\w*|\d\w*|=>|->|::|\?\.|\S"
    stack: list = [("", [])]
    for x in re.findall(f"{holes}|{rest}", template):
        if re.fullmatch(holes, x):
            many = x.startswith(("$$$", "..."))
            stack[-1][1].append(("many" if many else "one", re.sub(r"\W", "", x).upper()))
        elif x in OPEN:
            stack.append((x, []))
        elif x in CLOSE:
            opened, items = stack.pop()
            if opened == "" or OPEN.index(opened) != CLOSE.index(x):
                raise ValueError(f"{template}: {x!r} closes nothing")
            stack[-1][1].append(("group", opened, items))
        else:
            stack[-1][1].append(("token", x))
    if len(stack) > 1:
        raise ValueError(f"{template}: {stack[-1][0]!r} isn't closed")
    return stack[0][1]


def pattern_matches(files: DataFrame, template: str, table: DataFrame | None = None) -> DataFrame:
    """(path, start_byte, end_byte, match, names) of a template in files (path, language, text); ``names`` maps holes to their texts.

    Files without a word of the template are passed over first. A name that occurs twice must stand for the same tokens each time.
    """
    items = template_items(template)
    plain = re.sub(r":\[\w*\]|\$\$\$\w*|\$\w+|\.\.\.", " ", template)
    rows = files
    for word in sorted({w for w in re.findall(r"\w+", plain)}):
        rows = rows.where(F.contains("text", F.lit(word)))
    space = Workspace(files.sparkSession, "pattern")
    ship(files.sparkSession)
    if table is not None:
        rows = rows.join(table.select("path").distinct(), "path", "left_semi")
    tokens = F.regexp_extract_all("text", _pattern(F.col("language")), F.lit(0))
    found = space.table(M.matches(_runs(rows), tokens, items), "found")
    # the match is the first of its spans
    match = F.array(F.struct(F.lit("").alias("name"), F.col("start").alias("from"), F.col("end").alias("to"))).cast(M.SPANS)
    each = found.select("path", "at", "start", "end", F.posexplode(F.concat(match, "spans")).alias("k", "x")).select("path", "at", "start", "end", "k", "x.name", "x.from", "x.to")
    each = texts_at(each, rows, F.col("from"), F.col("to")).withColumn("text", F.regexp_replace("cut", r"^\s+|\s+$", ""))
    found = each.groupBy("path", "at", "start", "end").agg(F.array_sort(F.collect_list(F.struct("k", "name", "text"))).alias("all"))
    found = found.withColumn("bound", F.transform(F.slice("all", 2, F.size("all")), lambda x: F.struct(x["name"].alias("name"), x["text"].alias("text"))))
    named = F.filter("bound", lambda x: ~x["name"].isin("", "_"))
    squeezed = F.array_distinct(F.transform(named, lambda x: F.struct(x["name"], F.regexp_replace(x["text"], r"\s+", " "))))
    same = F.size(squeezed) == F.size(F.array_distinct(F.transform(named, lambda x: x["name"])))
    names = F.map_from_entries(F.aggregate(named, F.array().cast("array<struct<name:string,text:string>>"), lambda acc, x: F.when(F.exists(acc, lambda y: y["name"] == x["name"]), acc).otherwise(F.concat(acc, F.array(x)))))
    return found.where(same).select("path", F.col("start").alias("start_byte"), F.col("end").alias("end_byte"), F.col("all")[0]["text"].alias("match"), names.alias("names"))


# --- edges -------------------------------------------------------------------


def code_edges(found: DataFrame, called: DataFrame, *others: DataFrame) -> DataFrame:
    """(src, dst, kind, confidence) of units and their calls in one table, with edges of other kinds added as they are.

    A file or unit contains its units; a unit calls the best callable unit of the called name, of its own file first, at half the
    confidence where several have it. Units are named ``path#unit``.
    """
    name = lambda u: F.concat("path", F.lit("#"), F.col(u).cast("string"))
    inside = found.select(F.when(F.col("parent").isNull(), F.col("path")).otherwise(name("parent")).alias("src"), name("unit").alias("dst"), F.lit("contains").alias("kind"), F.lit(1.0).alias("confidence"))
    sites = called.where("caller IS NOT NULL").select(name("caller").alias("src"), "path", "name").distinct()
    sites = sites.withColumn("call_id", F.concat_ws("\x1f", "src", "name"))
    targets = found.where(F.col("kind").isin("function", "method")).select("name", name("unit").alias("target_id"), F.col("path").alias("there"))
    best = resolve(sites, targets, lambda here: F.when(here, 0).otherwise(1))
    calls_ = best.join(sites.select("call_id", "src"), "call_id").select("src", F.col("target_id").alias("dst"), F.lit("calls").alias("kind"), "confidence")
    return union(inside, calls_, *(o.select("src", "dst", "kind", "confidence") for o in others)).groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))
