"""Syntax of brace languages without a parser: tokens, brackets and blocks.

The text of a hunk becomes rows of tokens; strings and comments are single
tokens, so nothing inside them counts. Every token learns its depth from a
running count of brackets and its owner, the bracket it stands in. Among the
tokens of one owner an opening bracket is followed at once by its partner, as
what stands between them has another owner. So a block is a row, with the tokens
before it and those directly inside it as one string, its ``sig``, and a rule on
its shape is a pattern on that string.

Brackets that don't pair up make no block; the rest of the hunk is read as usual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import rules as R
from ..functions import text as T
from ..sources.tables import stored

KEYS = ("scan_id", "file_idx", "hunk_idx")
MOST_FILES, MOST_HUNKS, MOST_PIECES, MOST_CHARS = 5, 5, 50, 5000  # of a change set; of a hunk; all can be switched off
LEAST_ADDED, LEAST_PIECE = 5, 15
#: Comments, strings, templates, arrows, names, numbers, line ends, single characters.
TOKEN = (
    r"/\*[\s\S]*?\*/|//[^\n]*|'[^'\\\n]*(?:\\[^\n][^'\\\n]*)*'|\"[^\"\\\n]*(?:\\[^\n][^\"\\\n]*)*\"|`[^`\\]*(?:\\[\s\S][^`\\]*)*`"
    r"|=>|\?\.|\.\.\.|[A-Za-z_$][A-Za-z0-9_$]*|[0-9][A-Za-z0-9_.]*|\n|[^ \t\n\x0B\f\r]"
)
STRING = '""'  # how a string stands in a ``sig``
BEFORE = 6  # tokens before a bracket that rules may look at
NOT_FUNCTIONS = ("if", "for", "while", "switch", "catch", "with")
NOT_EXPRESSIONS = "return|throw|if|for|const|let|var|while|switch|try|do|function|class|break|continue|debugger|import|export|async function|\\{"
#: What carries a statement over the end of a line, before it and after it, and over a closing brace.
CARRIES = (r"([,(\[{.=+*/&|?:<>!%^~-]) \n", r"\n ([)\]}.,;=+*/&|?:<>%^({\[-]|\?\.|(?:catch|finally|else|instanceof|in|as)(?: |$))", r"\} ([;,).(\[=&|?:+*/<>-]|\?\.|(?:catch|finally|else|while)(?: |$))")
# fixed values: what a condition that skips mentions
SKIPS = r"skip|SKIP|disable|DISABLE|bypass|BYPASS|mock"
CHAIN = r"[A-Za-z0-9_$]+(?: \. [A-Za-z0-9_$]+| \( \)| \[ \])"
#: Conditions that are one call, member access or unary expression.
SIMPLE_CONDITION = rf"^(?:(?:!|-|~|\+|typeof|void|delete) [A-Za-z0-9_$!({{\[\"-].*|{CHAIN}+)$"
FUNCTION_TRY = r"^try \{ \} catch (?:\( \) )?\{ \}(?: finally \{ \})?$"


def tokens(code: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, tok, line, level, owner) of the tokens of ``code``, without
    comments; ``line`` counts from 0, ``owner`` is the position of the bracket
    a token stands in, null outside of all. A null text has none."""
    rows = code.select(*keys, F.posexplode(F.regexp_extract_all("code", F.lit(TOKEN), 0)).alias("pos", "tok"))
    before = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    breaks = F.char_length("tok") - F.char_length(F.replace(F.col("tok"), F.lit("\n"), F.lit("")))
    opens, closes = F.col("tok").isin("(", "[", "{"), F.col("tok").isin(")", "]", "}")
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    rows = rows.withColumns({"line": so_far(breaks), "level": so_far(opens.cast("int") - closes.cast("int")) - closes.cast("int")})
    rows = rows.where("tok <> '\n' AND NOT startswith(tok, '//') AND NOT startswith(tok, '/*')")
    rows = rows.withColumn("tok", F.when(F.substring("tok", 1, 1).isin("'", '"', "`") & (F.char_length("tok") > 1), STRING).otherwise(F.col("tok")))
    # an opening bracket stands at its own level, and marks where the next one begins
    own = lambda level, mark: F.struct(level.alias("level"), mark.alias("mark"))
    here, mark = F.array(own(F.col("level"), F.lit(None).cast("int"))), F.array(own(F.col("level") + 1, F.col("pos")))
    each = rows.withColumn("l", F.explode(F.when(opens, F.concat(here, mark)).otherwise(here))).select(*keys, "pos", "tok", "line", "l.level", "l.mark")
    owner = F.last("mark", ignorenulls=True).over(W.partitionBy(*keys, "level").orderBy("pos"))
    return each.withColumn("owner", owner).where("mark IS NULL").drop("mark")


def blocks(toks: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, close_pos, tok, owner, line, end_line, p1.., l1.., sig) of the pairs of
    brackets: ``p1`` is the token before the opening one and ``l1`` its line,
    up to ``BEFORE``; ``sig`` are the tokens directly inside, with line ends."""
    beside = W.partitionBy(*keys, "owner").orderBy("pos")
    fresh = F.coalesce(F.col("line") > F.lag("line").over(beside), F.lit(False))
    seen = toks.withColumns({"fresh": fresh, "close": F.lead("tok").over(beside), "close_pos": F.lead("pos").over(beside), "end_line": F.lead("line").over(beside)} | {f"{p}{n}": F.lag(c, n).over(beside) for n in range(1, BEFORE + 1) for p, c in (("p", "tok"), ("l", "line"))})
    part = F.concat(F.when(F.col("fresh"), "\n ").otherwise(""), F.col("tok"))
    sigs = seen.where("owner IS NOT NULL").groupBy(*keys, F.col("owner").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("t")))), lambda x: x["t"]), " ").alias("sig"))
    paired = F.element_at(F.create_map(*(F.lit(x) for x in "()[]{}")), F.col("tok")) == F.col("close")
    found = seen.where(F.col("tok").isin("(", "[", "{") & paired)
    return found.join(sigs, [*keys, "pos"], "left").withColumn("sig", F.coalesce("sig", F.lit("")))


def statements(sig: Column) -> Column:
    """How many statements stand directly in a block."""
    for pattern, to in zip(CARRIES, ("$1", "$1", "}~$1"), strict=True):
        sig = F.regexp_replace(sig, pattern, to)
    return F.size(F.filter(F.split(sig, r";|\n|\} "), lambda x: F.trim(x) != ""))


def added_code(lines: DataFrame, most_files: int | None = MOST_FILES, most_hunks: int | None = MOST_HUNKS, most_pieces: int | None = MOST_PIECES, most_chars: int | None = MOST_CHARS, least_added: int = LEAST_ADDED) -> DataFrame:
    """(keys, path, importance, code, nos): the added lines of hunks of test
    files, without pieces too short to hold anything; ``nos`` are their line
    numbers. Change sets of more files, and hunks beyond the first few or in
    more pieces, are passed over, and code is cut, unless switched off by None.
    Hunks of fewer than ``least_added`` added lines hold too little to judge."""
    rows = lines.where("NOT non_functional")
    if most_files is not None:
        first = F.row_number().over(W.partitionBy("scan_id", "file_idx").orderBy("hunk_idx", "line_idx")) == 1
        rows = rows.withColumn("first", first).withColumn("files", F.count_if("first").over(W.partitionBy("scan_id"))).where(f"files <= {most_files}")
    rows = rows.where("path <> '/dev/null' AND lang = 'javascript' AND marker = '+' AND raw NOT LIKE '+++%'").where(T.matches(F.col("path"), R.TEST_FILE))
    hunk = W.partitionBy(*KEYS)
    rows = rows.withColumns({"added": F.count("*").over(hunk), "piece": F.col("line_idx") - F.row_number().over(hunk.orderBy("line_idx"))}).where(f"added >= {least_added}")
    line = F.struct("line_idx", "line_no", "body")
    pieces = rows.groupBy(*KEYS, "path", "importance", "piece").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    pieces = pieces.withColumn("long", F.char_length(T.trim(F.array_join("ls.body", "\n"))) > LEAST_PIECE)
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.when(F.col("long"), F.struct("piece", "ls")))), lambda x: x["ls"]))
    hunks = pieces.groupBy(*KEYS, "path", "importance").agg(whole.alias("ls"), F.count("*").alias("pieces"))
    if most_hunks is not None:
        hunks = hunks.withColumn("n", F.row_number().over(W.partitionBy("scan_id").orderBy("file_idx", "hunk_idx"))).where(f"n <= {most_hunks}")
    hunks = hunks.where(F.size("ls") > 0)
    code = F.array_join("ls.body", "\n")
    if most_pieces is not None:
        hunks = hunks.where(f"pieces <= {most_pieces}")
    return hunks.select(*KEYS, "path", "importance", (code if most_chars is None else F.substring(code, 1, most_chars)).alias("code"), F.col("ls.line_no").alias("nos"))


def syntax_findings(lines: DataFrame, **limits: int | None) -> DataFrame:
    """Functions with a trivial body, errors that are swallowed, conditions that
    are never true or skip, and empty defaults, in added code of tests."""
    # written, as tokens and findings both read it; a hunk's tokens stay where its text goes
    code = stored(added_code(lines, **limits))
    found = blocks(tokens(code.repartition(*KEYS), *KEYS), *KEYS)
    p = lambda n: F.col(f"p{n}")
    flat = F.replace(F.col("sig"), F.lit("\n "), F.lit(""))
    brace, paren = F.col("tok") == "{", F.col("tok") == "("
    name = lambda c: F.rlike(c, F.lit(r"^[A-Za-z_$]")) & ~c.isin(*NOT_FUNCTIONS)
    plain = (p(1) == ")") & (p(2) == "(") & name(p(3))
    typed = (p(2) == ":") & (p(3) == ")") & (p(4) == "(") & name(p(5))  # with the type of its result
    is_function = F.coalesce(brace & ((p(1) == "=>") | plain | typed), F.lit(False))
    is_catch = F.coalesce(brace & (((p(1) == "catch") & (p(4) == "try")) | ((p(1) == ")") & (p(3) == "catch") & (p(6) == "try"))), F.lit(False))
    n = statements(F.col("sig"))
    found = found.withColumns({"flat": flat, "n": n, "is_function": is_function, "is_catch": is_catch})
    found = stored(found.withColumn("silent", F.col("is_catch") & (F.col("n") <= 1)))
    # what a block's own children say
    inside = found.groupBy(*KEYS, F.col("owner").alias("pos")).agg(F.max("silent").alias("holds_silent"))
    found = found.join(inside, [*KEYS, "pos"], "left")
    default = F.regexp_extract("sig", r"(?s)(?:^|\n |[;}] )default :(.*)$", 1)
    rest = F.regexp_replace(default, r"(?s)(?:^|\n |[;}] | )case .*$", "")
    has_default = F.rlike("sig", F.lit(r"(?:^|\n |[;}] )default :"))
    expression = ~F.rlike("flat", F.lit(rf"^(?:{NOT_EXPRESSIONS})(?: |$)"))
    trivial = F.regexp_extract("flat", r"^return (true|false|null|undefined)(?: ;)?$", 1)
    lone = F.rlike("flat", F.lit(r"^[A-Za-z_$][A-Za-z0-9_$]*(?: ;)?$")) & ~F.rlike("flat", F.lit(r"^(?:return|break|continue|debugger|this|true|false|null|super)(?: |$)"))
    hit = lambda no, cond, kind, conf, line, text: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(no).alias("no"), F.lit(kind).alias("kind"), F.lit(conf).alias("confidence"), line.alias("line"), F.concat(*text).alias("text")))
    line, try_line = F.col("line"), F.when(p(1) == "catch", F.col("l4")).otherwise(F.col("l6"))
    at = lambda c: F.get("nos", c).cast("string")
    hits = [
        hit(0, F.col("is_function") & (trivial != ""), "trivial_function", "high", line, (F.lit("Function at line "), at(line), F.lit(" returns "), trivial, F.lit(" unconditionally."))),
        hit(1, F.col("is_function") & F.rlike("flat", F.lit(FUNCTION_TRY)) & F.col("holds_silent"), "async_gutted", "high", line, (F.lit("Function at line "), at(line), F.lit(" wraps logic in try/catch with no error handling."))),
        hit(2, F.col("is_function") & ((F.col("flat") == "") | lone), "empty_test_shell", "medium", line, (F.lit("Function at line "), at(line), F.lit(" has no meaningful body."))),
        hit(3, F.col("is_catch") & ((F.col("n") == 0) | ((F.col("n") == 1) & expression)), "async_gutted", "high", try_line, (F.lit("Try/catch at line "), at(try_line), F.when(F.col("n") == 0, " has empty catch body.").otherwise(" has comment-only catch body."))),
        hit(4, paren & (p(1) == "if") & (F.col("flat") == "false"), "conditional_wrap", "high", line, (F.lit("if(false) block at line "), at(line))),
        hit(5, paren & (p(1) == "if") & F.rlike("flat", F.lit(r"^0+(?:\.0*)?$")), "conditional_wrap", "high", line, (F.lit("if(0) block at line "), at(line))),
        hit(6, paren & (p(1) == "if") & F.rlike("flat", F.lit(SIMPLE_CONDITION)) & F.rlike(F.substring("flat", 1, 80), F.lit(SKIPS)), "conditional_wrap", "medium", line, (F.lit("Conditional at line "), at(line), F.lit(": "), F.substring("flat", 1, 80))),
        hit(7, brace & (p(3) == "switch") & (p(1) == ")") & has_default & (statements(rest) <= 1), "conditional_wrap", "medium", line, (F.lit("Switch at line "), at(line))),
    ]
    each = found.join(code.select(*KEYS, "path", "importance", "nos"), list(KEYS)).select(*KEYS, "path", "importance", "nos", "pos", "end_line", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("h"))
    pattern = F.when(F.col("h.kind") == "async_gutted", "silent_catch_and_pass").otherwise("disabled_assertion")
    return each.select(
        "scan_id", F.lit(R.DETECTORS.index("syntax")).alias("det"), "file_idx", "hunk_idx", F.lit(0).alias("phase"), F.col("pos").cast("int").alias("i1"), F.col("h.no").alias("i2"), pattern.alias("pattern_type"), "path",
        F.get("nos", F.col("h.line")).cast("int").alias("line_start"), F.get("nos", F.col("end_line")).cast("int").alias("line_end"), F.col("h.confidence").alias("confidence"), F.col("h.kind").alias("kind"),
        F.substring("h.text", 1, 200).alias("evidence"), "importance",
    )


def registered_matchers(lines: DataFrame) -> DataFrame:
    """(scan_id, names): all names inside the object that ``expect.extend(...)``
    is given, in hunks that add such a call. Names in strings, in comments and
    outside of the object's braces, which may be nested, don't count."""
    mentions = F.max(((F.col("marker") == "+") & F.col("body").contains("expect.extend")).cast("int")).over(W.partitionBy(*KEYS))
    rows = lines.where("marker <> '-'").withColumn("mentions", mentions).where("mentions = 1")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_idx", "body"))), lambda x: x["body"]), "\n")
    toks = tokens(rows.groupBy(*KEYS).agg(text.alias("code")), *KEYS)
    found = blocks(toks, *KEYS)
    calls = found.where("tok = '(' AND p1 = 'extend' AND p2 = '.' AND p3 = 'expect'").select(*KEYS, F.col("pos").alias("owner"))
    objects = found.where("tok = '{' AND p1 IS NULL").join(calls, [*KEYS, "owner"]).select(*KEYS, F.col("pos").alias("start"), F.col("close_pos").alias("end"))
    names = toks.where(F.rlike("tok", F.lit(r"^[A-Za-z_$]"))).join(objects, list(KEYS)).where("pos > start AND pos < end")
    return names.groupBy("scan_id").agg(F.collect_set("tok").alias("names"))
