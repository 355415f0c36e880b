"""Text cut off by field limits or in transfer.

Lengths of every reply are taken under several encodings (code points, UTF-8, UTF-16, JSON escapes, entity escapes,
CR LF line ends) and counted by source, apart for replies that seem finished and unfinished.  A length at which far more
different replies pile up than around it is a storage limit: those replies were cut there, also where the cut fell on the end of
a sentence.  Different means by their first and last characters, so that one template or one text delivered often is no limit.
Where nothing piles up, the ending decides: cut marks, open code fences, broken escapes, stops within a sentence, a word
or a path.  A copy of the same reply that goes on proves a cut as well; the counted length of the source does not, it is only
reported.  An open end in words that otherwise close replies may only lack its full stop: there a limit or a copy must confirm.

Defined results: null, blank and placeholder replies are not cut; a reply that only repeats its prompt is not cut; one that ends in
code, a path, a list or an emoji is whole, whatever its length; a closing remark that always ends in dots is whole; empty
tables yield no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm.dedup_ledger import squash
from tracelode.plans.skew import join_hot
from tracelode.plans.workspace import Workspace

# What stores write when nothing was said, as letters and digits only.
PLACEHOLDERS = ("", "na", "null", "none", "nil", "empty", "nooutput", "noresponse", "noreply", "noanswer", "nocontent", "undefined", "nan", "tbd", "blank", "emptyresponse", "emptyreply")

# White space and invisible characters.
_SPACE = "".join(map(chr, (*range(0x21), 0x7F, 0x85, 0xA0, 0xAD, 0x1680, *range(0x2000, 0x2010), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
_MARK = r"(?i)(?:\s*[\[(<]\s*(?:truncated|cut|cut off|clipped|snip|snipped|output truncated|\.\.\.|…)\s*[\])>]|…|\.\.\.|\x{FFFD}+|-{1,3}|–|—)$"
_CLOSER = "[)\\]\"”’»`'*_“]*"
_PATH = r"[^\s/]*/[^\s]*\.[A-Za-z0-9]{1,6}(?::\d+)*" + "[)`\"']*"


def body(text: Column) -> Column:
    """The text without white space and invisible characters at its ends."""
    return F.btrim(text, F.lit(_SPACE))


def without_mark(t: Column) -> Column:
    """A body without the cut mark at its end; only the end is searched."""
    return F.concat(F.substring(t, F.lit(1), F.greatest(F.length(t) - 40, F.lit(0))), F.regexp_replace(F.right(t, F.lit(40)), _MARK, ""))


def says_nothing(reply: Column) -> Column:
    """Null, or nothing but a placeholder, punctuation or white space; only texts that could be one are looked at closely."""
    squashed = F.when(F.length(reply) < 40, squash(reply)).when(~reply.rlike(r"[\p{L}\p{N}]"), "")
    return reply.isNull() | F.coalesce(squashed.isin(*PLACEHOLDERS), F.lit(False))


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def lengths(text: Column) -> dict[str, Column]:
    """A text's length in the units in which stores set limits."""
    newlines = count_of(text, "\n") - F.floor((F.length(text) - F.length(F.replace(text, F.lit("\r\n"), F.lit("")))) / 2)
    return {
        "code_points": F.length(text),
        "utf8": F.octet_length(text),
        "utf16": F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]+", "")),
        "json": F.length(text) + count_of(text, "\"\\\n\r\t"),
        "entities": F.length(text) + 4 * count_of(text, "&'") + 3 * count_of(text, "<>") + 5 * count_of(text, '"'),
        "crlf": F.length(text) + newlines,
    }


#: An ending shows within this many code points; patterns that look for it needn't walk over the whole text.
_END = 240


def ending(t: Column, copies_prompt: Column) -> Column:
    """How a body ends: whole, mark, dots, fence, escape, path, list or open."""
    end = F.right(t, F.lit(_END))
    fences = F.length(t) - F.length(F.replace(t, F.lit("```"), F.lit("")))
    last_line = F.substring_index(F.replace(t, F.lit("\r"), F.lit("\n")), "\n", -1)
    is_list = last_line.rlike(r"^\s*(?:[-*•+]|\d+[.)])\s+\S") & (F.size(F.split(F.trim(last_line), r"\s+")) <= 5)
    half_path = F.right(last_line, F.lit(_END)).rlike(r"/[^\s.]*$")
    before_path = rf"[.!?:…]{_CLOSER}\s+|\n\s*(?:[-*•+]\s+)?"
    path = F.when(F.length(t) <= _END, end.rlike(rf"(?:^|{before_path}){_PATH}$")).otherwise(end.rlike(rf"(?:{before_path}){_PATH}$"))
    return (
        F.when(copies_prompt, "whole")
        .when((fences % 6) == 3, "fence")
        .when(end.endswith("…") | end.endswith("..."), "dots")
        .when(end.rlike(_MARK), "mark")
        .when(end.rlike(r"(?:\\|\\u[0-9a-fA-F]{0,3}|&#?[A-Za-z0-9]{1,6})$"), "escape")
        .when(end.rlike(r"(?:^|\s)[^\s]*/[^\s.]*\.$"), "open")
        .when(end.rlike(rf"[.!?。！？؟]{_CLOSER}$") | end.rlike(r"(?:```|[`}};])$") | end.rlike(r"[\p{So}\p{Sk}\x{FE0F}\x{200D}]$"), "whole")
        .when(path, "path")
        .when(is_list & ~half_path, "list")
        .otherwise("open")
    )


_DOTTED = r"(?:^|[.!?…][\"”’»)]*\s+|\n)([^.!?…\n]*)(?:\.\.\.|…)$"
_LAST_WORDS = r"((?<![\p{L}\p{N}'’_])(?:[\p{L}\p{N}'’_]+[^\p{L}\p{N}'’_]+){2}[\p{L}\p{N}'’_]+)[^\p{L}\p{N}]*$"
_OPENING = r"^[^\p{L}\p{N}]*((?:[\p{L}\p{N}'’_]+[^\p{L}\p{N}'’_]+){2}[\p{L}\p{N}'’_]+)"


def _opening(sentence: Column) -> Column:
    return F.xxhash64(F.regexp_extract(F.lower(sentence), _OPENING, 1))


def closing_remarks(replies: DataFrame) -> DataFrame:
    """(opening, remark): sentences that practically always end in dots, so that dots are no sign of a cut there.

    Of all sentences with the same first three words, nine in ten must end in dots, with the same words; counted over all
    rows by hash aggregates that combine before they shuffle.
    """
    nothing = F.xxhash64(F.lit(""))
    dotted = replies.filter((F.col("how") == "dots") & (F.col("opening") != nothing)).select("opening", "remark")
    remarks = dotted.groupBy("opening", "remark").agg(F.count(F.lit(1)).alias("n")).filter("n >= 3")
    starts = replies.select(F.explode(F.split("t", r"(?<=[.!?…])\s+|\n")).alias("s")).select(_opening(F.col("s")).alias("opening")).filter(F.col("opening") != nothing)
    total = starts.groupBy("opening").agg(F.count(F.lit(1)).alias("starts"))
    return remarks.join(total, "opening").filter(F.col("n") >= 0.9 * F.col("starts")).select("opening", "remark").distinct()


def prepared(rows: DataFrame, origin: str, id_col: str) -> DataFrame:
    """One table's replies in the common form, with all that is read from a text: its body, ending, lengths and last words."""
    copies = F.coalesce(squash(F.col("text")) == squash(F.col("reply")), F.lit(False))
    kept = rows.filter(~says_nothing(F.col("reply"))).select(
        F.lit(origin).alias("origin"), F.col(id_col).cast("bigint").alias("row_id"), "agent", "session", "turn", F.xxhash64("text").alias("prompt"), body(F.col("reply")).alias("t"), copies.alias("copies"), "reply_chars",
        F.array(*(c.cast("int") for c in lengths(F.col("reply")).values())).alias("lens"))
    ended = kept.withColumn("how", ending(F.col("t"), F.col("copies")))
    dots = F.when(F.col("how") == "dots", F.regexp_extract("t", _DOTTED, 1))
    tail = F.when(F.col("how").isin("open", "whole") & ~F.col("copies"), F.xxhash64(F.regexp_extract(F.lower(F.right("t", F.lit(_END // 2))), _LAST_WORDS, 1)))
    stops = (F.col("how") == "whole") & ~F.col("copies") & F.right("t", F.lit(12)).rlike(rf"[.!?。！？؟]{_CLOSER}$")
    return ended.withColumn("stops", stops).withColumn("opening", _opening(dots)).withColumn("remark", squash(dots)).withColumn("tail", tail)


def limits(replies: DataFrame, *, peak: float = 4.0, sigmas: float = 6.0) -> DataFrame:
    """(agent, encoding, limit, unfinished, rows, kinds, around): lengths where replies of a source pile up.

    ``replies`` has agent, lens (in the order of ``lengths``), unfinished and t.  ``kinds`` is the number of different replies, by their
    first 24 or last 12 code points, whichever is less (by sketches that are practically exact where it is small); a limit has
    ``peak`` times as many as the 16 lengths around it, ``around`` on average, and is ``sigmas`` standard deviations above.  Of the
    encodings that expose the same limit the one with the most kinds is kept, of equal ones the first.
    """
    names = list(lengths(F.lit("")))
    measured = replies.select("agent", "unfinished", F.xxhash64(F.left("t", F.lit(24))).alias("head"), F.xxhash64(F.right("t", F.lit(12))).alias("end"), F.posexplode("lens").alias("enc", "limit"))
    kinds = F.least(F.approx_count_distinct("head"), F.approx_count_distinct("end"))
    counted = measured.groupBy("agent", "enc", "limit", "unfinished").agg(F.count(F.lit(1)).alias("rows"), kinds.alias("kinds"))
    # one row a distinct length: the neighbourhood is bounded, a plain equi-join with shifted copies
    near = counted.select("agent", "enc", "unfinished", F.explode(F.array(*(F.lit(d) for d in range(-8, 9) if d))).alias("d"), "limit", "kinds").groupBy(
        "agent", "enc", (F.col("limit") + F.col("d")).alias("limit"), "unfinished").agg((F.sum("kinds") / 16).alias("around"))
    # null agents are a source of their own
    same = F.col("c.agent").eqNullSafe(F.col("n.agent"))
    for c in ("enc", "limit", "unfinished"):
        same = same & (F.col(f"c.{c}") == F.col(f"n.{c}"))
    both = counted.alias("c").join(near.alias("n"), same, "left").select("c.*", F.coalesce("n.around", F.lit(0.0)).alias("around"))
    found = both.filter((F.col("kinds") >= peak * F.col("around")) & (F.col("kinds") >= F.col("around") + sigmas * F.sqrt(F.col("around") + 1)))
    a, b = found.alias("a"), found.alias("b")
    better = (F.col("b.kinds") > F.col("a.kinds")) | (F.col("b.kinds") == F.col("a.kinds")) & (F.col("b.enc") < F.col("a.enc"))
    hidden = F.col("a.agent").eqNullSafe(F.col("b.agent")) & (F.col("a.unfinished") == F.col("b.unfinished")) & (F.abs(F.col("a.limit") - F.col("b.limit")) <= 16) & better
    encoding = F.get(F.array(*map(F.lit, names)), F.col("a.enc"))
    return a.join(b, hidden, "left_anti").select("a.agent", encoding.alias("encoding"), "a.limit", "a.unfinished", "a.rows", "a.kinds", F.round("a.around", 4).alias("around"))


def at_limits(replies: DataFrame, found: DataFrame) -> DataFrame:
    """(origin, row_id) of the replies whose length stands at a limit of their source and of their kind of ending."""
    names = F.array(*map(F.lit, lengths(F.lit(""))))
    rows = replies.select("origin", "row_id", F.coalesce("agent", F.lit("\0")).alias("agent"), "unfinished", F.explode(F.arrays_zip(names.alias("encoding"), F.col("lens").alias("limit"))).alias("l"))
    known = found.select(F.coalesce("agent", F.lit("\0")).alias("agent"), "encoding", "limit", "unfinished", "rows")
    return join_hot(rows.select("origin", "row_id", "agent", "unfinished", "l.*"), known, ["agent", "encoding", "limit", "unfinished"], "rows", F.xxhash64("row_id")).select("origin", "row_id").distinct()


def longer_copies(replies: DataFrame) -> DataFrame:
    """(origin, row_id) of replies that another delivery of the same reply continues."""
    keys = ["agent", "session", "turn", "prompt"]
    bare = replies.filter(F.col("session").isNotNull() & F.col("turn").isNotNull() & F.col("agent").isNotNull()).select("origin", "row_id", *keys, without_mark(F.col("t")).alias("bare"))
    longest = bare.groupBy(*keys).agg(F.max_by("bare", F.length("bare")).alias("full"), F.count(F.lit(1)).alias("n"), F.min(F.length("bare")).alias("least"))
    longest = longest.filter((F.col("n") > 1) & (F.col("least") < F.length("full"))).drop("least")
    both = join_hot(bare, longest, keys, "n", F.xxhash64("row_id"))
    shorter = (F.length("bare") < F.length("full")) & (F.length("bare") >= 4) & F.startswith("full", F.rtrim("bare"))
    return both.filter(shorter).select("origin", "row_id").distinct()


def marked(work: Workspace, replies: DataFrame) -> DataFrame:
    """``replies``, parsed once and written, with ``unfinished`` and ``doubtful`` by their endings.

    Only rows with dots are joined with the closing remarks, only open ends with the known last words: a row without a key
    takes part in no join.
    """
    replies = work.save(replies, "replies")
    dots, rest = F.coalesce(F.col("how") == "dots", F.lit(False)), F.col("how").isin("mark", "fence", "escape", "open")
    remark = closing_remarks(replies).withColumn("closing", F.lit(True))
    dotted = replies.filter(dots).join(remark, ["opening", "remark"], "left").withColumn("unfinished", F.col("closing").isNull()).drop("closing").withColumn("doubtful", F.lit(False))
    # last words are known to close replies if nine in ten of the replies that end in them are whole
    tailed = (F.col("how") == "open") & F.col("tail").isNotNull()
    counts = replies.filter(F.col("tail").isNotNull()).groupBy("tail").agg(F.count_if(F.col("how") == "whole").alias("whole"), F.count(F.lit(1)).alias("n"))
    known = counts.filter((F.col("whole") >= 3) & (F.col("whole") < F.col("n")) & (F.col("whole") >= 0.9 * F.col("n"))).select("tail", F.lit(True).alias("known"))
    opened = replies.filter(tailed).join(known, "tail", "left").withColumn("unfinished", F.lit(True)).withColumn("doubtful", F.col("known").isNotNull()).drop("known")
    others = replies.filter(~dots & ~tailed).withColumn("unfinished", rest).withColumn("doubtful", F.lit(False))
    return work.save(dotted.unionByName(opened).unionByName(others), "marked")


def judged(work: Workspace, replies: DataFrame) -> DataFrame:
    """(origin, row_id, agent, by_limit, by_copy, by_ending) of the cut replies, with the reasons that say so.

    The texts are parsed once and written; all that follows reads the columns it needs, and only rows with a reason are shuffled.
    """
    rows = marked(work, replies)
    able = rows.filter("unfinished or stops")  # code, paths, lists and emoji end a whole reply
    limit = at_limits(able, limits(able)).select("origin", "row_id", F.lit("limit").alias("why"))
    copy = longer_copies(rows).select("origin", "row_id", F.lit("copy").alias("why"))
    ends = rows.filter("unfinished and not doubtful").select("origin", "row_id", F.lit("ending").alias("why"))
    has = lambda why: F.max(F.col("why") == why).alias(f"by_{why}")
    return limit.unionByName(copy).unionByName(ends).groupBy("origin", "row_id").agg(has("limit"), has("copy"), has("ending"))


def all_replies(raw: DataFrame, cached: DataFrame) -> DataFrame:
    return prepared(raw, "raw_messages", "rm_id").unionByName(prepared(cached, "cmsgs", "cm_id"))


def truncated(spark: SparkSession, raw: DataFrame, cached: DataFrame) -> DataFrame:
    """(origin, row_id) of the stored replies that are not whole."""
    return judged(Workspace(spark, "truncation"), all_replies(raw, cached)).select("origin", "row_id")


def storage_limits(spark: SparkSession, raw: DataFrame, cached: DataFrame) -> DataFrame:
    """The ``limits`` that the stored replies expose."""
    return limits(marked(Workspace(spark, "truncation"), all_replies(raw, cached)).filter("unfinished or stops"))


def rates(spark: SparkSession, raw: DataFrame, cached: DataFrame) -> DataFrame:
    """(origin, agent, replies, cut, share, at_limit, longer_copy, counted_longer): how often each source cuts, and by which evidence;
    ``counted_longer`` says in how many cut rows the source's own count is above the stored length."""
    work = Workspace(spark, "truncation")
    replies = work.save(all_replies(raw, cached), "all")
    cut = judged(work, replies).withColumn("cut", F.lit(True))
    j = replies.select("origin", "row_id", "agent", "reply_chars", F.col("lens")[1].alias("octets")).join(cut, ["origin", "row_id"], "left")
    return j.groupBy("origin", "agent").agg(
        F.count(F.lit(1)).alias("replies"), F.count("cut").alias("cut"), F.round(F.count("cut") / F.count(F.lit(1)), 6).alias("share"),
        F.count_if("by_limit").alias("at_limit"), F.count_if("by_copy").alias("longer_copy"), F.count_if(F.col("cut") & (F.col("reply_chars") > F.col("octets"))).alias("counted_longer"),
    )
