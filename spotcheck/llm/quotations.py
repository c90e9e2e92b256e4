"""Conversations ordered by the replies that quotations reveal, without the quotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from spotcheck.llm.frames import materialize, ordered, running_totals

#: Quote marks at the start of a line, with blanks among them; a line that announces a quotation.
MARKS = r"^(?:[ \t]*>)+[ \t]?"
ANNOUNCES = r"(?i)\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$"


def _normal(x: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))


def quoted_units(messages: DataFrame) -> DataFrame:
    """Messages with ``body`` (unquoted text), quote_depth, quoted_lines and ``units``.

    A text's lines have a level, the number of quote marks before them.  Neighbouring lines
    of one level are a passage.  The units are all passages and all their lines, normalised
    and hashed, with their level and their number of words: a whole passage is still found
    when its lines were broken anew, and a line when only part of a passage was quoted.
    """
    rows = messages.withColumn("lines", F.split(F.coalesce(F.col("text"), F.lit("")), "\r?\n"))
    rows = rows.withColumn("marks", F.transform("lines", lambda x: F.regexp_extract(x, MARKS, 0)))
    rows = rows.withColumn("level", F.transform("marks", lambda m: F.length(F.translate(m, " \t", ""))))
    rows = rows.withColumn("bare", F.zip_with("lines", "marks", lambda x, m: F.substring(x, F.length(m) + 1, F.length(x))))
    rows = rows.withColumn("at", F.expr("filter(sequence(0, size(level) - 1), i -> i = 0 or level[i] != level[i - 1])"))
    passages = F.expr("transform(at, (a, j) -> struct(level[a] as level, slice(bare, a + 1, coalesce(get(at, j + 1), size(level)) - a) as lines))")
    rows = rows.withColumn("passages", passages)
    announced = "level[i] = 0 and not (i + 1 < size(level) and level[i + 1] > 0 and bare[i] rlike '" + ANNOUNCES.replace("\\", "\\\\") + "')"
    body = F.trim(F.expr(f"array_join(transform(filter(sequence(0, size(level) - 1), i -> {announced}), i -> bare[i]), '\n')"), F.lit(" \t\r\n"))

    def unit(level: Column, x: Column) -> Column:
        return F.struct(level.alias("level"), F.xxhash64(x).alias("hash"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"), (x != "").alias("some"))

    units = F.transform("passages", lambda p: F.array_append(F.transform(p["lines"], lambda x: unit(p["level"], _normal(x))), unit(p["level"], _normal(F.array_join(p["lines"], " ")))))
    rows = rows.withColumns({"body": body, "quote_depth": F.array_max("level"), "quoted_lines": F.expr("size(filter(level, x -> x > 0))"), "units": F.filter(F.flatten(units), lambda u: u["some"])})
    return rows.drop("lines", "marks", "level", "bare", "at", "passages")


def link_quotations(messages: DataFrame) -> DataFrame:
    """Every message of (conv_id, turn, role, text) with its place in its conversation's replies.

    A message replies to the latest earlier message of its conversation whose own, unquoted
    passages or lines hold most words of its outermost quotations; without one, to the message
    before it.  ``link`` says which: ``quote``, ``previous`` or ``first``.  A message's first
    reply continues its thread and any further one opens a thread, numbered by the message
    that opens it; ``position`` counts from 0 within the thread.  Read by thread and position,
    each message follows what it answers; ``body`` is its text without quotations and the
    lines that announce them.

    Built-in expressions only.  Originals are found by a running window over each hash, never
    by pairs, so a line that a whole conversation repeats costs its rows once.  A conversation
    with a third of all rows is ranged over many partitions.  Chains are followed by doubling,
    in a number of rounds that grows with the logarithm of the longest.

    Null conversations are one conversation; null turns come first; a null text is empty; a
    repeated row is a message of its own right after the first; an empty table gives an empty
    one; further columns are left out.
    """
    rows = messages.select("conv_id", "turn", "role", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_t"))
    keys = ["conv_id", "turn", "role", "_t"]
    rows = running_totals(ordered(rows, *keys).withColumn("_one", F.lit(1)), keys, {"msg": "_one"})
    # the message before, across partitions too: a row for each partition
    inner = Window.partitionBy("_part").orderBy("msg")
    ends = rows.groupBy("_part").agg(F.max(F.struct("msg", "conv_id", "turn")).alias("last"))
    ends = ends.select((F.col("_part")).alias("_p"), F.lag("last").over(Window.orderBy("_part")).alias("before"))
    rows = rows.join(F.broadcast(ends), F.col("_part") == F.col("_p"))
    before = F.coalesce(F.lag(F.struct("msg", "conv_id", "turn")).over(inner), F.col("before"))
    rows = rows.withColumn("_b", before).withColumn("prev", F.when(F.col("_b.conv_id").eqNullSafe(F.col("conv_id")), F.col("_b.msg"))).drop("_b", "before", "_p", "_part", "_one", "_t")
    rows = materialize(quoted_units(rows).drop("text"))

    quoting = rows.filter("quoted_lines > 0")
    asked = quoting.select("conv_id", "msg", F.explode("units").alias("u"), F.expr("array_min(transform(filter(units, x -> x.level > 0), x -> x.level))").alias("outer")).filter("u.level = outer")
    with_quotes = quoting.select(F.col("conv_id").alias("_c")).distinct()
    own = rows.join(with_quotes, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi").select("conv_id", "msg", F.explode("units").alias("u")).filter("u.level = 0")
    both = asked.select("conv_id", "msg", "u.hash", "u.words", F.lit(None).cast("long").alias("source")).unionByName(own.select("conv_id", "msg", "u.hash", "u.words", F.col("msg").alias("source")))
    earlier = Window.partitionBy("conv_id", "hash").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    votes = both.withColumn("origin", F.max("source").over(earlier)).filter("source is null and origin is not null")
    votes = votes.groupBy("msg", "origin").agg(F.sum("words").alias("words"))
    linked = votes.groupBy("msg").agg(F.max(F.struct("words", "origin")).alias("best")).select(F.col("msg").alias("_m"), F.col("best.origin").alias("origin"), F.col("best.words").alias("matched_words"))
    replies = rows.drop("units").join(linked, F.col("msg") == F.col("_m"), "left").drop("_m")
    replies = materialize(replies.withColumns({"parent": F.coalesce("origin", "prev"), "link": F.expr("case when origin is not null then 'quote' when prev is not null then 'previous' else 'first' end")}))

    first = replies.filter("parent is not null").groupBy("parent").agg(F.min("msg").alias("heir"))
    # messages without a parent get a key of their own, else all meet in one task
    alone = F.coalesce("parent", -1 - F.col("msg"))
    chain = replies.select("msg", "parent", alone.alias("_k")).join(first.withColumnRenamed("parent", "_k"), "_k", "left")
    heir = F.coalesce(F.col("heir") == F.col("msg"), F.lit(False))
    # top: where the steps so far lead; up: the same while they may go on
    chain = materialize(chain.select("msg", F.when(heir, F.col("parent")).alias("up"), F.when(heir, F.col("parent")).otherwise(F.col("msg")).alias("top"), heir.cast("long").alias("hops")))
    while chain.filter("up is not null").limit(1).count():  # each round doubles the steps taken
        upper = chain.select(F.col("msg").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"), F.col("hops").alias("hops2"))
        step = chain.join(upper, "up").select("msg", F.col("up2").alias("up"), F.col("top2").alias("top"), (F.col("hops") + F.col("hops2")).alias("hops"))
        chain = materialize(chain.filter("up is null").unionByName(step))
    thread = chain.select(F.col("msg").alias("_m"), F.col("top").alias("_top"), F.col("hops").alias("position"))
    out = replies.join(thread, F.col("msg") == F.col("_m"))
    names = replies.select(F.col("msg").alias("_n"), F.col("turn").alias("_turn"))
    out = out.join(names.select(F.col("_n").alias("_pn"), F.col("_turn").alias("reply_to")), alone == F.col("_pn"), "left")
    out = out.join(names.select(F.col("_n").alias("_tn"), F.col("_turn").alias("thread")), F.col("_top") == F.col("_tn"))
    return out.select("conv_id", "turn", "role", "reply_to", "link", "thread", "position", F.coalesce("quote_depth", F.lit(0)).alias("quote_depth"), F.col("quoted_lines"), F.coalesce("matched_words", F.lit(0)).cast("long").alias("matched_words"), "body")


SQL = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST) - 1 AS msg, *, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) AS lines FROM conversations),
l AS (SELECT msg, conv_id, i, lines[i] AS line, regexp_extract(lines[i], '^(?:[ \t]*>)+[ \t]?') AS marks FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM m)),
v AS (SELECT msg, conv_id, i, length(regexp_replace(marks, '[ \t]', '', 'g')) AS level, substr(line, length(marks) + 1) AS bare FROM l),
n AS (SELECT *, lead(level) OVER w AS next_level, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS fresh FROM v WINDOW w AS (PARTITION BY msg ORDER BY i)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY msg ORDER BY i) AS passage FROM n),
u AS (SELECT msg, conv_id, level, trim(regexp_replace(lower(bare), '\s+', ' ', 'g')) AS x FROM p
      UNION ALL SELECT msg, conv_id, level, trim(regexp_replace(lower(string_agg(bare, ' ' ORDER BY i)), '\s+', ' ', 'g')) FROM p GROUP BY msg, conv_id, level, passage),
k AS (SELECT *, length(x) - length(replace(x, ' ', '')) + 1 AS words, min(CASE WHEN level > 0 THEN level END) OVER (PARTITION BY msg) AS outermost FROM u WHERE x <> ''),
votes AS (SELECT q.msg, o.origin, sum(q.words) AS words
          FROM k AS q, LATERAL (SELECT max(o.msg) AS origin FROM k AS o WHERE o.conv_id IS NOT DISTINCT FROM q.conv_id AND o.x = q.x AND o.level = 0 AND o.msg < q.msg) AS o
          WHERE q.level > 0 AND q.level = q.outermost AND o.origin IS NOT NULL GROUP BY q.msg, o.origin),
best AS (SELECT msg, max_by(origin, (words, origin)) AS origin, max(words) AS words FROM votes GROUP BY msg),
r AS (SELECT m.msg, m.conv_id, m.turn, m.role, best.origin, best.words,
        lag(m.msg) OVER (PARTITION BY m.conv_id ORDER BY m.msg) AS prev FROM m LEFT JOIN best ON best.msg = m.msg),
c AS (SELECT *, coalesce(origin, prev) AS parent, CASE WHEN coalesce(origin, prev) IS NOT NULL THEN min(msg) OVER (PARTITION BY coalesce(origin, prev)) END AS heir FROM r),
t AS (SELECT msg, msg AS top, CAST(0 AS BIGINT) AS position FROM c WHERE parent IS NULL OR heir <> msg
      UNION ALL SELECT c.msg, t.top, t.position + 1 FROM t JOIN c ON c.parent = t.msg AND c.heir = c.msg),
b AS (SELECT msg, CAST(max(level) AS INTEGER) AS quote_depth, CAST(count(*) FILTER (level > 0) AS INTEGER) AS quoted_lines,
        trim(coalesce(string_agg(bare, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (coalesce(next_level, 0) > 0
          AND regexp_matches(bare, '(?i)\b(?:wrote|writes|schrieb|escribió|a écrit)\s*:\s*$'))), ''), ' ' || chr(9) || chr(13) || chr(10)) AS body FROM n GROUP BY msg)
SELECT c.conv_id, c.turn, c.role, parent.turn AS reply_to,
  CASE WHEN c.origin IS NOT NULL THEN 'quote' WHEN c.prev IS NOT NULL THEN 'previous' ELSE 'first' END AS link,
  opener.turn AS thread, t.position, b.quote_depth, b.quoted_lines, CAST(coalesce(c.words, 0) AS BIGINT) AS matched_words, b.body
FROM c JOIN t ON t.msg = c.msg JOIN b ON b.msg = c.msg JOIN m AS opener ON opener.msg = t.top LEFT JOIN m AS parent ON parent.msg = c.parent
"""
