r"""Repair of a conversation's structure at least cost, by a fold over its turns in Spark SQL.

Rows of a conversation stand by turn (null turns first), role and text. A row's
first fault counts: blank (nothing but white space), duplicate (same role and
text earlier in the conversation), truncated (its last character that is not
white space is not one of .!?). Edits keep a row (K, 0), give it the other role
(R, 1), delete it (D, 2; blank and duplicate rows must go) or insert an empty
user or assistant turn (I, 5); a truncated row that stays adds 5. The roles that
are left must read (s?(ua)+)? by their initials. Of the cheapest edits those with
the ASCII-least string of letters are taken.

The fold's state is what has been written so far: nothing, a system turn, a
user's or an assistant's turn. aggregate() carries a (cost, audit) struct for
each of the four and takes the least() of what leads to it.

A conversation may hold any share of all rows, so none is folded whole. All
rows are range-sorted by conversation and place in it; each conversation's rows
in a sorted part are cut into blocks of BLOCK. A block is folded from each of
the four states, which gives a 4 x 4 table of (cost, audit); tables compose like
matrices, BLOCK at a time within a part and the parts of a conversation last.
The audit string of the best way through gives each row its edit. Equal rows
travel as one with a count, and what is a duplicate is found by two windows, one
over salted groups and one over the first of each salt.

In the audit that the fold carries, J inserts and S gives the assistant's role,
I and R the user's; a state allows one of each pair, so the order of strings is
not changed by that, and the letters are K, R, D and I in results.

Null ids form one conversation; a null role or text counts as one space. A role
that is empty or has another initial must change or go. Ties in turn are taken
by role and text; equal rows are duplicates of the first. Very long texts are
moved as they are, never folded. A result row of `repaired` holds one repaired
conversation; `turns` gives it as rows. Gaps that no long can hold are 0. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import staged

BLOCK = 64
SALTS = 64
TASK = 10_000  # rows to a task of the fold, about
SPACE = " \t\n\x0b\x0c\r"
STATES = "esua"
INSERT, DELETE, REROLE, TRUNCATED = 5, 2, 1, 5
NEVER = 1 << 40  # the cost of what can't be


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties it, 2 takes its .!?, 3 repeats it, 4 makes it the user's."""
    fault = F.crc32(F.concat(*_text("conv_id"), F.lit(":"), *_text("turn"))) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.withColumn("fault", fault).where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _text(name: str) -> list[Column]:
    return [F.coalesce(F.col(name).cast("string"), F.lit(" "))]


def _state(cost: Column | int, audit: Column | str, path: Column | str | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    fields = [lit(cost).cast("long").alias("cost"), lit(audit).alias("audit")]
    return F.struct(*fields, lit(path).alias("path")) if path is not None else F.struct(*fields)


def _from(state: Column, cost: Column | int, letters: Column | str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], letters if isinstance(letters, Column) else F.lit(letters)))


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once; an expression that is named twice would be worked out twice."""
    return F.transform(F.array(value), body)[0]


def _step(acc: Column, row: Column) -> Column:
    """The four states after one row, and the copies of it that must go."""
    e, s = acc["e"], acc["s"]
    more = row["more"]
    more_cost = DELETE * F.length(more)
    stays = F.when(row["fault"] == 2, F.lit(NEVER)).when(row["fault"] == 1, F.lit(TRUNCATED)).otherwise(F.lit(0)) + more_cost

    def to(state: Column, initial: str, letter: str) -> Column:
        """From a state by keeping the row, where its role has the initial, or else by giving it that role."""
        same = row["initial"] == initial
        return _from(state, stays + F.when(same, F.lit(0)).otherwise(F.lit(REROLE)), F.concat(F.when(same, F.lit("K")).otherwise(F.lit(letter)), more))

    def gone(state: Column) -> Column:
        return _from(state, DELETE + more_cost, F.concat(F.lit("D"), more))

    first = _from(e, stays + F.when(row["initial"] == "s", F.lit(0)).otherwise(F.lit(NEVER)), F.concat(F.lit("K"), more))

    def after(u: Column, a: Column) -> Column:
        return F.struct(
            gone(e).alias("e"),
            F.least(gone(s), first).alias("s"),
            F.least(gone(u), *(to(k, "u", "R") for k in (e, s, a))).alias("u"),
            F.least(gone(a), to(u, "a", "S")).alias("a"),
        )

    inserted = F.least(acc["u"], *(_from(acc[k], INSERT, "I") for k in "esa"))
    return _let(inserted, lambda u: _let(F.least(acc["a"], _from(u, INSERT, "J")), lambda a: after(u, a)))


def _start(state: str, path: str | None = None) -> Column:
    return F.struct(*(_state(0 if k == state else NEVER, "", path).alias(k) for k in STATES))


def _compose(acc: Column, table: Column) -> Column:
    """The four states after a block whose 4 x 4 table is given."""

    def way(i: str, j: str) -> Column:
        a, b = acc[i], table[i][j]
        return _state(F.least(a["cost"] + b["cost"], F.lit(NEVER)), F.concat(a["audit"], b["audit"]), F.concat(a["path"], b["path"]))

    return F.struct(*(F.least(*(way(i, j) for i in STATES)).alias(j) for j in STATES))


def _illegal(before: Column, after: Column) -> Column:
    return (~F.concat(before, after).isin("su", "ua", "au")).cast("long")


def placed(rows: DataFrame) -> DataFrame:
    """Distinct rows of each conversation with their number and their place `at`, which sorts all rows; written once."""
    plain = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv"),
        F.col("turn").isNotNull().alias("has_turn"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")),
    )
    keys = ["conv", "has_turn", "turn", "role", "text"]
    counted = plain.groupBy(*keys).agg(F.count("*").alias("n"))
    # the sort runs in whole partitions, so the number of a row grows with its place
    return staged(counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "repair-rows")


def flagged(rows: DataFrame) -> DataFrame:
    """(conv, part, block, at, n, initial, blank, truncated, first) of placed rows."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select(
        "conv",
        F.shiftright("at", 33).alias("part"),
        "at",
        "n",
        F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("x").alias("initial"),
        F.sha2(F.concat_ws("\n", F.length("role"), "role", "text"), 256).alias("said"),
        (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    salt = F.pmod(F.xxhash64("at"), F.lit(SALTS))
    ahead = slim.withColumn("group", salt).withColumn("ahead", F.row_number().over(Window.partitionBy("conv", "said", "group").orderBy("at")) == 1)
    ahead = ahead.withColumn("group", F.when(F.col("ahead"), -1).otherwise(F.col("group")))
    first = ahead.withColumn("first", F.col("ahead") & (F.row_number().over(Window.partitionBy("conv", "said", "group").orderBy("at")) == 1))
    number = F.row_number().over(Window.partitionBy("conv", "part").orderBy("at"))
    first = first.repartition(rows.count() // TASK + 1, "conv", "part")  # the fold that follows is work for few bytes
    return first.withColumn("block", ((number - 1) / BLOCK).cast("long")).drop("said", "group", "ahead")


def folded(rows: DataFrame) -> DataFrame:
    """A row a block: its table, its rows' places and numbers, and counts of faults; written once."""
    blank, first = F.col("blank"), F.col("first")
    fault = F.when(blank | ~first, 2).when(F.col("truncated"), 1).otherwise(0)
    marked = rows.withColumn("more", F.repeat(F.lit("D"), (F.col("n") - 1).cast("int")))
    blocks = marked.groupBy("conv", "part", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "n", "initial", fault.alias("fault"), "more"))).alias("rows"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).otherwise(F.col("n") - first.cast("long"))).alias("duplicate"),
        F.sum((~blank & first & F.col("truncated")).cast("long")).alias("truncated"),
        F.sum(F.col("n") - 1).alias("illegal"),
    )
    initials = F.transform("rows", lambda r: r["initial"])
    pairs = F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials)), _illegal)

    def row(i: str) -> Column:
        """A row of the table: the fold from one state."""
        return _let(F.aggregate("rows", _start(i), _step), lambda t: F.struct(*(_state(t[j]["cost"], t[j]["audit"], str(STATES.index(i))).alias(j) for j in STATES)))

    table = F.struct(*(row(k).alias(k) for k in STATES))
    return staged(
        blocks.select(
            "conv",
            "part",
            "block",
            F.transform("rows", lambda r: F.struct(r["at"].alias("at"), r["n"].alias("n"))).alias("rows"),
            "blank",
            "duplicate",
            "truncated",
            (F.col("illegal") + F.aggregate(pairs, F.lit(0).cast("long"), lambda x, y: x + y)).alias("illegal"),
            F.element_at(initials, 1).alias("head"),
            F.element_at(initials, -1).alias("tail"),
            table.alias("table"),
        ),
        "repair-blocks",
    )


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _joined(groups: DataFrame, starts: str, by: list[str], at: str) -> DataFrame:
    """Neighbouring blocks, sorted by `at`, made one: folded from each state of `starts`."""
    found = groups.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(at, "table", "head", "tail", "blocks"))).alias("all"), *(F.sum(c).alias(c) for c in COUNTS))
    every = F.col("all")
    borders = F.zip_with(F.slice(every, 1, F.size(every) - 1), F.slice(every, 2, F.size(every)), lambda a, b: _illegal(a["tail"], b["head"]))
    table = F.struct(*(F.aggregate(every, _start(k, ""), lambda acc, x: _compose(acc, x["table"])).alias(k) for k in starts))
    return found.select(
        *by,
        *(c for c in COUNTS if c != "illegal"),
        (F.col("illegal") + F.aggregate(borders, F.lit(0).cast("long"), lambda x, y: x + y)).alias("illegal"),
        F.element_at(every, 1)["head"].alias("head"),
        F.element_at(every, -1)["tail"].alias("tail"),
        F.transform(every, lambda x: F.struct(x[at].alias("part"), x["blocks"].alias("blocks"))).alias("parts"),
        F.aggregate(every, F.lit(0).cast("long"), lambda n, x: n + x["blocks"]).alias("blocks"),
        table.alias("table"),
    )


def solved(blocks: DataFrame) -> DataFrame:
    """(conv, counts, cost, audit, path, trail, parts): the cheapest edits of each conversation; `path` has each block's first state."""
    most = blocks.agg(F.max("block")).first()[0] or 0
    level = blocks.drop("rows").withColumn("blocks", F.lit(1).cast("long"))
    while True:
        level = level.withColumn("group", (F.col("block") / BLOCK).cast("long"))
        level = _joined(level, STATES, ["conv", "part", "group"], "block").drop("parts").withColumnRenamed("group", "block")
        most //= BLOCK
        if not most:
            break
    whole = _joined(level, "e", ["conv"], "part")
    ends = F.col("table")["e"]

    def end(state: str, cost: int, trail: str) -> Column:
        found = ends[state]
        return F.struct((found["cost"] + cost).alias("cost"), F.concat(found["audit"], F.lit(trail)).alias("audit"), F.concat(found["path"], F.lit(str(STATES.index(state)))).alias("path"), F.lit(trail).alias("trail"))

    best = F.least(end("e", 0, ""), end("a", 0, ""), end("u", INSERT, "J"), end("s", 2 * INSERT, "IJ"))
    return whole.withColumn("best", best).select("conv", *COUNTS, "best.*", "parts")


def edits(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, at, edit): the letters that end with each row's own, inserted turns before it first; a null `at` is the end."""
    number = F.flatten(F.transform("parts", lambda p: F.transform(F.sequence(F.lit(0).cast("long"), p["blocks"] - 1), lambda k: F.struct(p["part"].alias("part"), k.alias("block")))))
    ways = found.select("conv", "path", F.posexplode(number).alias("k", "own"))
    digit = lambda k: F.substring(F.col("path"), k, F.lit(1)).cast("int")
    ways = ways.select("conv", "own.*", digit(F.col("k") + 1).alias("i"), digit(F.col("k") + 2).alias("j"))
    cell = F.coalesce(*(F.when((F.col("i") == x) & (F.col("j") == y), F.col("table")[i][j]["audit"]) for x, i in enumerate(STATES) for y, j in enumerate(STATES)))
    own = blocks.join(ways, ["conv", "part", "block"]).select("conv", "rows", F.regexp_extract_all(cell, F.lit("[IJ]*[DKRS]"), 0).alias("letters"))
    # a row's copies come after it and are all deleted, so its letters are those at its first copy
    ends = F.aggregate("rows", F.array().cast("array<long>"), lambda acc, r: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + r["n"])))
    own = own.withColumn("ends", ends)
    each = F.transform("rows", lambda r, k: F.struct(r["at"].alias("at"), F.element_at("letters", (F.get(F.col("ends"), k) - r["n"] + 1).cast("int")).alias("edit")))
    own = own.select("conv", F.explode(each).alias("x")).select("conv", "x.*")
    return own.unionByName(found.where("trail <> ''").select("conv", F.lit(None).cast("long").alias("at"), F.col("trail").alias("edit")))


def _turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv, at, k, turn, role, text, edit): the repaired turns, sorted by at (nulls last) and k within a conversation."""
    # the deleted rows go before the join, and their texts with them
    some = found.where(F.col("edit") != "D")
    both = some.join(rows.select("at", "turn", "role", "text"), "at", "left")
    letters = F.filter(F.split("edit", ""), lambda x: (x != "") & (x != "D"))
    return both.select("conv", "at", "turn", "role", "text", F.posexplode(letters).alias("k", "edit")).select(
        "conv",
        "at",
        "k",
        F.when(F.col("edit").isin("I", "J"), None).otherwise(F.col("turn")).alias("turn"),
        F.when(F.col("edit").isin("I", "R"), "user").when(F.col("edit").isin("J", "S"), "assistant").otherwise(F.col("role")).alias("role"),
        F.when(F.col("edit").isin("I", "J"), "").otherwise(F.col("text")).alias("text"),
        F.translate("edit", "JS", "IR").alias("edit"),
    )


def _id(rows: DataFrame) -> Column:
    return F.when(F.col("conv") != " ", F.col("conv").cast(rows.schema["conv_id"].dataType)).alias("conv_id")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, at, k, turn, role, text, edit): the repaired turns as rows; at (nulls last) and k sort a conversation."""
    own = placed(rows)
    blocks = folded(flagged(own))
    return _turns(own, edits(blocks, solved(blocks))).select(_id(rows), "at", "k", "turn", "role", "text", "edit")


def repaired(rows: DataFrame) -> DataFrame:
    """A row a conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired).

    gaps are the turns missing between the least and the largest; illegal are
    neighbours whose roles don't follow one another; repaired has the turns as
    lines role:text.
    """
    own = placed(rows)
    blocks = folded(flagged(own))
    found = staged(solved(blocks), "repair-found")
    wide = F.col("turn").cast("decimal(38,0)")
    gaps = own.groupBy("conv").agg(F.max(wide).alias("high"), F.min(wide).alias("low"), F.countDistinct("turn").alias("distinct"))
    gaps = gaps.select("conv", F.coalesce((F.col("high") - F.col("low") + 1 - F.col("distinct")).try_cast("long"), F.lit(0)).alias("gaps"))
    line = F.concat("role", F.lit(":"), "text")
    lines = _turns(own, edits(blocks, found)).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(F.col("at").isNull().alias("last"), "at", "k", line.alias("line")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return found.join(gaps, "conv").join(lines.select("conv", text.alias("repaired")), "conv", "left").select(
        _id(rows), "gaps", *COUNTS, "cost", F.translate("audit", "JS", "IR").alias("audit"), F.coalesce("repaired", F.lit("")).alias("repaired")
    )


def report(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """repaired() of rows for every conv_id of `whole`, with the digest of the text; zeros where no row is left."""
    found = repaired(rows).withColumn("conv", *_text("conv_id")).drop("conv_id")
    every = whole.select("conv_id").distinct().withColumn("conv", *_text("conv_id"))
    joined = every.join(found, "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("repaired", F.lit("")), 256).alias("repaired_sha256"))
