"""Conversation structure repair: faults by window functions, the cheapest edits by a fold over each conversation's turns.

A conversation should read, in the initials of its roles, `(s?(ua)+)?`. Its rows are taken by turn (nulls first; rows of
one turn by role, then text). Window functions flag each row's first fault: blank, duplicate (same role and text before; of equal rows
all but one),
truncated (no `[.!?]` at its end). Edits: Keep (0), Rerole to user or assistant (3), Delete (4; the only one for blank and
duplicate rows), Insert an empty user or assistant turn anywhere (3); a truncated row that stays costs 3 more.

The turns are collected, sorted, in one array, and aggregate() carries four accumulators, one for what may come next:
nothing yet (S), after a system turn (s), after a user's (u), after an assistant's (a). Each is a struct of cost and audit
(the edits' initials), so least() takes the cheapest and, of equal ones, the ASCII-least audit. That holds for prefixes
as well: two audits of equal cost that read the same rows differ before the shorter one ends. So that an audit's growth is
not paid again at each turn, turns are folded in blocks; within one, a struct is (cost, rank of the audit it started
from, audit since), which compares alike.

Only Spark's own functions run. The one shuffle of rows is by conversation; a conversation is one value there, as the
hash of its repaired text needs it whole (2 GB at most), while sorting and flagging spill.

Edge cases: nulls in role and text are one space, so a null role fits nowhere and a null text is blank; a null conv_id is a
conversation, null turns come first and have no part in gaps; repeated rows are duplicates; a conversation without rows
has zeros and an empty audit; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turns folded before audits are joined.
BLOCK = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: More than any conversation costs: a state that cannot be.
NEVER = 1 << 60
STATES = ["start", "system", "user", "assistant"]
_SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: crc32 of `conv_id:turn`, modulo 20, says how each row is damaged."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    return plain.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """The rows with their role's initial, their first fault, whether they follow badly (illegal), and whether their turn is
    new. Rows that are gone stay, apart from the others, so that their conversation does."""
    rows = rows.repartition("conv_id")  # all windows and the collection use it
    bare = F.rtrim("text", F.lit(_SPACE))
    by_text = W.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    by_turn = W.partitionBy("conv_id", "gone").orderBy(F.asc_nulls_first("turn"), "role", "text")
    pair = F.concat(F.lag("initial").over(by_turn), "initial")
    fault = F.when(F.col("bare") == "", "blank").when(F.col("again"), "duplicate").when(~F.right("bare", F.lit(1)).isin(".", "!", "?"), "truncated")
    return (
        rows.withColumns({"bare": bare, "initial": F.substring("role", 1, 1), "again": F.row_number().over(by_text) > 1})
        .withColumn("fault", fault)
        .withColumns({"illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)), "new": F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(by_turn))})
        .drop("bare")
    )


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often `then` names it."""
    return F.transform(F.array(value), then)[0]


def more(state: Column, cost: Column | int, letters: str) -> Column:
    return F.struct((state["cost"] + cost).alias("cost"), state["rank"].alias("rank"), F.concat(state["audit"], F.lit(letters)).alias("audit"))


def inserted(acc: Column) -> Column:
    """The accumulators once turns may have been inserted. Two are enough: a third gives nothing new."""
    user = F.least(acc["user"], *(more(acc[s], INSERT, "I") for s in ("start", "system", "assistant")))
    return let(user, lambda u: F.struct(acc["start"].alias("start"), acc["system"].alias("system"), u.alias("user"), F.least(acc["assistant"], more(u, INSERT, "I")).alias("assistant")))


def stepped(acc: Column, row: Column) -> Column:
    """The accumulators after one more turn."""
    stays = F.when(row["fault"].isin("blank", "duplicate"), F.lit(NEVER)).when(row["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")

    def reached(acc: Column, initial: str, *before: str) -> list[Column]:
        kept = stays + F.when(row["initial"] == initial, F.lit(0)).otherwise(F.lit(NEVER)).cast("long")
        found = [more(acc[s], kept, "K") for s in before]
        return found if initial == "s" else found + [more(acc[s], stays + REROLE, "R") for s in before]

    def step(acc: Column) -> Column:
        return F.struct(
            more(acc["start"], DELETE, "D").alias("start"),
            F.least(more(acc["system"], DELETE, "D"), *reached(acc, "s", "start")).alias("system"),
            F.least(more(acc["user"], DELETE, "D"), *reached(acc, "u", "start", "system", "assistant")).alias("user"),
            F.least(more(acc["assistant"], DELETE, "D"), *reached(acc, "a", "user")).alias("assistant"),
        )

    return let(inserted(acc), step)


def cheapest(turns: Column) -> Column:
    """The struct (cost, rank, audit) of the cheapest edits of sorted turns."""
    state = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit(0).cast("int").alias("rank"), F.lit("").alias("audit"))
    zero = F.struct(*(state(0 if s == "start" else NEVER).alias(s) for s in STATES))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int")), lambda i: F.slice(turns, i * BLOCK + 1, F.lit(BLOCK)))

    def block(acc: Column, rows: Column) -> Column:
        def folded(audits: Column) -> Column:
            begun = F.struct(*(F.struct(acc[s]["cost"].alias("cost"), F.array_position(audits, acc[s]["audit"]).cast("int").alias("rank"), F.lit("").alias("audit")).alias(s) for s in STATES))
            whole = lambda x: F.struct(x["cost"].alias("cost"), F.lit(0).cast("int").alias("rank"), F.concat(F.element_at(audits, x["rank"]), x["audit"]).alias("audit"))
            return F.aggregate(rows, begun, stepped, lambda out: F.struct(*(whole(out[s]).alias(s) for s in STATES)))

        return let(F.sort_array(F.array(*(acc[s]["audit"] for s in STATES))), folded)

    return F.aggregate(blocks, zero, block, lambda acc: F.least(acc["start"], inserted(acc)["assistant"]))


def repaired(turns: Column, audit: Column) -> Column:
    """The repaired conversation, `role:text` a line."""
    edits = F.regexp_extract_all(audit, F.lit("I*[KRD]"), F.lit(0))  # one of each turn, with what is inserted before it
    line = lambda role, text: F.struct(role.cast("string").alias("role"), text.alias("text"))
    new = lambda n: F.array_repeat(line(F.lit(None), F.lit("")), n.cast("int"))

    def edited(turn: Column, edit: Column) -> Column:
        kind = F.right(edit, F.lit(1))
        own = F.when(kind == "K", F.array(line(turn["role"], turn["text"]))).when(kind == "R", F.array(line(F.lit(None), turn["text"]))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
        return F.concat(new(F.length(edit) - 1), own)

    lines = F.concat(F.flatten(F.zip_with(turns, edits, edited)), new(F.length(F.regexp_extract(audit, "(I*)$", 1))))

    def written_out(lines: Column) -> Column:
        system = F.coalesce(F.substring(F.get(lines, F.lit(0))["role"], 1, 1) == "s", F.lit(False)).cast("int")
        role = lambda x, i: F.coalesce(x["role"], F.when((i - system) % 2 == 0, "user").otherwise("assistant"))
        return F.array_join(F.transform(lines, lambda x, i: F.concat(role(x, i), F.lit(":"), x["text"])), "\n")

    return let(lines, written_out)


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and the repaired conversation, of flagged rows."""
    here = ~F.col("gone")
    turn = F.when(here, F.col("turn"))
    many = lambda which: F.count_if(here & which)
    span = (F.max(turn).cast("decimal(20,0)") - F.min(turn).cast("decimal(20,0)") + 1 - many(F.col("new"))).cast("long")
    turns = F.sort_array(F.collect_list(F.when(here, F.struct("turn", "role", "text", "again", "initial", "fault"))))
    found = rows.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0).cast("long")).alias("gaps"), *(many(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), many(F.col("illegal")).alias("illegal"), turns.alias("turns")
    )
    best = found.withColumn("best", F.when(F.size("turns") > 0, cheapest(F.col("turns"))))
    cost, audit = F.coalesce("best.cost", F.lit(0).cast("long")), F.coalesce("best.audit", F.lit(""))
    return best.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", cost.alias("cost"), audit.alias("audit"), "turns").select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.when(F.size("turns") > 0, repaired(F.col("turns"), F.col("audit"))).otherwise("").alias("repaired")
    )


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """repairs() of rows as they are; without damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return repairs(flagged(rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), F.lit(False).alias("gone"))))


#: crc32 bit by bit; the edits by a recursive search over turns, states as rows; insertions follow a turn instead of
#: coming before it.
SQL = r"""
WITH RECURSIVE plain AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
  FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b:
    list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) % 20 AS kind
  FROM plain),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
  FROM kinds WHERE kind <> 0),
repeats AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM damaged),
seen AS (
  SELECT *, row_number() OVER t AS i, lag(left(role, 1)) OVER t || left(role, 1) AS pair
  FROM repeats WINDOW t AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again)),
turns AS (
  SELECT conv_id, turn, role, text, i, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE 'none' END AS fault
  FROM seen),
ids AS (SELECT DISTINCT conv_id FROM conversations),
added(a, b, letters, cost) AS (VALUES ('-', '-', '', 0), ('s', 's', '', 0), ('u', 'u', '', 0), ('a', 'a', '', 0), ('-', 'u', 'I', 3), ('-', 'a', 'II', 6), ('s', 'u', 'I', 3), ('s', 'a', 'II', 6), ('u', 'a', 'I', 3), ('a', 'u', 'I', 3)),
moves(a, b) AS (VALUES ('-', 's'), ('-', 'u'), ('s', 'u'), ('a', 'u'), ('u', 'a')),
search(conv_id, i, state, cost, audit) AS (
  SELECT conv_id, CAST(0 AS BIGINT), b, cost, letters FROM ids, added WHERE a = '-'
  UNION ALL
  SELECT conv_id, i, state, cost, audit FROM (
    SELECT n.conv_id, n.i, x.b AS state, n.cost + x.cost AS cost, n.audit || x.letters AS audit,
      row_number() OVER (PARTITION BY n.conv_id, x.b ORDER BY n.cost + x.cost, n.audit || x.letters) AS place
    FROM (
      SELECT s.conv_id, t.i, s.state, s.cost + 4 AS cost, s.audit || 'D' AS audit FROM search AS s JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1
      UNION ALL
      SELECT s.conv_id, t.i, m.b, s.cost + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN e = 'R' THEN 3 ELSE 0 END, s.audit || e
      FROM search AS s JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND t.i = s.i + 1 JOIN moves AS m ON m.a = s.state, (VALUES ('K'), ('R')) AS edit(e)
      WHERE fault NOT IN ('blank', 'duplicate') AND CASE WHEN e = 'K' THEN left(t.role, 1) = m.b ELSE m.b <> 's' END) AS n
    JOIN added AS x ON x.a = n.state)
  WHERE place = 1),
best AS (
  SELECT s.conv_id, s.cost, s.audit
  FROM search AS s JOIN (SELECT ids.conv_id, count(turns.i) AS n FROM ids LEFT JOIN turns ON turns.conv_id IS NOT DISTINCT FROM ids.conv_id GROUP BY ALL) AS c ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.n
  WHERE s.state IN ('-', 'a') QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost, s.audit) = 1),
letters AS (
  SELECT conv_id, pos, audit[pos] AS e, sum(CASE WHEN audit[pos] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY pos) AS i
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS pos FROM best)),
kept AS (
  SELECT l.conv_id, pos, CASE WHEN e = 'K' THEN role END AS role, CASE WHEN e = 'I' THEN '' ELSE text END AS text, row_number() OVER o AS j, first_value(CASE WHEN e = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) OVER o AS system
  FROM letters AS l LEFT JOIN turns AS t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.i = l.i WHERE e <> 'D' WINDOW o AS (PARTITION BY l.conv_id ORDER BY pos)),
texts AS (
  SELECT conv_id, string_agg(coalesce(role, CASE WHEN (j - system) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS repaired FROM kept GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(CAST(max(turn)::HUGEINT - min(turn) + 1 - count(DISTINCT turn) AS BIGINT), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM turns GROUP BY conv_id)
SELECT best.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repairs(flagged(damaged(rows))).withColumn("repaired", F.sha2("repaired", 256)).withColumnRenamed("repaired", "repaired_sha256")
