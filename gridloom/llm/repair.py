"""Repair of conversations: the cheapest edits that give roles a legal order, by a fold over each conversation's turns.

DataFrame functions only. A legal order of role initials is ``(s?(ua)+)?``: nothing, or an
optional system turn and then user and assistant in turns. After some of its turns a
conversation is in one of four states: nothing yet (z), after the system turn (s), after a user's
(u) or after an assistant's (a). ``aggregate`` carries the cheapest (cost, edits) of each; a
turn's step keeps, re-roles or deletes the turn, after an insertion where the state needs one. No
insertion stands before a deletion: after it, it costs as much and reads as less.

Edits are written as letters whose order is that of the edits' initials: D, I (user) and J
(assistant) for Insert, K, R (user) and S (assistant) for Rerole. At the end of a step
every string has one letter of D, K, R, S for each turn and ends with one, so none begins another
and ``least`` on (cost, edits) picks what stays least whatever follows. A state fixes the role
of an inserted or re-roled turn, so the letters alone rebuild the conversation.

Faults come from windows and patterns on rows that are dealt by conversation once; the fold reads
small structs, and the texts are touched again only where the repaired conversation is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sharding import CRC_TABLE, crc_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: A cost that no conversation reaches.
NEVER = 1 << 40
#: One row in so many meets each kind of damage.
DAMAGE = 20


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, again, dropped) of ``turns`` after damage by crc32("conv_id:turn") % 20; nulls count as one space.

    0 drops a row (it stays, with ``dropped``), 1 empties its text, 2 removes its full stops, exclamation and question
    marks, 3 repeats it (``again`` is 0, then 1), 4 makes its role user.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % DAMAGE
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("again"), (F.col("kind") == 0).alias("dropped"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Add ``nth`` (of the conversation's rows with this role and text) and ``fault``: blank, duplicate or truncated, the first that holds; else null.

    A row is a duplicate if its role and text are those of an earlier one; rows are ordered by turn, nulls first.
    """
    seen = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.asc_nulls_first("turn"), "again")
    rows = turns.repartition("conv_id").withColumn("nth", F.row_number().over(seen))  # window and fold need no other exchange
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    )
    return rows.withColumn("fault", fault)


def _least(*options: tuple[Column, int | Column, str]) -> Column:
    """The least of (state, cost more, letters more)."""
    found = [F.struct((s["cost"] + c).alias("cost"), F.concat(s["edits"], F.lit(e)).alias("edits")) for s, c, e in options]
    return F.least(*found) if len(found) > 1 else found[0]


def _step(now: Column, row: Column) -> Column:
    """The four states after one turn, from the four before it."""
    z, s, u, a = (now[k] for k in "zsua")
    more = F.when(row["truncated"], TRUNCATED).otherwise(0)
    keep = lambda x: F.when(~row["gone"] & (row["initial"] == x), KEEP + more).otherwise(F.lit(NEVER))
    put = F.when(row["gone"], F.lit(NEVER)).otherwise(REROLE + more)
    user, assistant = ((keep("u"), "K"), (put, "R")), ((keep("a"), "K"), (put, "S"))
    return F.struct(
        _least((z, DELETE, "D")).alias("z"),
        _least((s, DELETE, "D"), (z, keep("s"), "K")).alias("s"),
        _least((u, DELETE, "D"), *[(x, c, e) for x in (z, s, a) for c, e in user], *[(u, INSERT + c, "J" + e) for c, e in user]).alias("u"),
        _least((a, DELETE, "D"), *[(u, c, e) for c, e in assistant], *[(x, INSERT + c, "I" + e) for x in (z, s, a) for c, e in assistant]).alias("a"),
    )


def cheapest_edits(rows: Column) -> Column:
    """(cost, edits) for an array of (initial, gone, truncated); gone rows are to be deleted."""
    state = lambda cost: F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("edits"))
    start = F.struct(state(0).alias("z"), *[state(NEVER).alias(k) for k in "sua"])
    end = lambda now: _least((now["z"], 0, ""), (now["a"], 0, ""), (now["u"], INSERT, "J"), (now["s"], 2 * INSERT, "IJ"))
    return F.aggregate(rows, start, _step, end)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def repaired_turns(edits: Column, rows: Column) -> Column:
    """What ``edits`` leave of ``rows``: an array of (role, text)."""
    letters = lambda x: F.filter(F.split(x, ""), lambda y: y != "")
    inserted = lambda x: F.transform(letters(x), lambda y: _turn(F.when(y == "I", "user").otherwise("assistant"), F.lit("")))

    def after(token: Column, row: Column) -> Column:
        letter = F.right(token, F.lit(1))
        role = F.when(letter == "R", "user").when(letter == "S", "assistant").otherwise(row["role"])
        own = F.filter(F.array(_turn(role, row["text"])), lambda _: letter != "D")
        return F.concat(inserted(F.rtrim(token, F.lit("DKRS"))), own)

    tokens = F.regexp_extract_all(edits, F.lit("[IJ]*[DKRS]"), F.lit(0))
    return F.concat(F.flatten(F.zip_with(tokens, rows, after)), inserted(F.regexp_extract(edits, "([IJ]*)$", 1)))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation in ``turns``.

    ``turns`` has (conv_id, turn, role, text) and may have ``again``, which orders rows that are equal otherwise, and
    ``dropped``, for rows that only name their conversation. A null role or text counts as one space; null turns come first; rows of
    one turn are ordered by role and text; a null conv_id is a conversation. Other columns are ignored, and
    an empty table gives no rows.

    Faults are counted by the first of each row. gaps: turns missing between the least and the largest, ignoring nulls.
    illegal: neighbours whose role initials aren't su, ua or au. cost, audit: of the cheapest edits, Keep 0, Rerole 3,
    Delete 4 (blank and duplicate rows must go), Insert 3, and 3 for a truncated row that stays; audit has their initials
    in order, the least by ASCII among equal costs. repaired: an array of (role, text). A conversation is one row, as its audit is.
    """
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    there = {c.lower() for c in turns.columns}
    extra = [F.col("again") if "again" in there else F.lit(0).alias("again"), F.col("dropped") if "dropped" in there else F.lit(False).alias("dropped")]
    rows = with_faults(turns.select("conv_id", "turn", space("role"), space("text"), *extra))
    live = lambda c: F.when(~F.col("dropped"), c)
    is_ = lambda kind: F.count_if(~F.col("dropped") & (F.col("fault") == kind)).alias(kind)
    one = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(live(F.struct("turn", "role", "text", "nth", "fault")))).alias("turns"), is_("blank"), is_("duplicate"), is_("truncated")
    )
    given = F.filter(F.transform("turns", lambda t: t["turn"]), lambda x: x.isNotNull())
    gaps = F.coalesce(F.array_max(given) - F.array_min(given) + 1 - F.size(F.array_distinct(given)), F.lit(0)).cast("long")
    fault = lambda t, *kinds: F.coalesce(t["fault"].isin(*kinds), F.lit(False))
    small = F.transform(
        "turns",
        lambda t: F.struct(
            F.substring(t["role"], 1, 1).alias("initial"), fault(t, "blank", "duplicate").alias("gone"), fault(t, "truncated").alias("truncated")
        ),
    )
    next_ = F.slice("small", F.lit(2), F.size("small"))
    pairs = F.zip_with("small", next_, lambda x, y: F.concat(x["initial"], y["initial"]))
    illegal = F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long")
    one = one.withColumns({"gaps": gaps, "small": small}).withColumns({"illegal": illegal, "best": cheapest_edits(F.col("small"))})
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    edits = F.col("best.edits")
    return one.select(
        "conv_id", *counts, F.col("best.cost").alias("cost"), F.translate(edits, "JS", "IR").alias("audit"), repaired_turns(edits, F.col("turns")).alias("repaired")
    )


def digests(rows: DataFrame) -> DataFrame:
    """``rows`` of ``repair_conversations`` with ``repaired_sha256`` in place of ``repaired``: of role:text of each turn, joined by newlines."""
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return rows.withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("repaired")


def _least_sql(*options: tuple[str, str, str, str]) -> str:
    found = [f"{{'c': {s}.c + {c}, 'e': {s}.e || '{e}', 'r': {s}.r || {r}}}" for s, c, e, r in options]
    return f"list_min([{', '.join(found)}])"


def _repair_sql() -> str:
    never = str(NEVER)
    keep = lambda x: f"(CASE WHEN fault IN ('blank', 'duplicate') OR left(role, 1) <> '{x}' THEN {never} WHEN fault = 'truncated' THEN 3 ELSE 0 END)"
    put = f"(CASE WHEN fault IN ('blank', 'duplicate') THEN {never} WHEN fault = 'truncated' THEN 6 ELSE 3 END)"
    line = lambda role: f"{role} || ':' || text || chr(10)"
    ins = lambda role: f"'{role}:' || chr(10)"
    user = lambda x, cost="0", e="", r="''": [(x, f"{cost} + {keep('u')}", f"{e}K", f"{r} || {line('role')}"), (x, f"{cost} + {put}", f"{e}R", f"{r} || {line(chr(39) + 'user' + chr(39))}")]
    bot = lambda x, cost="0", e="", r="''": [(x, f"{cost} + {keep('a')}", f"{e}K", f"{r} || {line('role')}"), (x, f"{cost} + {put}", f"{e}R", f"{r} || {line(chr(39) + 'assistant' + chr(39))}")]
    gone = lambda x: (x, "4", "D", "''")
    steps = {
        "z": [gone("z")],
        "s": [gone("s"), ("z", keep("s"), "K", line("role"))],
        "u": [gone("u"), *user("z"), *user("s"), *user("a"), *user("u", "3", "I", ins("assistant"))],
        "a": [gone("a"), *bot("u"), *[x for k in "zsa" for x in bot(k, "3", "I", ins("user"))]],
    }
    end = _least_sql(("z", "0", "", "''"), ("a", "0", "", "''"), ("u", "3", "I", ins("assistant")), ("s", "6", "II", f"{ins('user')} || {ins('assistant')}"))
    state = lambda cost, k: f"{{'c': {cost}::BIGINT, 'e': '', 'r': ''}} AS {k}"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE {CRC_TABLE},
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql(key)} % 20 AS kind
  FROM conversations, crc_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS place,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, again) AS nth
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) || left(role, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank,
    count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM faults GROUP BY conv_id),
fold AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS place, {state(0, 'z')}, {state(never, 's')}, {state(never, 'u')}, {state(never, 'a')}
  FROM conversations
  UNION ALL
  SELECT fold.conv_id, fold.place + 1, {', '.join(f"{_least_sql(*v)} AS {k}" for k, v in steps.items())}
  FROM fold JOIN faults ON fold.conv_id IS NOT DISTINCT FROM faults.conv_id AND faults.place = fold.place + 1),
ends AS (SELECT conv_id, place, {end} AS best FROM fold)
SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.e AS audit,
  sha256(CASE WHEN best.r = '' THEN '' ELSE left(best.r, length(best.r) - 1) END) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
WHERE ends.place = coalesce(n, 0)
"""


REPAIR_SQL = _repair_sql()
