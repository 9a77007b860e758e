"""Repair of conversations whose turns were lost, repeated, emptied or mislabelled.

A conversation should read ``(s?(ua)+)?`` by the initials of its roles: a system turn or
none, then turns of user and assistant in pairs. Windows flag the faults of turns; the
turns of a conversation are collected in order, and a fold from the last to the first
carries, for each of the four states of that pattern, the cheapest way on from there: its
cost and its audit, a letter for each edit. A way is one letter and then the best way on,
so ties by the audit's letters are settled exactly, which a fold from the front would not do.

A conversation is one row: its repaired text is one value by definition. Rows of one
conversation meet once, in one shuffle by ``conv_id``, which windows and the collection share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a text without any other character is blank by.
SPACES = " \t\n\x0b\x0c\r"
END = ".!?"
#: Costs of edits, and of keeping a truncated turn.
DELETE, REROLE, INSERT, CUT = 3, 2, 2, 1
#: The states of the pattern: nothing yet, after s, after u, after a. Where a user or
#: assistant turn leads from each, and where turns that are kept lead by their initial.
NEXT = (2, 2, 3, 2)
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The ways on at the end: nothing, or insertions up to a full pair.
LAST = ((0, ""), (4, "II"), (2, "I"), (0, ""))


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, alive): turns damaged by the crc32 of ``conv_id:turn`` modulo
    20: 0 drops the turn (not ``alive``), 1 empties its text, 2 takes its full stops, 3 repeats
    it, 4 makes its role user. Nulls in key, role and text read as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", END, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "fate")
    times = F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", "role", "text", (F.col("fate") != 0).alias("alive"), F.explode(times).alias("copy")).drop("copy")


def flagged(turns: DataFrame) -> DataFrame:
    """Adds ``at``, a turn's place, ``initial`` of its role, its first fault as ``blank``,
    ``duplicate`` or ``truncated``, ``illegal`` next to the turn before, and ``new_turn``."""
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    own = Window.partitionBy("conv_id", "alive").orderBy(*order, "seen")  # of equal turns, the first isn't seen before
    same = Window.partitionBy("conv_id", "alive", "role", "text").orderBy(*order)
    seen = F.row_number().over(same) > 1
    rows = turns.repartition("conv_id").withColumn("seen", seen).withColumn("at", F.row_number().over(own)).withColumn("initial", F.substring("role", 1, 1))
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    rows = rows.withColumn("last", last).withColumn("blank", F.col("last") == "").withColumn("duplicate", ~F.col("blank") & F.col("seen"))
    rows = rows.withColumn("truncated", ~F.col("blank") & ~F.col("seen") & ~F.col("last").isin(*END))
    before = F.lag("initial").over(own)
    rows = rows.withColumn("illegal", before.isNotNull() & ~F.concat(before, F.col("initial")).isin("su", "ua", "au"))
    new = F.col("turn").isNotNull() & ((F.col("at") == 1) | ~F.lag("turn").over(own).eqNullSafe(F.col("turn")))
    return rows.withColumn("new_turn", new)


def _way(cost, letters: str, on: Column) -> Column:
    return F.struct((F.lit(cost) + on["cost"]).cast("long").alias("cost"), F.concat(F.lit(letters), on["audit"]).alias("audit"))


def _consumed(state: int, ways: Column, turn: Column) -> Column:
    """The best way on from ``state`` that begins with an edit of ``turn``."""
    cut = F.when(turn["truncated"], CUT).otherwise(0)
    may = ~(turn["blank"] | turn["duplicate"])
    options = [_way(DELETE, "D", ways[f"s{state}"]), F.when(may, _way(REROLE + cut, "R", ways[f"s{NEXT[state]}"]))]
    options += [F.when(may & (turn["initial"] == c), _way(cut, "K", ways[f"s{to}"])) for c, to in KEPT[state].items()]
    return F.least(*options)  # nulls are passed over


def _back(ways: Column, turn: Column) -> Column:
    """The ways on before ``turn`` from those after it, with insertions before it: two at most,
    as a third would lead where the first led."""
    best = [_consumed(k, ways, turn) for k in range(4)]
    put = lambda n, k: _way(n * INSERT, "I" * n, best[k])
    found = [F.least(best[0], put(1, 2), put(2, 3)), F.least(best[1], put(1, 2), put(2, 3)), F.least(best[2], put(1, 3)), F.least(best[3], put(1, 2))]
    return F.struct(*[f.alias(f"s{k}") for k, f in enumerate(found)])


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of flagged turns, ties by the audit."""
    end = F.struct(*[F.struct(F.lit(c).cast("long").alias("cost"), F.lit(a).alias("audit")).alias(f"s{k}") for k, (c, a) in enumerate(LAST)])
    return F.aggregate(F.reverse(turns), end, _back)["s0"]


def edited(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that an audit's edits leave or make."""
    upto = lambda k: F.substring(audit, F.lit(1), k)
    edits = F.transform(
        F.when(F.length(audit) > 0, F.sequence(F.lit(1), F.length(audit))).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(F.substring(audit, k, F.lit(1)).alias("edit"), F.length(F.replace(upto(k), F.lit("I"), F.lit(""))).alias("row"), F.length(F.replace(upto(k), F.lit("D"), F.lit(""))).alias("out")),
    )
    first = F.length(audit) - F.length(F.ltrim(audit, F.lit("D"))) + 1  # the first edit that leaves a turn
    lead = F.when((F.substring(audit, first, F.lit(1)) == "K") & (F.get(turns, first - 1)["initial"] == "s"), 1).otherwise(0)
    made = lambda e: F.when((e["out"] - lead) % 2 == 1, "user").otherwise("assistant")
    own = lambda e: F.get(turns, e["row"] - 1)
    return F.transform(
        F.filter(edits, lambda e: e["edit"] != "D"),
        lambda e: F.struct(F.when(e["edit"] == "K", own(e)["role"]).otherwise(made(e)).alias("role"), F.when(e["edit"] == "I", "").otherwise(own(e)["text"]).alias("text")),
    )


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) for each
    conversation of turns(conv_id, turn, role, text) with or without ``alive``.

    Turns stand in order of ``turn`` (nulls first), then role and text; rows that repeat are
    turns of their own, and faulty as such. ``gaps`` counts numbers missing between the least
    and the greatest turn. ``repaired`` is an array of (role, text). A conversation without
    living turns gives zeros, an empty audit and no turns; a null ``conv_id`` is a
    conversation like any other; an empty table gives no rows. A role's initial decides, so an
    empty role is neither. Columns besides these aren't looked at.
    """
    alive = F.col("alive") if "alive" in turns.columns else F.lit(True)
    rows = flagged(turns.select("conv_id", "turn", "role", "text", alive.alias("alive")))
    turn = F.struct("at", "role", "text", "initial", "blank", "duplicate", "truncated")
    n = lambda c: F.count_if(F.col(c) & F.col("alive")).alias(c)
    living = F.when(F.col("alive"), F.col("turn"))
    each = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(living) - F.min(living) + 1 - F.count_if(F.col("new_turn") & F.col("alive")), F.lit(0)).cast("long").alias("gaps"),
        *[n(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.array_sort(F.collect_list(F.when(F.col("alive"), turn))).alias("turns"),
    )
    each = each.withColumn("way", cheapest(F.col("turns"))).withColumns({"cost": F.col("way")["cost"], "audit": F.col("way")["audit"]})
    return each.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", edited(F.col("turns"), F.col("audit")).alias("repaired"))


def digest(repaired: DataFrame) -> DataFrame:
    """``repaired`` as the sha256 of its ``role:text`` lines, and the number of its turns."""
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return repaired.withColumn("n_turns", F.size("repaired").cast("long")).withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).drop("repaired")


# ------------------------------------------------------------------ the same in DuckDB SQL

_CRC = "xor(list_reduce(list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(a, b)), CAST(4294967295 AS BIGINT)), 4294967295)"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _sql_way(cost: str, letters: str, on: str) -> str:
    return f"{{'c': {cost} + {on}.c, 'a': '{letters}' || {on}.a}}"


def _sql_best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _sql_consumed(state: int) -> str:
    kept = " ".join(f"WHEN t.initial = '{c}' THEN {_sql_way('t.cut', 'K', f'w.s{to}')}" for c, to in KEPT[state].items())
    gone, new = _sql_way(str(DELETE), "D", f"w.s{state}"), _sql_way(f"{REROLE} + t.cut", "R", f"w.s{NEXT[state]}")
    return f"CASE WHEN t.must THEN {gone} ELSE {_sql_best(gone, new, f'CASE {kept} ELSE {gone} END')} END AS b{state}"


def _sql_put(n: int, state: int) -> str:
    return _sql_way(str(n * INSERT), "I" * n, f"b{state}")


SQL = f"""WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
fated AS (SELECT conv_id, turn, role, text, {_CRC} % 20 AS fate FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM fated, range(0, 2) copy WHERE fate <> 0 AND (copy.range = 0 OR fate = 3)),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM hurt),
placed AS (SELECT *, row_number() OVER w AS place, right(rtrim(text, {_SPACES}), 1) AS last, substr(role, 1, 1) AS initial,
  lag(substr(role, 1, 1)) OVER w AS before FROM met WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
flagged AS MATERIALIZED (SELECT *, last = '' AS blank, last <> '' AND seen AS duplicate, last NOT IN ('', '.', '!', '?') AND NOT seen AS truncated, before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au') AS illegal,
  last = '' OR seen AS must, CASE WHEN last NOT IN ('', '.', '!', '?') AND NOT seen THEN {CUT} ELSE 0 END AS cut FROM placed),
ids AS (SELECT conv_id, count(f.place) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id AS own, place FROM flagged) f ON f.own IS NOT DISTINCT FROM c.conv_id GROUP BY 1),
ways AS (SELECT conv_id, n AS place, {", ".join(f"{{'c': CAST({c} AS BIGINT), 'a': '{a}'}} AS s{k}" for k, (c, a) in enumerate(LAST))} FROM ids
UNION ALL SELECT conv_id, place - 1, {_sql_best("b0", _sql_put(1, 2), _sql_put(2, 3))}, {_sql_best("b1", _sql_put(1, 2), _sql_put(2, 3))}, {_sql_best("b2", _sql_put(1, 3))}, {_sql_best("b3", _sql_put(1, 2))}
  FROM (SELECT w.conv_id, w.place, {", ".join(_sql_consumed(k) for k in range(4))} FROM ways w JOIN flagged t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.place = w.place)),
found AS MATERIALIZED (SELECT conv_id, s0.c AS cost, s0.a AS audit FROM ways WHERE place = 0),
edits AS (SELECT conv_id, k.range AS k, audit[k.range] AS edit, length(replace(audit[1 : k.range], 'I', '')) AS nth, length(replace(audit[1 : k.range], 'D', '')) AS out FROM found, range(1, 1 + (SELECT max(length(audit)) FROM found)) k WHERE k.range <= length(audit)),
led AS (SELECT f.conv_id, count(t.place) AS lead FROM found f LEFT JOIN flagged t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.place = length(audit) - length(ltrim(audit, 'D')) + 1 AND t.initial = 's' AND audit[t.place] = 'K' GROUP BY 1),
lines AS (SELECT e.conv_id, e.k, CASE WHEN edit = 'K' THEN t.role WHEN (e.out - led.lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE t.text END AS line
  FROM edits e JOIN led ON led.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN flagged t ON t.conv_id IS NOT DISTINCT FROM e.conv_id AND t.place = e.nth WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS text, count(*) AS n FROM lines GROUP BY 1),
faults AS (SELECT conv_id AS own, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate, count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM flagged GROUP BY 1)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(t.n, 0) AS n_turns, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM found f LEFT JOIN faults x ON x.own IS NOT DISTINCT FROM f.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM f.conv_id"""
