"""Secrets in texts, told from examples by who owns them.

Patterns give candidates: assignments, access keys, hexadecimal strings, and tokens of mixed
characters. A candidate's value is hashed, and its hash counted over the whole corpus by
owner and by repository (a document): what many owners hold is an example that people copy;
a token that one owner alone holds, and looks like a key, is that owner's secret. The
patterns' own spans always stay; tokens are added where they have one owner.

DataFrame functions only. Texts leave in the task that reads them: their spans are written
as a slim table, and only rows with candidates are shuffled. Counts are summed by (hash,
owner) before they meet by hash; both sides of the join are tables, so that a hash with many
rows can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds as they are listed, with pattern, the group that holds the value, and its least length.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = (
    ("assign", ASSIGN, 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
OWNED = 3
#: Characters a token must have: capitals, small letters, three digits, and so many different ones.
DIFFERENT = 12
#: Owners from which a value counts as copied widely.
MANY_OWNERS = 3
#: Spans whose lengths are summed in one go.
BLOCK = 64
SPAN = "struct<start:int,kind:int,end:int,hash:string>"


def prefix_sums(lengths: Column) -> Column:
    """Sums of the elements before each one. Blocks are summed first, so that the work is
    near linear in the array's length."""
    n = F.size(lengths)
    total = lambda a: F.aggregate(a, F.lit(0), lambda t, x: t + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    start = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("sum"))
    starts = F.aggregate(blocks, start, lambda a, x: F.struct(F.concat(a["all"], F.array(a["sum"])).alias("all"), (a["sum"] + x).alias("sum")))["all"]
    within = lambda x, i: F.get(starts, F.floor(i / BLOCK).cast("int")) + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    return F.transform(lengths, within)


def _looks_live(value: Column) -> Column:
    kinds = value.rlike("[A-Z]") & value.rlike("[a-z]") & value.rlike("[0-9].*[0-9].*[0-9]")
    return kinds & (F.size(F.array_distinct(F.split(value, ""))) >= DIFFERENT)


def _placed(kind: int, name: str):
    """From the number of a hit, its span."""
    before, steps, values = (f"{name}_{part}" for part in ("before", "steps", "values"))

    def span(i: Column) -> Column:
        start = F.get(before, i) + F.get(steps, i)["gap"]
        return F.struct(start.cast("int").alias("start"), F.lit(kind).alias("kind"), (start + F.get(steps, i)["long"]).cast("int").alias("end"), F.get(values, i).alias("hash"))

    return span


def _long(least: int):
    return lambda s: F.length(s["hash"]) >= least


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def with_spans(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(row, doc_id, owner, spans): every row's candidate spans (start, kind, end, hash), in
    code points, as found by each kind's pattern from left to right without overlap. Tokens
    that overlap a span of another kind, or don't look like keys, aren't candidates."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern, _, _ in KINDS:
        rows = rows.withColumn(f"{name}_hits", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    for k, (name, pattern, group, least) in enumerate(KINDS):
        # what stands between hits, with the hits' own lengths, gives their places
        hits, some = F.col(f"{name}_hits"), F.size(f"{name}_hits") > 0
        steps = F.zip_with(F.slice(F.split("text", pattern, -1), F.lit(1), F.size(hits)), hits, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("long")))
        values = F.regexp_extract_all("text", F.lit(pattern), F.lit(group)) if group else hits
        rows = rows.withColumn(f"{name}_steps", F.when(some, steps)).withColumn(f"{name}_values", F.when(some, values))
        rows = rows.withColumn(f"{name}_before", F.when(some, prefix_sums(F.transform(f"{name}_steps", lambda s: s["gap"] + s["long"]))))
        found = F.transform(F.sequence(F.lit(0), F.size(hits) - 1), _placed(k, name))
        found = F.filter(found, _long(least))
        rows = rows.withColumn(name, F.when(some, found).otherwise(F.array().cast(f"array<{SPAN}>")))
    base = F.concat(*[F.col(name) for name, *_ in KINDS[:OWNED]])
    free = F.filter(F.col(KINDS[OWNED][0]), lambda s: _looks_live(s["hash"]) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    hashed = F.transform(F.concat(base, free), lambda s: F.struct(s["start"], s["kind"], s["end"], F.substring(F.sha2(s["hash"].cast("binary"), 256), 1, 32).alias("hash")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", hashed.cast(f"array<{SPAN}>").alias("spans"))


def owners(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories) of spans(row, owner, hash): owners that hold a value (null
    is one), and rows that do."""
    each = spans.groupBy("hash", "owner").agg(F.count_distinct("row").alias("rows"))
    return each.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("rows").alias("repositories"))


def scan(docs: DataFrame, owner: str = "source") -> DataFrame:
    """(doc_id, spans array of (start, kind, end, hash, owners, repositories) in order of start
    and kind) for every row.

    A null text is empty; a text without spans has an empty array; rows that repeat are rows
    of their own, each a repository; a null owner is an owner; an empty table gives no rows.
    Columns besides doc_id, text and the owner's aren't looked at.
    """
    found = common.materialise(with_spans(docs, owner), "spans")
    long = found.filter(F.size("spans") > 0).select("row", "doc_id", "owner", F.explode("spans").alias("s")).select("row", "doc_id", "owner", "s.*")
    long = common.materialise(long, "candidates")
    verdict = common.materialise(owners(long), "owners")
    span = F.struct("start", "kind", "end", "hash", "owners", "repositories")
    told = long.join(verdict, "hash").filter((F.col("kind") < OWNED) | (F.col("owners") == 1))
    told = told.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans"))
    # tokens of other owners leave some rows without spans
    with_some, without = F.exists("spans", lambda s: s["kind"] < OWNED), F.size("spans") == 0
    only_tokens = found.filter(~with_some & ~without).select("row", "doc_id").join(told.select("row"), "row", "left_anti")
    empty = found.filter(without).select("doc_id").unionByName(only_tokens.select("doc_id"))
    return told.select("doc_id", "spans").unionByName(empty.withColumn("spans", F.array().cast(told.schema["spans"].dataType)))


def digest(found: DataFrame) -> DataFrame:
    """Numbers of spans by kind, spans as ``kind:start:end``, and the sha256 of those of the
    patterns; how many values have one owner, and how many are copied widely."""
    base = lambda s: s["kind"] < OWNED
    n = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    names = F.array(*[F.lit(name) for name, *_ in KINDS])
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return found.select(
        "doc_id",
        *[n(_of_kind(k)).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        F.sha2(say(F.filter("spans", base)).cast("binary"), 256).alias("base_sha256"),
        say(F.col("spans")).alias("spans"),
        n(lambda s: s["owners"] == 1).alias("n_one_owner"),
        n(lambda s: s["owners"] >= MANY_OWNERS).alias("n_copied"),
    )


# ------------------------------------------------------------------ the same in DuckDB SQL

_ASSIGN_SQL = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _sql_kind(k: int) -> str:
    name, pattern, group, least = KINDS[k]
    pattern, group = (_ASSIGN_SQL, 2) if group else (pattern, 0)
    at = "list_sum(list_transform(gaps[1 : i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda h: length(h))), 0)"
    return f"""SELECT row, doc_id, source, CAST({at} AS BIGINT) AS first, {k} AS kind, CAST({at} + length(hits[i]) AS BIGINT) AS past, vals[i] AS val
FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT row, doc_id, source, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals FROM texts)) WHERE length(vals[i]) >= {least}"""


SQL = f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED ({" UNION ALL ".join(_sql_kind(k) for k in range(OWNED))}),
tokens AS ({_sql_kind(OWNED)}),
live AS (SELECT * FROM tokens t WHERE regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[0-9].*[0-9].*[0-9]') AND len(list_distinct(string_split(val, ''))) >= {DIFFERENT}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = t.row AND b.first < t.past AND t.first < b.past)),
cands AS MATERIALIZED (SELECT * FROM base UNION ALL SELECT * FROM live),
held AS (SELECT val, count(*) AS owners FROM (SELECT DISTINCT val, source FROM cands) GROUP BY 1),
told AS MATERIALIZED (SELECT c.*, h.owners, CASE kind {" ".join(f"WHEN {k} THEN '{name}'" for k, (name, *_) in enumerate(KINDS))} END || ':' || first || ':' || past AS said FROM cands c JOIN held h ON h.val = c.val WHERE kind < {OWNED} OR owners = 1)
SELECT t.doc_id, {", ".join(f"count(*) FILTER (WHERE kind = {k}) AS n_{name}" for k, (name, *_) in enumerate(KINDS))},
sha256(coalesce(string_agg(said, ',' ORDER BY first, kind) FILTER (WHERE kind < {OWNED}), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY first, kind), '') AS spans,
count(*) FILTER (WHERE owners = 1) AS n_one_owner, count(*) FILTER (WHERE owners >= {MANY_OWNERS}) AS n_copied
FROM texts t LEFT JOIN told s ON s.row = t.row GROUP BY t.row, t.doc_id"""
