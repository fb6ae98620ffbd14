"""The operators on conversations over the given table, and the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import prefix_trie, turn_repair
from almagest.llm.common import table


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with faults put in by CRC-32 of their key; those to be dropped are marked, so that their conversations stay known."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.col("kind")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", "role", "text", (F.crc32(key.cast("binary")) % 20).alias("kind"))
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind != 0).alias("stays"), F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )


def turn_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.audits(damaged(table(spark, sf_dir, "conversations")), F.col("stays"))


# CRC-32 in SQL: the usual table of 256 remainders, worked out by its rule, and one step per character.
CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)
  )
)"""


def crc_sql(key: str) -> str:
    """CRC-32 of an ASCII text; ``crc`` must be among the tables read."""
    codes = f"list_transform(string_split({key}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


def _cheapest_sql() -> str:
    """Cost and edits from each of the four states (start, system, user, assistant) before a turn, from those after it."""
    follows = (3, 3, 4, 3)  # states from 1

    def option(letter: str, cost: str, state: int, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {cost} + p[{state}].c, 'a': '{letter}' || p[{state}].a}} END"

    keeps = [[("s", 2), ("u", 3)], [("u", 3)], [("a", 4)], [("u", 3)]]
    moved = []
    for state in range(4):
        kept = [option("K", "late", to, f"NOT gone AND initial = '{i}'") for i, to in keeps[state]]
        options = [option("D", "3", state + 1), *kept, option("R", "2 + late", follows[state], "NOT gone")]
        moved.append(f"list_min([{', '.join(options)}])")
    inserted = []
    for state in range(4):
        once, twice = follows[state], follows[follows[state] - 1]
        inserted.append(
            f"list_min([b[{state + 1}], {{'c': 2 + b[{once}].c, 'a': 'I' || b[{once}].a}}, {{'c': 4 + b[{twice}].c, 'a': 'II' || b[{twice}].a}}])"
        )
    return f"[{', '.join(inserted)}] AS p FROM (SELECT conv, n - 1 AS n, [{', '.join(moved)}] AS b"


AUDIT_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations, crc
),
x AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM k WHERE kind <> 0
),
o AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), '') AS conv, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM x
),
f AS (
  SELECT *, trimmed = '' AS blank, trimmed <> '' AND again > 1 AS doubled, trimmed <> '' AND again = 1 AND right(trimmed, 1) NOT IN ('.', '!', '?') AS cut_off,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au') AS broken FROM o
),
s AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(doubled) AS duplicate,
    count_if(cut_off) AS truncated, count_if(broken) AS illegal, count(*) AS size FROM f GROUP BY conv
),
r AS (
  SELECT conv, size AS n, [{{'c': 0, 'a': ''}}, {{'c': 4, 'a': 'II'}}, {{'c': 2, 'a': 'I'}}, {{'c': 0, 'a': ''}}] AS p FROM s
  UNION ALL
  SELECT conv, n, {_cheapest_sql()} FROM (
    SELECT r.conv, r.n, r.p, f.initial, f.blank OR f.doubled AS gone, CAST(f.cut_off AS INTEGER) AS late FROM r JOIN f ON r.conv = f.conv AND r.n = f.n
  ))
),
a AS (SELECT conv, p[1].c AS cost, p[1].a AS audit FROM r WHERE n = 0),
l AS (SELECT conv, unnest(string_split(audit, '')) AS letter, unnest(range(len(audit))) AS spot FROM a WHERE audit <> ''),
w AS (
  SELECT *, count_if(letter <> 'I') OVER e AS n, count_if(letter <> 'D') OVER e AS place FROM l WINDOW e AS (PARTITION BY conv ORDER BY spot)
),
t AS (
  SELECT w.conv, w.letter, w.place, f.role, f.text, max(CASE WHEN w.letter = 'K' AND w.place = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY w.conv) AS shift
  FROM w LEFT JOIN f ON w.conv = f.conv AND w.n = f.n WHERE w.letter <> 'D'
),
h AS (
  SELECT conv, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - shift) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS digest FROM t GROUP BY conv
)
SELECT i.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
  coalesce(s.illegal, 0) AS illegal, CAST(coalesce(a.cost, 0) AS BIGINT) AS cost, coalesce(a.audit, '') AS audit, coalesce(h.digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM conversations) i
LEFT JOIN s ON s.conv = i.conv LEFT JOIN a ON a.conv = i.conv LEFT JOIN h ON h.conv = i.conv
"""


# Conversations of one block of numbers begin like its first.
DONORS = 20
LENT = 4


def lent_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % LENT).cast("int")


def rebuilt(listed: DataFrame) -> DataFrame:
    """Conversations whose first turns are those of the first of their block, as far as it has them."""
    donors = listed.where(F.col("conv_id") % DONORS == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, LENT - 1).alias("lent"))
    takes = lent_turns(F.col("conv_id"))
    own = listed.withColumn("donor", F.col("conv_id") - F.col("conv_id") % DONORS).withColumn("takes", takes)
    met = own.join(donors, "donor", "left")
    lent = F.coalesce(F.slice("lent", F.lit(1), F.col("takes")), F.array().cast(listed.schema["turns"].dataType))
    rest = F.slice("turns", F.col("takes") + 1, F.greatest(F.size("turns") - F.col("takes"), F.lit(0)))
    return met.select("conv_id", F.concat(lent, rest).alias("turns"))


def prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(rebuilt(prefix_trie.sequences(table(spark, sf_dir, "conversations"))))


PREFIX_SQL = f"""
WITH {CRC_TABLE},
d AS (
  SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS words FROM conversations WHERE conv_id IS NOT NULL
),
l AS (SELECT conv_id, list({{'g': digest, 'w': words}} ORDER BY turn NULLS FIRST, digest) AS turns FROM d GROUP BY conv_id),
h AS (SELECT l.*, {crc_sql("CAST(conv_id AS VARCHAR)")} % {LENT} AS takes FROM l, crc),
r AS (
  SELECT h.conv_id, list_concat(coalesce(o.turns[1 : h.takes], []), h.turns[h.takes + 1 :]) AS turns
  FROM h LEFT JOIN l o ON o.conv_id = h.conv_id - h.conv_id % {DONORS}
),
p AS (
  SELECT conv_id, depth, array_to_string(list_transform(turns[1 : depth], lambda x: x.g), '') AS node, turns[depth].w AS words, depth = len(turns) AS ends
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM r)
),
n AS (
  SELECT node, depth, left(node, 32 * (depth - 1)) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(words), 0) AS words,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM p GROUP BY node, depth
),
c AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (node)),
u AS (SELECT node, n_children, (n_convs - 1) * words AS saved, left(node, 32 * k) AS above FROM (SELECT *, unnest(range(depth + 1)) AS k FROM m)),
s AS (SELECT above AS node, count_if(n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u GROUP BY above)
SELECT m.conv_id, m.depth, b.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves, s.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s USING (node) LEFT JOIN n b ON m.depth > 0 AND b.node = m.parent
"""

QUERIES = {
    "op12_turn_repair": (turn_audits, AUDIT_SQL),
    "op13_prefix_trie": (prefixes, PREFIX_SQL),
}
