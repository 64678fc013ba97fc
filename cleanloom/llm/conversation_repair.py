"""Conversation structure repair by a DP over retained subsequences of turns.

1. All turns are range-sorted by conversation and turn, so one conversation may lie in many tasks; each turn gets a number in that
   order. A turn is a duplicate unless it has the smallest number of its (conversation, role, text digest), which is aggregated
   map-side and joined back by number, a key without repeats. A turn's fault and role initial are one sign.
2. Signs are joined within blocks of BLOCK numbers, and a conversation's blocks to one text: what is gathered for a conversation is one
   sign a turn, as is the audit that it returns; texts aren't gathered.
3. The DP goes over these signs from the right. A retained turn is kept or reroled; the gap to the next retained turn costs its
   deletions, a difference of prefix sums, so the best next turn of each role is a running minimum; the pair of roles gives the
   inserts. Of equal costs the ASCII-least audit wins: later turns first (more deletions), then more inserts, then Keep.
4. Edits go back in blocks; one pass over the sorted turns writes the repaired lines into a hash, with memory for one batch. As SHA-256
   is sequential, the turns of a conversation meet in one task there, as a stream that isn't held.

Roles are their first sign: s, u and a; others, and an empty role, can't be kept. Turns with an equal number in a conversation are
ordered by role and text. A null role or text is one space, a null turn comes first, and a null conv_id is a conversation of its own.
Repeated rows are turns like others (duplicates). Rows with no turn left give zeros, an empty audit and the hash of an empty text; an
empty table gives an empty result. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLOCK = 4096
NO_SIGN = r"^[\x20\x09-\x0D]*$"
#: Kinds of faults, and roles by the index of their initial; 3 is any other.
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
#: Cost of leaving a truncated turn in.
LEFT = 3
START, ROLES = 3, ("system", "user", "assistant")
#: Inserts between a retained role (or the start) and the next retained one, and before the end; None: never.
BETWEEN = ((None, 0, 1), (None, 1, 0), (None, 0, 1), (0, 0, 1))
AT_END = (2, 1, 0, 0)


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the checksum of conv_id and turn names."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """Written rows of conv_id, turn, role and text with rid, which rises in the order of conversation and turn."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    own = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return cut(own.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rid", F.monotonically_increasing_id()), "turns")


def signs(rows: DataFrame) -> DataFrame:
    """conv_id, rid and sign of each row: a hexadecimal digit of its fault and its role."""
    first = rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("fresh"))
    blank = F.col("text").rlike(NO_SIGN)
    open_ = ~F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "").rlike(r"[.!?]\z")
    initial = F.expr(f"case when role = '' then 3 else pmod(locate(left(role, 1), '{INITIALS}') - 1, 4) end")
    own = rows.select("conv_id", "rid", blank.alias("blank"), open_.alias("open"), initial.alias("initial"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("fresh").isNull(), DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    return own.join(first, "rid", "left").select("conv_id", "rid", F.lower(F.hex(4 * fault + F.col("initial"))).alias("sign"))


def gathered(marked: DataFrame) -> DataFrame:
    """conv_id and its blocks, an array of (block, signs) in order."""
    block = F.expr(f"rid div {BLOCK}")
    in_block = marked.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("rid", "sign"))).alias("each"))
    in_block = in_block.select("conv_id", F.struct("block", F.array_join(F.transform("each", lambda x: x["sign"]), "").alias("signs")).alias("part"))
    return in_block.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("blocks"))


def repair(signs: str) -> tuple[int, list[str]]:
    """The least cost and, for each turn, its edit with the inserts before it; the last item holds the inserts at the end."""
    n, codes = len(signs), [int(x, 16) for x in signs]
    # best[r]: least cost, with deletions counted from the first turn on, of going on at a turn retained as r; where[r]: the last such turn.
    far = DELETE * (n + 1) + 1_000_000_000
    best, where = [far] * 3, [n] * 3
    cost, follow, at = [0] * 4, bytearray(4 * (n + 1)), [array("q", bytes(8 * (n + 1))) for _ in range(3)]
    for j in range(n, -1, -1):
        if j < n:
            fault, own = divmod(codes[j], 4)
            if fault in (FINE, TRUNCATED):
                more = DELETE * j + (LEFT if fault == TRUNCATED else 0)
                for r in range(3):
                    here = more + cost[r] + (KEEP if own == r else REROLE) if own == r or r else far
                    if here < best[r]:
                        best[r], where[r] = here, j
        for r in range(3):
            at[r][j] = where[r]
        cost = [0] * 4
        for r in range(4):
            # Of equal costs: the end, then later turns, then more inserts, then Keep before Rerole.
            least, pick, rank = DELETE * (n - j) + INSERT * AT_END[r], 3, None
            for to in range(3):
                k = BETWEEN[r][to]
                if k is not None and best[to] < far:
                    total = best[to] - DELETE * j + INSERT * k
                    mine = (-where[to], -k, codes[where[to]] % 4 != to)
                    if total < least or total == least and rank is not None and mine < rank:
                        least, pick, rank = total, to, mine
            cost[r], follow[4 * j + r] = least, pick
    edits, j, r = [], 0, START
    while True:
        to = follow[4 * j + r]
        if to == 3:
            return cost[START], [*edits, *["D"] * (n - j), "I" * AT_END[r]]
        turn = at[to][j]
        edits += ["D"] * (turn - j)
        edits.append("I" * BETWEEN[r][to] + ("K" if codes[turn] % 4 == to else "R"))
        j, r = turn + 1, to


def _illegal(signs: str) -> int:
    legal = {(0, 1), (1, 2), (2, 1)}
    roles = [int(x, 16) % 4 for x in signs]
    return sum(pair not in legal for pair in zip(roles, roles[1:], strict=False))


def decisions(blocks: DataFrame) -> DataFrame:
    """Of each conversation its counts, cost and audit, and edits: an array of (rid of a block's begin, edits of the block's turns)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                parts = batch.column("blocks")[k].as_py()
                text = "".join(p["signs"] for p in parts)
                cost, edits = repair(text)
                faults = [int(x, 16) // 4 for x in text]
                done, at = [], 0
                for p in parts:
                    done.append({"rid": p["block"] * BLOCK, "edits": "".join(edits[at : at + len(p["signs"])])})
                    at += len(p["signs"])
                done[-1]["edits"] += edits[-1]
                counts = [[faults.count(f)] for f in (BLANK, DUPLICATE, TRUNCATED)]
                columns = [batch.column("conv_id").slice(k, 1), *map(pa.array, counts), pa.array([_illegal(text)]), pa.array([cost]), pa.array(["".join(edits)])]
                parts_type = pa.list_(pa.struct([("rid", pa.int64()), ("edits", pa.string())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array([done], parts_type)], ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "parts"])

    kind = blocks.schema["conv_id"].dataType.simpleString()
    return blocks.mapInArrow(run, f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<rid:bigint,edits:string>>")


class Repaired:
    """Lines of a repaired conversation, from its turns and the edits of their blocks in order."""

    def __init__(self) -> None:
        self.edits, self.at, self.state = "", 0, START

    def begin(self, edits: str) -> None:
        self.edits, self.at = edits, 0

    def turn(self, role: str, text: str) -> list[str]:
        """What the next turn becomes, with the inserts before it; those at the end go with the last turn."""
        out, last = [], len(self.edits.rstrip("I"))
        while self.at < len(self.edits):
            edit = self.edits[self.at]
            self.at += 1
            if edit == "K":
                self.state = INITIALS.index(role[0])
                out.append(f"{role}:{text}")
            elif edit != "D":
                self.state = 2 if self.state == 1 else 1
                out.append(f"{ROLES[self.state]}:{text if edit == 'R' else ''}")
            if edit != "I" and self.at < last:
                break
        return out


def repaired_lines(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id, rid and the lines (an array, empty for deleted turns) that each turn becomes."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rids, _, lines in _conversations(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(rids, pa.int64()), pa.array(lines, pa.list_(pa.string()))], ["conv_id", "rid", "lines"])

    return _streamed(rows, decided).mapInArrow(run, f"conv_id {kind}, rid long, lines array<string>")


def hashes(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256, of its repaired lines joined by line feeds."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, empty = None, hashlib.sha256(), True

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])

        for ids, _, fresh, lines in _conversations(batches):
            for k, (new, made) in enumerate(zip(fresh, lines, strict=True)):
                if new:
                    if conv is not None:
                        yield closed()
                    conv, digest, empty = ids.slice(k, 1), hashlib.sha256(), True
                for line in made:
                    digest.update(line.encode() if empty else b"\n" + line.encode())
                    empty = False
        if conv is not None:
            yield closed()

    return _streamed(rows, decided).mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _streamed(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """Turns sorted by conversation and number, with each block's edits before its first turn."""
    none = F.lit(None).cast("string")
    edits = decided.select("conv_id", F.explode("parts").alias("part")).select("conv_id", "part.rid", none.alias("role"), none.alias("text"), "part.edits")
    turns = rows.select("conv_id", "rid", "role", "text", none.alias("edits"))
    return turns.unionByName(edits).repartition("conv_id").sortWithinPartitions("conv_id", "rid", F.col("role").asc_nulls_first())


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[int], list[bool], list[list[str]]]]:
    """Of each batch its turns' conv_id and rid, whether a conversation begins there, and the lines that the turn becomes.

    A conversation goes on from batch to batch; nothing of it is held but the edits of a block.
    """
    own, known, started = Repaired(), None, False
    for batch in batches:
        ids = batch.column("conv_id")
        at, rids, fresh, lines = [], [], [], []
        columns = (batch.column(k).to_pylist() for k in ("conv_id", "rid", "role", "text", "edits"))
        for k, (conv, rid, role, text, edits) in enumerate(zip(*columns, strict=True)):
            if not started or conv != known:
                own, known, started, begins = Repaired(), conv, True, True
            if edits is not None:
                own.begin(edits)
                continue
            at.append(k)
            rids.append(rid)
            fresh.append(begins)
            lines.append(own.turn(role, text))
            begins = False
        yield ids.take(pa.array(at, pa.int64())), rids, fresh, lines


def audits(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of turns: the audit of rows, a table of numbered()."""
    decided = cut(decisions(gathered(signs(rows))), "repairs")
    spread = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    parts = [spread, decided.drop("parts"), hashes(rows, decided)]
    every = turns.select("conv_id").distinct()
    for part in parts:
        every = every.unionByName(part, allowMissingColumns=True)
    zero = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    blank = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    found = every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in (*zero, *blank)))
    return found.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zero), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in blank.items()))


def query(turns: DataFrame) -> DataFrame:
    return audits(turns, numbered(damaged(turns)))


def _add(state: str, cost: str, edits: str, lines: str) -> str:
    """A state of the SQL's DP, 'cost, audit, mark, lines', with more of each."""
    mark = f"instr({state}, chr(1))"
    return f"(lpad(({state}[:9]::BIGINT + {cost})::VARCHAR, 9, '0') || {state}[10:{mark} - 1] || {edits} || chr(1) || {state}[{mark} + 1:] || {lines})"


SQL = rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS tab),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (
  SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                              lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
  FROM keyed k, crc),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
         CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS r FROM d),
f AS (
  SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) AS last_r,
         CASE WHEN regexp_matches(text, '^[\x20\x09-\x0D]*$') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd'
              WHEN regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'f' ELSE 't' END AS fault FROM n),
-- For each role that comes last (none: 0, s, u, a) the least 'cost, audit, repaired lines', as one text that sorts alike.
dp AS (
  SELECT conv_id, 0::BIGINT AS pos, '000000000' || chr(1) AS p0, NULL::VARCHAR AS ps, NULL::VARCHAR AS pu, NULL::VARCHAR AS pa
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, pos, e0, es, eu, ea FROM (
    SELECT *, {_add('p0', '4', "'D'", "''")} AS e0,
      least({_add('ps', '4', "'D'", "''")}, CASE WHEN ok AND r = 's' THEN {_add('p0', 't', "'K'", 'line')} END) AS es,
      least({_add('pu', '4', "'D'", "''")},
        CASE WHEN ok THEN {_add('p0', 't + w_u', 'l_u', 'line_u')} END, CASE WHEN ok THEN {_add('ps', 't + w_u', 'l_u', 'line_u')} END,
        CASE WHEN ok THEN {_add('pa', 't + w_u', 'l_u', 'line_u')} END,
        CASE WHEN ok THEN {_add('pu', 't + w_u + 3', "'I' || l_u", "chr(10) || 'assistant:' || line_u")} END) AS eu,
      least({_add('pa', '4', "'D'", "''")},
        CASE WHEN ok THEN {_add('pu', 't + w_a', 'l_a', 'line_a')} END,
        CASE WHEN ok THEN {_add('p0', 't + w_a + 3', "'I' || l_a", "chr(10) || 'user:' || line_a")} END,
        CASE WHEN ok THEN {_add('ps', 't + w_a + 3', "'I' || l_a", "chr(10) || 'user:' || line_a")} END,
        CASE WHEN ok THEN {_add('pa', 't + w_a + 3', "'I' || l_a", "chr(10) || 'user:' || line_a")} END) AS ea
    FROM (
      SELECT dp.conv_id, f.pos, p0, ps, pu, pa, r, fault IN ('f', 't') AS ok, CASE fault WHEN 't' THEN 3 ELSE 0 END AS t,
             chr(10) || role || ':' || text AS line,
             CASE r WHEN 'u' THEN 0 ELSE 3 END AS w_u, CASE r WHEN 'u' THEN 'K' ELSE 'R' END AS l_u,
             chr(10) || CASE r WHEN 'u' THEN role ELSE 'user' END || ':' || text AS line_u,
             CASE r WHEN 'a' THEN 0 ELSE 3 END AS w_a, CASE r WHEN 'a' THEN 'K' ELSE 'R' END AS l_a,
             chr(10) || CASE r WHEN 'a' THEN role ELSE 'assistant' END || ':' || text AS line_a
      FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.pos = dp.pos + 1))),
fin AS (
  SELECT conv_id, least(p0, pa, {_add('pu', '3', "'I'", "chr(10) || 'assistant:'")},
                        {_add('ps', '6', "'II'", "chr(10) || 'user:' || chr(10) || 'assistant:'")}) AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS last FROM dp) WHERE last = 1),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (last_r IS NOT NULL AND last_r || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT fin.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best[:9]::BIGINT AS cost,
       best[10:instr(best, chr(1)) - 1] AS audit, sha256(best[instr(best, chr(1)) + 2:]) AS repaired_sha256
FROM fin LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM fin.conv_id
"""
