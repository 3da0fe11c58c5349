"""Repair of conversation structure by weighted CYK interval parsing.

A well-formed conversation has the role initials (s?(ua)+)?. Its four states are
start, after s, after u and after a; the grammar has a symbol for each pair of
states, with the rules (p, q) -> (p, r) (r, q) in Chomsky normal form. The symbol
derives a span of rows if edits of the span lead from p to q. A cell holds the
cheapest edits of a span for every symbol, as cost and audit (the edits'
initials: Keep, Rerole, Delete, Insert), ties by the least audit. Cells of single
rows are closed under insertions on both sides; cells of longer spans are combined
bottom-up by span length. A symbol that derives a span derives its parts at every
cut, so one cut per span is enough, and spans of 1, 2, 4, 8 ... rows give the whole
conversation in n steps. Among edits of one cost no audit is the beginning of
another, so least audits of parts make the least audit of the whole.

Counts and order: rows of a conversation are ordered by turn, nulls first, then by
further columns that the caller names. Equal rows are one row with a number of
copies, so a row that repeats without end is counted before it is shuffled. A
conversation's rows stream through one task, with one letter a row in memory.

Rows without conversation id are a conversation of their own. A role that starts
with none of s, u, a can't be kept; neither can an empty one. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.llm.base import query
from tabweave.llm.exact_dedup import WHITE
from tabweave.llm.frames import documents, shuffle_tasks, stored
from tabweave.llm.prefix_trie import CRC_SQL, crc_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: (state, role initial) -> state; start and after-a are final.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = range(4)
FLUSH_BYTES = 2 << 20
CACHED_ROWS = 64

Cell = tuple[tuple[tuple[int, str] | None, ...], ...]


def cell_of(edits: Sequence[tuple[int, int, int, str]]) -> Cell:
    """The cell with the cheapest of (from, to, cost, audit) per symbol."""
    return tuple(tuple(min(((c, a) for x, y, c, a in edits if (x, y) == (p, q)), default=None) for q in STATES) for p in STATES)


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out = []
    for row in left:
        line = []
        for q in STATES:
            best = None
            for r in STATES:
                if row[r] is not None and right[r][q] is not None:
                    (a, x), (b, y) = row[r], right[r][q]
                    if best is None or a + b <= best[0]:
                        found = (a + b, x + y)
                        best = found if best is None else min(best, found)
            line.append(best)
        out.append(tuple(line))
    return tuple(out)


@functools.cache
def insertions() -> Cell:
    """The cell of an empty span: any number of inserted users and assistants."""
    none = [(p, p, 0, "") for p in STATES]
    one = [(p, q, INSERT, "I") for (p, letter), q in STEPS.items() if letter in "ua"]
    closure = cell_of(none + one)
    for _ in STATES:
        closure = combined(closure, closure)
    return closure


@functools.cache
def leaf(kind: str) -> Cell:
    """The cell of one row. Kinds: d must go; s, u, a, x by role initial, in capitals where truncated."""
    edits = [(p, p, DELETE, "D") for p in STATES]
    if kind != "d":
        extra = TRUNCATED if kind.isupper() else 0
        for (p, letter), q in STEPS.items():
            if letter == kind.lower():
                edits.append((p, q, KEEP + extra, "K"))
            if letter in "ua":
                edits.append((p, q, REROLE + extra, "R"))
    return combined(combined(insertions(), cell_of(edits)), insertions())


def cheapest(kinds: str) -> tuple[int, str]:
    """Cost and audit of a conversation with rows of these kinds."""
    return _cheapest(kinds) if len(kinds) <= CACHED_ROWS else _cheapest.__wrapped__(kinds)


@functools.lru_cache(maxsize=1 << 14)
def _cheapest(kinds: str) -> tuple[int, str]:
    cells = [leaf(k) for k in kinds] or [insertions()]
    while len(cells) > 1:
        pairs = [combined(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = pairs + cells[len(cells) - len(cells) % 2 :]
    return min(cells[0][0][q] for q in FINAL if cells[0][0][q] is not None)


def roles(audit: str) -> Iterator[str]:
    """The role initial of each row that the edits leave: their number says whether a system row leads."""
    left = len(audit) - audit.count("D")
    if left % 2:
        yield "s"
    for i in range(left - left % 2):
        yield "ua"[i % 2]


STATS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation of sorted rows; a row of no copies only names its conversation."""
    names = [c.split(" ")[0] for c in STATS.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()]
    current: object = audited
    found: list[tuple] = []
    blank = duplicate = truncated = illegal = distinct = 0
    low = high = last_turn = last_initial = None
    kinds: list[str] = []

    def close() -> None:
        cost, audit = cheapest("".join(kinds))
        gaps = high - low + 1 - distinct if distinct else 0
        found.append((current, gaps, blank, duplicate, truncated, illegal, cost, audit))

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)
        found.clear()
        return out

    columns = ["conv_id", "turn", "initial", "times", "fault"]
    for batch in batches:
        for conv, turn, initial, times, fault in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if conv != current:
                if current is not audited:
                    close()
                current, kinds, low, high, last_turn, last_initial = conv, [], None, None, None, None
                blank = duplicate = truncated = illegal = distinct = 0
            if not times:
                continue
            if turn is not None and turn != last_turn:
                low, high, last_turn, distinct = turn if low is None else low, turn, turn, distinct + 1
            if kinds and last_initial + initial not in ("su", "ua", "au"):
                illegal += 1
            illegal, last_initial = illegal + times - 1, initial
            blank += times * (fault == "blank")
            duplicate += (times - 1) * (fault != "blank") + (fault == "duplicate")
            truncated += fault == "truncated"
            kind = initial if initial in ("s", "u", "a") else "x"
            kinds.append("d" if fault in ("blank", "duplicate") else kind.upper() if fault == "truncated" else kind)
            kinds.append("d" * (times - 1))
        if found:
            yield flush()
    if current is not audited:
        close()
        yield flush()


def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired rows of sorted rows, each conversation's led by a row with its audit."""
    current: object = edited
    audit, at, place, size = "", 0, 0, 0
    wanted: Iterator[str] = iter(())
    out: list[tuple] = []
    names = {"u": "user", "a": "assistant"}

    def put(role: str | None, text: str) -> None:
        nonlocal at, size
        initial = next(wanted)
        out.append((current, at, names[initial] if role is None else role, text))
        at, size = at + 1, size + len(text) + 64

    def insert() -> None:
        nonlocal place
        while audit[place : place + 1] == "I":
            put(None, "")
            place += 1

    def flush() -> pa.RecordBatch:
        nonlocal size
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["conv_id", "at", "role", "text"])
        out.clear()
        size = 0
        return rows

    columns = ["conv_id", "audit", "role", "text", "times"]
    for batch in batches:
        for conv, letters, role, text, times in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if letters is not None:
                insert()
                current, audit, at, place, wanted = conv, letters, 0, 0, roles(letters)
                continue
            for _ in range(times):
                insert()
                if audit[place] != "D":
                    put(role if audit[place] == "K" else None, text)
                place += 1
            if size > FLUSH_BYTES:
                yield flush()
    insert()
    if out:
        yield flush()


def line_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's ``role:text`` lines, in order."""
    current: object = line_hashes
    state = hashlib.sha256()
    for batch in batches:
        done = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            line = f"{role}:{text}".encode()
            if conv != current:
                if current is not line_hashes:
                    done.append((current, state.hexdigest()))
                current, state = conv, hashlib.sha256(line)
            else:
                state.update(b"\n" + line)
        if done:
            yield _hashes(done)
    if current is not line_hashes:
        yield _hashes([(current, state.hexdigest())])


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    conv, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(digest)], ["conv_id", "sha256"])


class Repairs:
    """Repairs of ``rows``: conv_id, turn, role, text, times (how often the row stands there), without nulls in role and text.

    ``ties`` name further columns that order rows of one turn. A row of no times
    makes sure that its conversation has a result.
    """

    def __init__(self, rows: DataFrame, ties: Sequence[str] = ("role", "text")) -> None:
        self.tasks = shuffle_tasks(rows.sparkSession)
        self.order = [F.asc_nulls_first("turn"), *ties]
        seen = F.row_number().over(Window.partitionBy("conv_id", "role", "text", F.col("times") > 0).orderBy(*self.order)) > 1
        end = F.rtrim(F.col("text"), F.lit(WHITE))
        fault = F.when(end == "", "blank").when(seen, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
        columns = dict.fromkeys(["conv_id", "turn", "role", "text", "times", *ties])
        self.rows = stored(rows.select(*columns, fault.alias("fault")), "repair-rows")

    def audits(self) -> DataFrame:
        """One row per conversation: gaps, faults by kind, illegal neighbours, cost and audit."""
        dealt = self.rows.repartition(self.tasks, "conv_id").sortWithinPartitions("conv_id", F.col("times") > 0, *self.order)
        narrow = dealt.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "times", "fault")
        return stored(narrow.mapInArrow(audited, STATS), "audits")

    def repaired(self, audits: DataFrame) -> DataFrame:
        """The rows after the edits, in order within each partition: conv_id, at (from 0), role, text."""
        heads = audits.select("conv_id", "audit").withColumns({c: F.lit(None) for c in self.rows.columns if c != "conv_id"})
        rows = heads.unionByName(self.rows.filter("times > 0").withColumn("audit", F.lit(None)))
        dealt = rows.repartition(self.tasks, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *self.order)
        narrow = dealt.select("conv_id", "audit", "role", "text", "times")
        return narrow.mapInArrow(edited, "conv_id long, at long, role string, text string")

    def digests(self, repaired: DataFrame) -> DataFrame:
        """SHA-256 of each repaired conversation's ``role:text`` lines; conversations without rows have none."""
        return repaired.mapInArrow(line_hashes, "conv_id long, sha256 string")


def damaged(conversations: DataFrame, parts: int = 20) -> DataFrame:
    """Rows with faults put in by a checksum of ``conv_id:turn``: dropped, emptied, without ends, repeated, another role."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), shown[2].alias("own_role"), shown[3].alias("own_text"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    kind = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % parts
    return rows.select(
        "conv_id",
        "turn",
        "own_role",
        "own_text",
        F.when(kind == 4, "user").otherwise(F.col("own_role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("own_text", ".!?", "")).otherwise(F.col("own_text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, F.col("n") * 2).otherwise(F.col("n")).alias("times"),
    )


def _closed_sql() -> tuple[str, str]:
    """The grammar's edits and insertions as SQL values (kind, from, to, cost, letter) and (from, to, cost, letters)."""
    edits = [("d", p, p, DELETE, "D") for p in STATES]
    for kind in "suaxSUAX":
        extra = TRUNCATED if kind.isupper() else 0
        edits += [(kind, p, p, DELETE, "D") for p in STATES]
        edits += [(kind, p, q, KEEP + extra, "K") for (p, x), q in STEPS.items() if x == kind.lower()]
        edits += [(kind, p, q, REROLE + extra, "R") for (p, x), q in STEPS.items() if x in "ua"]
    inserts = [(p, q, *cell) for p, row in enumerate(insertions()) for q, cell in enumerate(row) if cell]
    return ", ".join(map(repr, edits)), ", ".join(map(repr, inserts))


_EDITS, _INSERTS = _closed_sql()
_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

SQL = rf"""
WITH RECURSIVE {CRC_SQL}, raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0, {crc_sql(_KEY)} % 20 AS n
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, role0, text0, CASE n WHEN 4 THEN 'user' ELSE role0 END AS role,
         CASE n WHEN 1 THEN '' WHEN 2 THEN translate(text0, '.!?', '') ELSE text0 END AS text
  FROM raw, (SELECT unnest(range(2)) AS copy) WHERE n <> 0 AND (copy = 0 OR n = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0) AS i,
         regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS t, substr(role, 1, 1) AS c FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), faults AS (
  SELECT *, CASE WHEN t = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM seen
), kinds AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'd' WHEN fault = 'truncated' THEN upper(k) ELSE k END AS kind
  FROM (SELECT *, CASE WHEN c IN ('s', 'u', 'a') THEN c ELSE 'x' END AS k FROM faults)
), edits(kind, p, q, cost, letter) AS (
  VALUES {_EDITS}
), inserts(p, q, cost, letters) AS (
  VALUES {_INSERTS}
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, q, {{'cost': cost, 'audit': letters}} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations), inserts WHERE p = 0
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, s.q, min({{'cost': (dp.best).cost + e.cost + s.cost, 'audit': (dp.best).audit || e.letter || s.letters}})
  FROM dp JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM dp.conv_id AND k.i = dp.i + 1
  JOIN edits e ON e.kind = k.kind AND e.p = dp.q JOIN inserts s ON s.p = e.q
  GROUP BY dp.conv_id, dp.i, s.q
), final AS (
  SELECT conv_id, min(best) AS best FROM dp d
  WHERE q IN (0, 3) AND i = (SELECT count(*) FROM kinds k WHERE k.conv_id IS NOT DISTINCT FROM d.conv_id) GROUP BY conv_id
), letters AS (
  SELECT conv_id, pos, letter, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS o, n_out
  FROM (SELECT conv_id, pos, (best).audit[pos] AS letter, length(replace((best).audit, 'D', '')) AS n_out
        FROM (SELECT *, unnest(range(1, length((best).audit) + 1)) AS pos FROM final))
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), lines AS (
  SELECT l.conv_id, pos, CASE WHEN letter = 'K' THEN k.role WHEN (o - n_out % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN letter = 'I' THEN '' ELSE k.text END AS line
  FROM letters l LEFT JOIN kinds k ON letter <> 'I' AND k.conv_id IS NOT DISTINCT FROM l.conv_id AND k.i = l.i WHERE letter <> 'D'
), repaired AS (
  SELECT conv_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM lines GROUP BY conv_id
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv_id
)
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, (best).cost::BIGINT AS cost, (best).audit AS audit,
       sha256(coalesce(r.text, '')) AS repaired_sha256
FROM final f LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM f.conv_id
"""


@query("op13_repair", SQL)
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    repairs = Repairs(damaged(documents(spark, sf_dir, "conversations")), ("own_role", "own_text"))
    audits = repairs.audits()
    digests = repairs.digests(repairs.repaired(audits)).withColumnRenamed("conv_id", "id")
    found: Column = F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return audits.join(digests.hint("merge"), F.col("conv_id").eqNullSafe(F.col("id")), "left").select(*audits.columns, found)
