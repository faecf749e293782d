"""Conversation structure repair: the cheapest edits that make the roles of a
conversation read ``(s?(ua)+)?``, by a dynamic program over persistent audits.

After each row the program keeps, for each of four states (nothing yet, after
system, after user, after assistant), the cheapest edits so far. Edits are
linked nodes that share their prefixes; a node knows a rolling hash of the
edits up to it and its ancestors at distances 1, 2, 4, ..., so two audits of
equal cost are compared at the end of their longest common prefix, found by
binary lifting and verified against hash collisions. What all states share is
decided and leaves memory, so long conversations stream through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WS

#: Costs of the edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: Rows held before decided edits are handed on.
HOLD = 4096
_PRIME, _BASE = (1 << 61) - 1, 911382323
_BLANK = re.compile(rf"[{WS}]*\Z")
_ENDS = re.compile(rf"[.!?][{WS}]*\Z")


class Node:
    """The last edit of an audit; ``up[k]`` is the audit less ``2**k`` edits."""

    __slots__ = ("up", "edit", "depth", "hash", "row", "role")

    def __init__(self, parent: Node | None, edit: str = "", row: int = -1, role: str = ""):
        self.edit, self.row, self.role = edit, row, role
        if parent is None:
            self.up, self.depth, self.hash = (), 0, 0
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * _BASE + ord(edit)) % _PRIME
        up, at = [parent], parent
        while len(at.up) >= len(up):
            at = at.up[len(up) - 1]
            up.append(at)
        self.up = tuple(up)


def ancestor(node: Node, depth: int) -> Node:
    while node.depth > depth:
        node = node.up[(node.depth - depth).bit_length() - 1]
    return node


def edits_of(node: Node, root: Node | None = None) -> list[Node]:
    path = []
    while node is not root and node.up:
        path.append(node)
        node = node.up[0]
    return path[::-1]


def audit_less(a: Node, b: Node) -> bool:
    """Whether the edits up to ``a`` are less than those up to ``b``, in
    ASCII order; a proper prefix is less."""
    n = min(a.depth, b.depth)
    x, y = ancestor(a, n), ancestor(b, n)
    if x.hash != y.hash:
        for k in reversed(range(len(x.up))):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        p, q = x.up[0], y.up[0]
        while p is not q and p.edit == q.edit:  # the common prefix itself, not its hash
            p, q = p.up[0], q.up[0]
        if p is q:
            return x.edit < y.edit
    else:
        p, q = x, y
        while p is not q and p.edit == q.edit:
            p, q = p.up[0], q.up[0]
        if p is q:
            return a.depth < b.depth
    return [e.edit for e in edits_of(a)] < [e.edit for e in edits_of(b)]  # hashes collided


def _common(nodes: list[Node]) -> Node:
    """The last edit that all audits share as one node."""
    low = min(n.depth for n in nodes)
    nodes = [ancestor(n, low) for n in nodes]
    while any(n is not nodes[0] for n in nodes):
        for k in reversed(range(len(nodes[0].up))):
            if any(n.up[k] is not nodes[0].up[k] for n in nodes):
                nodes = [n.up[k] for n in nodes]
                break
        else:
            nodes = [n.up[0] for n in nodes]
    return nodes[0]


class Repair:
    """One conversation: :meth:`add` rows in order, take :meth:`decided`
    edits at any time and the rest from :meth:`finish`."""

    def __init__(self):
        self.root = Node(None)
        self.layer = {START: (0, self.root)}
        self.n = 0
        self.cost = 0
        self._insert()

    def _offer(self, into: dict, state: int, cost: int, parent: Node, edit: str, row: int, role: str) -> None:
        have = into.get(state)
        if have is None or cost < have[0]:
            into[state] = (cost, Node(parent, edit, row, role))
        elif cost == have[0]:
            node = Node(parent, edit, row, role)
            if audit_less(node, have[1]):
                into[state] = (cost, node)

    def _insert(self) -> None:
        changed = True
        while changed:
            before = dict(self.layer)
            for state, (cost, node) in before.items():
                to, role = (ASSISTANT, "a") if state == USER else (USER, "u")
                if to not in self.layer or cost + INSERT <= self.layer[to][0]:
                    self._offer(self.layer, to, cost + INSERT, node, "I", -1, role)
            changed = any(before.get(s) is not found for s, found in self.layer.items())
        # after an assistant everything can follow but a system row, which costs a DELETE there: what is dearer than
        # that cannot win, and its audit need not be held
        for state, more in ((START, DELETE), (SYSTEM, 0)):
            if state in self.layer and ASSISTANT in self.layer and self.layer[state][0] > self.layer[ASSISTANT][0] + more:
                del self.layer[state]

    def add(self, initial: str, delete: bool, truncated: bool) -> None:
        new: dict = {}
        more = TRUNCATED if truncated else 0
        for state, (cost, node) in self.layer.items():
            if not delete:
                to, role = (ASSISTANT, "a") if state == USER else (USER, "u")
                if initial == role:
                    self._offer(new, to, cost + more, node, "K", self.n, "")
                else:
                    self._offer(new, to, cost + more + REROLE, node, "R", self.n, role)
                    if state == START and initial == "s":
                        self._offer(new, SYSTEM, cost + more, node, "K", self.n, "")
            self._offer(new, state, cost + DELETE, node, "D", self.n, "")
        self.layer, self.n = new, self.n + 1
        self._insert()

    def decided(self) -> list[Node]:
        """Edits that every open audit begins with; they are forgotten here."""
        last = _common([node for _, node in self.layer.values()])
        out = edits_of(last)
        root, made = Node(None), {}
        made[id(last)] = root
        for state, (cost, node) in self.layer.items():
            for e in edits_of(node, last):
                if id(e) not in made:
                    made[id(e)] = Node(made[id(e.up[0])], e.edit, e.row, e.role)
            self.layer[state] = (cost, made[id(node)])
        self.root = root
        return out

    def finish(self) -> list[Node]:
        best = None
        for state in (START, ASSISTANT):
            if state in self.layer:
                cost, node = self.layer[state]
                if best is None or cost < best[0] or cost == best[0] and audit_less(node, best[1]):
                    best = (cost, node)
        self.cost = best[0]
        return edits_of(best[1])


def faults(text: str, seen: bool) -> tuple[bool, bool, bool]:
    """Whether a row is blank, a duplicate, truncated: the first that holds."""
    if _BLANK.match(text):
        return True, False, False
    return False, seen, not seen and not _ENDS.search(text)


def _sorted_rows(turns: DataFrame) -> DataFrame:
    """Rows of a conversation in order, with the first turn of the same role
    and text. Duplicates are found by counts of hashes, combined before they
    are shuffled, so no task holds a conversation's texts for it."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    first = (rows.groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first"))
    rows = rows.join(first, F.expr("conv_id <=> _conv and said = _said"), "left")
    later = F.expr("first is not null and not (turn <=> first.turn)")
    return (rows.select("conv_id", "turn", "role", "text", F.coalesce(later, F.lit(False)).alias("later"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))


def _streamed(rows: DataFrame, schema: str, types: list, sink) -> DataFrame:
    """Feed each conversation of the sorted ``rows`` through :class:`Repair`.
    ``sink(conv_id)`` takes ``(edit, turn, role, text)`` in order by ``put``,
    and gives its finished rows by ``take(summary or None)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        state = None

        def emit(edits) -> None:
            nonlocal state
            for e in edits:
                turn, role, text = state["held"].pop(e.row, (None, "", ""))
                state["sink"].put(e.edit, turn, ROLES.get(e.role, role), text)

        def close() -> None:
            emit(state["dp"].finish())
            t = state["turns"]
            gaps = t[1] - t[0] + 1 - t[2] if t else 0
            out.extend(state["sink"].take((gaps, *state["n"], state["dp"].cost)))

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *types])], names=names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, turn, role, text, later in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or state["conv"] != conv:
                    if state:
                        close()
                    state = {"conv": conv, "dp": Repair(), "held": {}, "sink": sink(conv), "n": [0, 0, 0, 0], "turns": None,
                             "last": None, "before": None}
                blank, duplicate, truncated = faults(text, later or state["last"] == (turn, role, text))
                n, initial, dp = state["n"], role[:1], state["dp"]
                n[0] += blank
                n[1] += duplicate
                n[2] += truncated
                n[3] += state["before"] is not None and state["before"] + initial not in LEGAL
                state["before"], state["last"] = initial, (turn, role, text)
                if turn is not None:
                    t = state["turns"]
                    state["turns"] = (turn, turn, 1) if t is None else (t[0], turn, t[2] + (turn != t[1]))
                state["held"][dp.n] = (turn, role, text)
                dp.add(initial, blank or duplicate, truncated)
                if len(state["held"]) >= HOLD and dp.n % HOLD == 0:
                    emit(dp.decided())
                    out.extend(state["sink"].take(None))
                if len(out) >= 2000:
                    yield batch_of()
        if state:
            close()
        if out:
            yield batch_of()

    names = ["conv_id", *[c.split()[0] for c in schema.split(", ")]]
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {schema}")


class _Edits:
    def __init__(self, conv):
        self.conv, self.step, self.rows = conv, 0, []

    def put(self, edit, turn, role, text):
        self.rows.append((self.conv, self.step, edit, turn, role, text))
        self.step += 1

    def take(self, summary):
        rows, self.rows = self.rows, []
        return rows


class _Digest:
    def __init__(self, conv):
        self.conv, self.audit, self.sha, self.any = conv, [], hashlib.sha256(), False

    def put(self, edit, turn, role, text):
        self.audit.append(edit)
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True

    def take(self, summary):
        self.audit = ["".join(self.audit)]
        return [] if summary is None else [(self.conv, *summary, self.audit[0], self.sha.hexdigest())]


def edits(turns: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of ``turns`` (``conv_id``,
    ``turn`` integer, ``role``, ``text``), one row per edit: ``conv_id``,
    ``step`` (from 0), ``edit`` (``K`` keep, ``R`` rerole, ``D`` delete, ``I``
    insert), ``turn``, ``role`` (the new one) and ``text``. The rows other
    than ``D`` in order of ``step`` are the repaired conversation.

    Rows go by ``turn`` (nulls first), then role, then text. Null role or
    text: empty, so the row is blank or of no legal role. Null ``conv_id``: one
    conversation. Repeated rows are duplicates of the first. A role counts by
    its first character. Equal costs: the ASCII-least audit. Empty table: no
    rows. Other columns are not read. Conversations that need no row left
    (all deleted) keep their ``D`` rows.

    A conversation is one audit, so one task reads it in order; only the rows
    on which its open audits differ, and at least ``HOLD``, stay in memory.
    """
    rows = _sorted_rows(turns)
    return _streamed(rows, "step long, edit string, turn long, role string, text string",
                     [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()], _Edits)


def audits(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns``, as :func:`edits` repairs it: ``gaps``
    (missing numbers between its least and greatest turn), rows that are
    ``blank``, else ``duplicate``, else ``truncated``, ``illegal`` (adjacent
    roles not su, ua or au), the repair's ``cost`` and ``audit``, and
    ``repaired_sha256`` (of the repaired ``role:text``, newline-joined)."""
    return _streamed(_sorted_rows(turns), "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                     "audit string, repaired_sha256 string", [pa.int64()] * 6 + [pa.string()] * 2, _Digest)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage to ``conversations``, by the crc32 of
    ``conv_id:turn``; nulls read as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    rows = turns.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.where("kind <> 0").withColumn("_", F.explode(times)).select("conv_id", "turn", "role", "text")


#: DuckDB: crc32 by its table, and the program over (cost, audit) of four states as columns.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind FROM raw, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM kinds, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS u(k) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS j FROM d),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY j) > 1 AS again,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY j) || left(role, 1) AS pair FROM o),
g AS (SELECT *, again AND NOT blank AS dup, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut,
    left(role, 1) AS i, CASE WHEN NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 5 ELSE 0 END AS e,
    blank OR again AS del FROM f),
c AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
p(conv_id, j, n0, ns, nu, na) AS (
  SELECT conv_id, 0::BIGINT, {'c': 0, 'w': ''}, {'c': 1000000000, 'w': 'Z'}, {'c': 5, 'w': 'I'}, {'c': 10, 'w': 'II'} FROM c
  UNION ALL
  SELECT conv_id, j, n0, ns, nu3, na2 FROM (
   SELECT conv_id, j, n0, ns, na2, list_min([nu2, {'c': na2.c + 5, 'w': na2.w || 'I'}]) AS nu3 FROM (
    SELECT conv_id, j, n0, ns, nu2, list_min([na1, {'c': nu2.c + 5, 'w': nu2.w || 'I'}]) AS na2 FROM (
     SELECT conv_id, j, n0, ns, na1, list_min([nu1, {'c': n0.c + 5, 'w': n0.w || 'I'}, {'c': ns.c + 5, 'w': ns.w || 'I'},
            {'c': na1.c + 5, 'w': na1.w || 'I'}]) AS nu2 FROM (
      SELECT p.conv_id, g.j, {'c': n0.c + 2, 'w': n0.w || 'D'} AS n0,
       list_min([{'c': ns.c + 2, 'w': ns.w || 'D'}, CASE WHEN NOT del AND i = 's' THEN {'c': n0.c + e, 'w': n0.w || 'K'} END]) AS ns,
       list_min([{'c': nu.c + 2, 'w': nu.w || 'D'}] || CASE WHEN del THEN [] WHEN i = 'u' THEN
         [{'c': n0.c + e, 'w': n0.w || 'K'}, {'c': ns.c + e, 'w': ns.w || 'K'}, {'c': na.c + e, 'w': na.w || 'K'}] ELSE
         [{'c': n0.c + e + 1, 'w': n0.w || 'R'}, {'c': ns.c + e + 1, 'w': ns.w || 'R'}, {'c': na.c + e + 1, 'w': na.w || 'R'}] END) AS nu1,
       list_min([{'c': na.c + 2, 'w': na.w || 'D'}, CASE WHEN del THEN NULL WHEN i = 'a' THEN {'c': nu.c + e, 'w': nu.w || 'K'}
         ELSE {'c': nu.c + e + 1, 'w': nu.w || 'R'} END]) AS na1
      FROM p JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND g.j = p.j + 1))))),
b AS (SELECT p.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, list_min([n0, na]) AS best
      FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.j = c.n),
a AS (SELECT conv_id, best.w AS audit, k, substr(best.w, k, 1) AS x FROM b, unnest(range(1, length(best.w) + 1)) AS u(k)),
s AS (SELECT conv_id, k, x, count(*) FILTER (x <> 'I') OVER w AS j, count(*) FILTER (x <> 'D') OVER w AS m FROM a
      WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
t AS (SELECT s.conv_id, s.k, s.x, s.m, CASE WHEN s.x <> 'I' THEN g.role END AS role, CASE WHEN s.x <> 'I' THEN g.text ELSE '' END AS text,
      bool_or(s.x = 'K' AND s.m = 1 AND g.i = 's') OVER (PARTITION BY s.conv_id) AS sys
      FROM s LEFT JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND s.j = g.j WHERE s.x <> 'D'),
r AS (SELECT conv_id, sha256(string_agg(CASE WHEN x = 'K' THEN role WHEN (m - CASE WHEN coalesce(sys, false) THEN 1 ELSE 0 END) % 2 = 1
        THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS sha FROM t GROUP BY conv_id)
SELECT q.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
       coalesce(best.w, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) q LEFT JOIN b ON q.conv_id IS NOT DISTINCT FROM b.conv_id
LEFT JOIN r ON q.conv_id IS NOT DISTINCT FROM r.conv_id
"""
