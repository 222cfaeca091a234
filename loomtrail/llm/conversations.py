"""Repair of the structure of conversations by a dynamic program over edits.

The rows of a conversation are read in order. For each state of the wanted form of roles the program keeps the cheapest
edits that lead there and, of equally cheap ones, the ASCII-least. Edit strings share their prefixes as linked nodes.
A node has its ancestors 1, 2, 4, ... letters before it; two strings are compared by searching for their longest common
prefix along these. A rolling hash finds the node of a string that is there already; its parent and letter are compared
too, so that strings with one hash stay apart and equal strings are always one node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Nodes from which on the part that all strings have in common is written out and dropped.
NODES = 1 << 14

_WHITE = "".join(SPACES)
_SENTENCE_ENDS = frozenset(".!?")
_LEGAL = frozenset(("su", "ua", "au"))
# States of the form (s?(ua)+)?: nothing yet, after s, after u, after a. What a kept initial leads to, and the role
# that an inserted or changed row must have, with where it leads.
_NOTHING, _SYSTEM, _USER, _DONE = range(4)
_KEPT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _DONE}, {"u": _USER})
_WANTED = (("user", _USER), ("user", _USER), ("assistant", _DONE), ("user", _USER))
# What reaching the end may cost more from the first state than from the second, whatever rows follow: from after an a, a
# second system message is deleted instead of kept, and a missing user is inserted, and so on.
_BEHIND = {(_DONE, _NOTHING): DELETE, (_DONE, _SYSTEM): 0, (_DONE, _USER): INSERT, (_USER, _NOTHING): INSERT + DELETE, (_USER, _SYSTEM): INSERT,
           (_USER, _DONE): INSERT, (_NOTHING, _DONE): 0, (_NOTHING, _SYSTEM): 0, (_NOTHING, _USER): INSERT}
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


class Edits:
    """Edit strings as nodes; node 0 is the empty one. ``prime`` is that of the rolling hash."""

    def __init__(self, prime: int = _PRIME) -> None:
        self.prime = prime
        self.letter, self.depth, self.hash = [""], [0], [0]
        self.before: list[list[int]] = [[]]
        self.known: dict[int, list[int]] = {}

    def longer(self, node: int, letter: str) -> int:
        """The node of the string of ``node`` with ``letter`` after it."""
        value = (self.hash[node] * _BASE + ord(letter)) % self.prime
        same = self.known.setdefault(value, [])
        for other in same:
            if self.letter[other] == letter and self.before[other][0] == node:
                return other
        before, at = [node], node
        while len(self.before[at]) >= len(before):
            at = self.before[at][len(before) - 1]
            before.append(at)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append(value)
        self.before.append(before)
        same.append(len(self.letter) - 1)
        return same[-1]

    def cut_to(self, node: int, depth: int) -> int:
        """The node of the first ``depth`` letters."""
        off = self.depth[node] - depth
        while off:
            node = self.before[node][off.bit_length() - 1]
            off -= 1 << (off.bit_length() - 1)
        return node

    def parting(self, a: int, b: int) -> tuple[int, int]:
        """The nodes of the first letters after the longest common prefix of two strings; equal ones if one is a prefix."""
        depth = min(self.depth[a], self.depth[b])
        a, b = self.cut_to(a, depth), self.cut_to(b, depth)
        if a != b:
            for k in range(len(self.before[a]) - 1, -1, -1):
                if k < len(self.before[a]) and self.before[a][k] != self.before[b][k]:
                    a, b = self.before[a][k], self.before[b][k]
        return a, b

    def less(self, a: int, b: int) -> bool:
        x, y = self.parting(a, b)
        return self.depth[a] < self.depth[b] if x == y else self.letter[x] < self.letter[y]

    def common(self, a: int, b: int) -> int:
        x, y = self.parting(a, b)
        return x if x == y else self.before[x][0]

    def said(self, node: int, after: int = 0) -> str:
        letters = []
        while node != after:
            letters.append(self.letter[node])
            node = self.before[node][0]
        return "".join(reversed(letters))


class Repair:
    """The repair of one conversation, row by row. It holds no texts: each state carries the digest of what is repaired so
    far, and 16 bytes tell whether a row was seen."""

    def __init__(self, edits: Edits | None = None, nodes: int = NODES) -> None:
        self.edits, self.nodes, self.limit = edits or Edits(), nodes, nodes
        self.audit: list[str] = []
        self.states = self._inserted({_NOTHING: (0, 0, None, "")})
        self.digests = self._digests({}, self.states, None)
        self.states = {q: s[:2] for q, s in self.states.items()}
        self.seen: set[bytes] = set()
        self.turns: list[int] = []
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and (not self.turns or turn != self.turns[1]):
            self.distinct += 1
            self.turns = [self.turns[0] if self.turns else turn, turn]
        if self.last is not None and self.last + role[:1] not in _LEGAL:
            self.illegal += 1
        self.last = role[:1]
        own = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        core = text.rstrip(_WHITE)
        blank, again = not core, own in self.seen
        truncated = not blank and not again and core[-1] not in _SENTENCE_ENDS
        self.seen.add(own)
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += truncated
        self._step(role, text, blank or again, TRUNCATED if truncated else 0)

    def _better(self, new: dict, to: int, cost: int, node: int, letter: str, came: tuple) -> bool:
        """Takes an edit if it is the cheapest way to a state or the least of the cheapest."""
        if to in new and new[to][0] < cost:
            return False
        longer = self.edits.longer(node, letter)
        if to in new and new[to][0] == cost and not self.edits.less(longer, new[to][1]):
            return False
        new[to] = (cost, longer, *came)
        return True

    def _inserted(self, new: dict) -> dict:
        changed = True
        while changed:
            changed = False
            for q in list(new):
                to = _WANTED[q][1]
                if to not in new or new[to][0] >= new[q][0] + INSERT:
                    changed |= self._better(new, to, new[q][0] + INSERT, new[q][1], "I", (q, "I"))
        return new

    def _step(self, role: str, text: str, must_go: bool, extra: int) -> None:
        new: dict = {}
        for q, (cost, node) in self.states.items():
            self._better(new, q, cost + DELETE, node, "D", (q, "D"))
            if not must_go:
                to = _KEPT[q].get(role[:1])
                if to is not None:
                    self._better(new, to, cost + KEEP + extra, node, "K", (q, "K"))
                self._better(new, _WANTED[q][1], cost + REROLE + extra, node, "R", (q, "R"))
        new = self._inserted(new)
        alive = {q: s for q, s in new.items() if not any(p in new and new[p][0] + more < s[0] for (p, of), more in _BEHIND.items() if of == q)}
        self.digests = self._digests(new, alive, (role, text))
        self.states = {q: s[:2] for q, s in alive.items()}
        if len(self.edits.letter) > self.limit:
            self._settle()

    def _digests(self, new: dict, alive: dict, row: tuple[str, str] | None) -> dict:
        """The digest of the repaired rows for each state that stays, from the state that its last edit began in."""
        steps, done = new or alive, {}

        def of(q: int):
            if q not in done:
                _, _, came, letter = steps[q]
                if letter == "I":
                    base, said = of(came), f"{_WANTED[came][0]}:"
                else:
                    base = self.digests[came] if row else hashlib.sha256()
                    said = None if letter in ("", "D") else f"{row[0] if letter == 'K' else _WANTED[came][0]}:{row[1]}"
                if said is not None:
                    base = base.copy()
                    base.update((said if came == _NOTHING else f"\n{said}").encode("utf-8", "surrogatepass"))
                done[q] = base
            return done[q]

        return {q: of(q) for q in alive}

    def _settle(self) -> None:
        """Writes out the letters that all states have in common, and keeps nodes for the rest only."""
        nodes = [node for _, node in self.states.values()]
        common = nodes[0]
        for node in nodes[1:]:
            common = self.edits.common(common, node)
        old, self.edits = self.edits, Edits(self.edits.prime)
        self.audit.append(old.said(common))
        for q, (cost, node) in self.states.items():
            new = 0
            for letter in old.said(node, common):
                new = self.edits.longer(new, letter)
            self.states[q] = (cost, new)
        self.limit = max(self.nodes, 2 * len(self.edits.letter))

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        best = None
        for q in (_NOTHING, _DONE):
            if q in self.states and (best is None or self.states[q][0] < self.states[best][0] or (self.states[q][0] == self.states[best][0] and self.edits.less(self.states[q][1], self.states[best][1]))):
                best = q
        cost, node = self.states[best]
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        audit = "".join(self.audit) + self.edits.said(node)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.digests[best].hexdigest())


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` as (conv_id, turn, role, text, copies), damaged by crc32 of ``id:turn`` modulo 20.

    0 drops the row (no copies), 1 empties its text, 2 takes ``.``, ``!`` and ``?`` from it, 3 makes two copies, 4 sets the
    role user. A null id or turn stands as one space in the hash, a null role or text as one space.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hurt = F.crc32(F.concat(plain(id_col), F.lit(":"), plain(turn_col)).cast("binary")) % 20
    text = F.when(hurt.isin(0, 1), "").when(hurt == 2, F.translate(plain(text_col), ".!?", "")).otherwise(plain(text_col))
    role = F.when(hurt == 4, "user").otherwise(plain(role_col))
    copies = F.when(hurt == 0, 0).when(hurt == 3, 2).otherwise(1)
    return rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, copies): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows of a conversation are taken by turn (nulls first), then role and text, each ``copies`` times in a row; one
    without any copy only says that its conversation exists. Null conv_ids are one conversation; null roles, texts and
    copies count as one space, one space and 1. A row without text, or which says again what a role said before, must go. A role
    without letters can't be kept. Empty conversations have zeros, an empty audit and the digest of an empty string. An
    empty table gives no rows; other columns are not read.

    The audit and the digest of a conversation are each one sequence, so that its rows pass through one task, sorted and
    one by one; nothing is kept of a text but digests. Edit strings are written out as far as all states agree.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    keyed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), plain("role"), plain("text"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    out_type = None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal out_type
        open_id, repair, done = None, None, []

        def batch_of(results: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*results, strict=True))
            types = [out_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv_id", *[c.split()[0] for c in _RESULT.split(", ")]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            out_type = batch.schema.field("conv_id").type
            for conv_id, turn, role, text, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "copies")), strict=True):
                if repair is None or conv_id != open_id:
                    if repair is not None:
                        done.append((open_id, *repair.result()))
                    open_id, repair = conv_id, Repair()
                for _ in range(copies):
                    repair.add(turn, role, text)
            if done:
                yield batch_of(done)
                done = []
        if repair is not None:
            yield batch_of([(open_id, *repair.result())])

    return ordered.mapInArrow(each, f"conv_id {kind}, {_RESULT}")
