"""Conversation structure repair: the cheapest edits, found by depth-first branch-and-bound.

1. Every row becomes a few bytes of facts (initial of its role, blank, unfinished, a digest
   of role and text); these, not the texts, are brought together by conversation.
2. A conversation's edits (Keep, Rerole, Delete, Insert) are searched with an explicit
   stack.  A prefix of edits is cut if its cost and the suffix's lower bound exceed the
   incumbent's, if its audit can only end behind the incumbent's at that cost, or if the
   table of its node (rows consumed, role state) holds a prefix that is no worse.  The
   stack runs empty: the incumbent is optimal.
3. Texts meet their conversation's audit in one shuffle and are edited as they stream by;
   no conversation's texts are held.

A search spans at most BLOCK rows.  A longer conversation goes block by block: a block
keeps its best prefix for every role state it can end in, and the next one starts from
these, so the work grows with the rows and the result stays optimal.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marmot.llm.common import prepare, rows, saved

WHITE = " \t\n\x0b\x0c\r"
# costs of the contract
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: role states: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
WANTED = (USER, USER, ASSISTANT, USER)  # the state after an inserted or reroled turn
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FINE, GONE, CUT = range(3)  # a row as the search sees it: sound, to be deleted, unfinished
#: rows of one search
BLOCK = 16
#: two inserts and a deletion let the cheapest prefix of a block follow any other one's edits
_REACH = 2 * INSERT + DELETE


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the contract's damage; nulls in role and text become one space."""
    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20))
    cut = F.regexp_replace("text", "[.!?]", "")
    return (conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), fate.alias("fate"))
            .where("fate <> 0")
            .select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, cut).otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
            .drop("copy"))


def _spoken() -> tuple[Column, Column, Column]:
    """Role, text, and a digest of both; a null is one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return role, text, F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))


def _facts(turns: DataFrame) -> DataFrame:
    """conv_id, turn, digest of role and text, initial (s, u, a or -), state of the text."""
    role, text, digest = _spoken()
    initial, ended = F.substring(role, 1, 1), F.rtrim(text, F.lit(WHITE))
    return turns.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        digest.alias("digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
        F.when(ended == "", GONE).when(F.substring(ended, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT).alias("state"))


class _Search:
    """Best edits of up to BLOCK rows from given entry prefixes to the block's end."""

    def __init__(self, block: list[tuple[str, int]], entries: dict[int, tuple[int, str]], final: bool):
        self.block, self.n, self.final = block, len(block), final
        self.table: dict[tuple[int, int], tuple[int, str]] = {}  # node -> its best prefix
        self.best: dict[int, tuple[int, str]] = {}  # incumbents, by end state; one for all ends of the last block
        self.bound = self._bounds()
        self.stack: list[tuple[int, int, int, str]] = []
        for state, (cost, audit) in sorted(entries.items(), key=lambda e: e[1], reverse=True):
            self._push(0, state, cost, audit)

    def _bounds(self) -> tuple[list[int], list[int]]:
        """Least cost of the rows from each place on, before and after the first turn: each row's cheapest edit by itself."""
        first, later = [0] * (self.n + 1), [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            initial, state = self.block[i]
            least = DELETE if state != FINE else REROLE if initial == "-" else 0
            first[i] = first[i + 1] + least
            later[i] = later[i + 1] + max(least, REROLE if initial == "s" else 0)
        return first, later

    def _limit(self) -> tuple[int, str] | None:
        if not self.best:
            return None
        cost, audit = min(self.best.values())
        return (cost, audit) if self.final else (cost + _REACH, "~")

    def _push(self, i: int, state: int, cost: int, audit: str) -> None:
        limit = self._limit()
        if limit is not None:
            least = cost + self.bound[state != START][i]
            if least > limit[0] or (least == limit[0] and audit > limit[1][: len(audit)]):
                return
        known = self.table.get((i, state))
        if known is not None and known <= (cost, audit):
            return
        self.table[i, state] = (cost, audit)
        self.stack.append((i, state, cost, audit))

    def run(self) -> dict[int, tuple[int, str]]:
        while self.stack:
            i, state, cost, audit = self.stack.pop()
            if self.table[i, state] != (cost, audit):
                continue  # a better prefix of this node came in meanwhile
            if i == self.n and (not self.final or state in (START, ASSISTANT)):
                slot = ASSISTANT if self.final else state
                if slot not in self.best or (cost, audit) < self.best[slot]:
                    self.best[slot] = (cost, audit)
            self._expand(i, state, cost, audit)
        return self.best

    def _expand(self, i: int, state: int, cost: int, audit: str) -> None:
        """Push the dearer edits first, so that the cheapest is tried next."""
        if i < self.n or self.final:
            self._push(i, WANTED[state], cost + INSERT, audit + "I")
        if i == self.n:
            return
        initial, text = self.block[i]
        self._push(i + 1, state, cost + DELETE, audit + "D")
        if text != GONE:
            more = UNFINISHED if text == CUT else 0
            self._push(i + 1, WANTED[state], cost + REROLE + more, audit + "R")
            kept = KEPT.get((state, initial))
            if kept is not None:
                self._push(i + 1, kept, cost + more, audit + "K")


def cheapest(turns: list[tuple[str, int]], block: int = BLOCK) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits, the ASCII-least audit among them; turns are (initial, text state)."""
    done: list[str] = []
    paid = 0
    entries = {START: (0, "")}
    for at in range(0, max(len(turns), 1), block):
        final = at + block >= len(turns)
        ends = _Search(turns[at : at + block], entries, final).run()
        if final:
            cost, audit = ends[ASSISTANT]
            return paid + cost, "".join(done) + audit
        # what all prefixes share is settled
        least = min(c for c, _ in ends.values())
        low, high = min(a for _, a in ends.values()), max(a for _, a in ends.values())
        same = next((k for k, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
        done.append(low[:same])
        paid += least
        entries = {s: (c - least, a[same:]) for s, (c, a) in ends.items()}
    raise AssertionError


def _plan(turns: list[int | None], digests: list[str], initials: list[str], states: list[int]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit of one conversation's rows in order."""
    known = {t for t in turns if t is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    blank = duplicate = truncated = 0
    seen: set[bytes] = set()
    seen_turns: list[tuple[str, int]] = []
    for digest, initial, state in zip(digests, initials, states, strict=True):
        key = bytes.fromhex(digest)
        if state == GONE:
            blank += 1
        elif key in seen:
            duplicate, state = duplicate + 1, GONE
        elif state == CUT:
            truncated += 1
        seen.add(key)
        seen_turns.append((initial, state))
    cost, audit = cheapest(seen_turns)
    return gaps, blank, duplicate, truncated, illegal, cost, audit


PLAN = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _planner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations come whole and in order; one is held at a time, a few bytes a row."""
    held: list[list] = [[], [], [], []]
    at: list = []  # the id of the held conversation
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names=["conv_id", *PLAN, "audit"])

    for b in rows(batches):
        kind = b.schema.field(0).type
        ids = b.column(0).to_pylist()
        facts = [b.column(k).to_pylist() for k in range(1, 5)]
        i = 0
        for conv, group in itertools.groupby(ids):
            n = sum(1 for _ in group)
            if at and at[0] != conv:
                out.append((at[0], *_plan(*held)))
                held = [[], [], [], []]
            at = [conv]
            for h, f in zip(held, facts, strict=True):
                h += f[i : i + n]
            i += n
        if len(out) >= 1000:
            yield batch()
            out = []
    if at:
        out.append((at[0], *_plan(*held)))
    if out:
        yield batch()


_ORDER = ("turn", "digest")


def plans(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation that has rows.

    ``turns`` needs conv_id, turn, role and text; other columns are ignored.  Rows go by ``turn``, nulls
    first, rows of one turn by a digest of role and text, so that repeated rows stand together.  A null role
    or text is one space; rows with a null conv_id are one conversation.  An empty table gives none.
    """
    prepare(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    facts = _facts(turns).repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER)
    return facts.mapInArrow(_planner, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in PLAN)}, audit string")


def _editor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's audit comes first, then its rows in order."""
    audit, at, state, position, conv = "", 0, START, 0, None
    out: list[tuple] = []

    def insert() -> None:
        nonlocal at, state, position
        while at < len(audit) and audit[at] == "I":
            state = WANTED[state]
            out.append((conv, position, ROLE[state], "", "I"))
            at, position = at + 1, position + 1

    for b in rows(batches):
        kind = b.schema.field(0).type
        for c, new, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if new is not None:
                insert()
                conv, audit, at, state, position = c, new, 0, START, 0
                continue
            insert()
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            if edit == "R":
                state = WANTED[state]
                role = ROLE[state]
            else:
                state = KEPT[state, role[:1]]
            out.append((conv, position, role, text, edit))
            position += 1
        if out:
            yield _repaired_batch(out, kind)
            out = []
    insert()
    if out:
        yield _repaired_batch(out, kind)


def _repaired_batch(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, position, role, text, edit = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(position, pa.int64()), pa.array(role), pa.array(text), pa.array(edit)],
                                      names=["conv_id", "position", "role", "text", "edit"])


def repaired(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, position, role, text, edit: the rows after the edits, a conversation's together and in order.

    ``audits`` (conv_id, audit) is ``plans`` of the same rows.
    """
    prepare(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    role, text, digest = _spoken()
    said = turns.select("conv_id", F.lit(None).cast("string").alias("audit"), role.alias("role"), text.alias("text"), F.lit(1).alias("part"),
                        F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"))
    first = audits.select("conv_id", "audit", *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), F.lit(0).alias("part"),
                          F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("digest"))
    dealt = said.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "part", *_ORDER)
    return dealt.mapInArrow(_editor, f"conv_id {kind}, position bigint, role string, text string, edit string")


def _hasher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: list = []
    digest = hashlib.sha256()
    for b in rows(batches):
        kind = b.schema.field(0).type
        done: list[tuple] = []
        for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            if at and at[0] == conv:
                digest.update(b"\n")
            else:
                if at:
                    done.append((at[0], digest.hexdigest()))
                at, digest = [conv], hashlib.sha256()
            digest.update(f"{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
    if at:
        yield pa.RecordBatch.from_arrays([pa.array(at, kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])


def digests(fixed: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the rows of ``repaired``, read as they stream by (taken right after it: the order matters)."""
    kind = fixed.schema["conv_id"].dataType.simpleString()
    return fixed.mapInArrow(_hasher, f"conv_id {kind}, repaired_sha256 string")


def summary(conversations: DataFrame) -> DataFrame:
    """One row per conversation id of the table, of its rows after damage: plan, cost, audit and digest."""
    turns = damaged(conversations)
    found = saved(plans(turns), "structure-plans")
    hashed = digests(repaired(turns, found))
    ids = conversations.select("conv_id").distinct()
    wide = (ids.join(found.withColumnRenamed("conv_id", "c1"), ids["conv_id"].eqNullSafe(F.col("c1")), "left")
            .join(hashed.withColumnRenamed("conv_id", "c2"), ids["conv_id"].eqNullSafe(F.col("c2")), "left"))
    return wide.select("conv_id", *(F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in PLAN), F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
