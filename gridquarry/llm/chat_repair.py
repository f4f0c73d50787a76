"""Chat formatting by minimum-cost role repair.

Legal conversations have at most one system turn, at the start, then user and
assistant turns in alternation, with an assistant's at the end. Dynamic
programming over that automaton finds the cheapest way to make a conversation
legal by merging a turn into the one before, giving it another role or
inserting an empty turn; the result is rendered.

Conversations are range-sorted over the cluster, so one of any length may lie
in several partitions. Each partition sums up its first and last conversation
as a 4 x 4 matrix of costs (state before, state after), the few matrices are
chained, and then every partition repairs its own turns between fixed states.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_dir

# Roles, other names of theirs, and the turns that may follow
# the start (0) or a turn of each role.
ROLES = ("", "system", "user", "assistant")
NAMES = {"system": 1, "developer": 1, "instruction": 1, "user": 2, "human": 2, "prompter": 2, "customer": 2, "assistant": 3, "bot": 3, "gpt": 3, "model": 3, "ai": 3, "agent": 3}
FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: Empty turns that end a conversation legally after each state.
ENDS = {0: (), 1: (2, 3), 2: (3,), 3: ()}
STATES = range(4)


@dataclass(frozen=True)
class Costs:
    """Price of each repair; naming a turn whose role isn't known is cheaper."""

    merge: float = 1.0
    insert: float = 1.5
    relabel: float = 2.0
    name: float = 0.5
    open_tag: str = "<|{role}|>\n"
    close_tag: str = "<|end|>\n"
    joint: str = "\n"


def steps(costs: Costs) -> dict[int, list[list[tuple[float, int, int, tuple[int, ...]]]]]:
    """For each given role (0: unknown) and state after: the ways there, best
    first in a tie, as (price, state before, whether merged, turns inserted)."""
    out = {}
    for given in STATES:
        by_state: list[list[tuple[float, int, int, tuple[int, ...]]]] = [[]]
        for role in (1, 2, 3):
            price = 0.0 if role == given else costs.relabel if given else costs.name
            ways = []
            for before in STATES:
                if role in FOLLOWS[before]:
                    ways.append((price, before, 0, ()))
                if role == before:
                    ways.append((price + costs.merge, before, 1, ()))
                ways += [(price + costs.insert, before, 0, (p,)) for p in FOLLOWS[before] if role in FOLLOWS[p]]
            by_state.append(ways)
        out[given] = by_state
    return out


def forward(codes: list[int], entry: int, table: dict, back: list | None = None) -> tuple[list[float], list[int]]:
    """Least price of each state after the turns, from ``entry``, and the
    turns inserted on the way; ``back`` gets the way chosen for each state."""
    inf = float("inf")
    price = [inf] * 4
    price[entry] = 0.0
    added = [0] * 4
    for code in codes:
        new, count, chosen = [inf] * 4, [0] * 4, [None] * 4
        for state, ways in enumerate(table[code]):
            for way in ways:
                p = price[way[1]] + way[0]
                if p < new[state] - 1e-12:
                    new[state], count[state], chosen[state] = p, added[way[1]] + len(way[3]), way
        price, added = new, count
        if back is not None:
            back.append(chosen)
    return price, added


def ending(price: list[float], costs: Costs) -> int:
    """The state at which the turns end cheapest."""
    return min(STATES, key=lambda s: (price[s] + costs.insert * len(ENDS[s]), len(ENDS[s]), s))


def repaired(codes: list[int], entry: int, leave: int | None, table: dict, costs: Costs) -> tuple[list[tuple[int, tuple]], int]:
    """(role, way) of each turn on the cheapest path from ``entry`` to
    ``leave`` (None: to the end of the conversation), and the last state."""
    back: list = []
    price, _ = forward(codes, entry, table, back)
    state = ending(price, costs) if leave is None else leave
    last, path = state, []
    for chosen in reversed(back):
        way = chosen[state]
        path.append((state, way))
        state = way[1]
    return path[::-1], last


def _code(role: str | None) -> int:
    return NAMES.get((role or "").strip().lower(), 0)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Conversations of a sorted partition: (conv_id, [(turn, role, text)])."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")))

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        yield conv, [r[1:] for r in own]


def _chain(edges: list, costs: Costs) -> dict[tuple[int, str], tuple[int, int | None, int]]:
    """Of conversations in several partitions: the state before and after each
    part, and the turns put out before it, by (partition, which part)."""
    parts = defaultdict(list)
    for r in edges:
        parts[r["conv"]].append(r)
    fixed = {}
    for own in parts.values():
        own.sort(key=lambda r: r["part"])
        if len(own) < 2:
            continue
        best = [[0.0, float("inf"), float("inf"), float("inf")]]
        came = []
        for r in own:
            row, back = [float("inf")] * 4, [0] * 4
            for a in STATES:
                for b in STATES:
                    p = best[-1][a] + r["price"][4 * a + b]
                    if p < row[b] - 1e-12:
                        row[b], back[b] = p, a
            best.append(row)
            came.append(back)
        state = ending(best[-1], costs)
        path = [state]
        for back in reversed(came):
            state = back[state]
            path.append(state)
        path.reverse()
        out = 0
        for i, r in enumerate(own):
            fixed[r["part"], r["conv"]] = path[i], None if i == len(own) - 1 else path[i + 1], out
            out += r["turns"] + r["added"][4 * path[i] + path[i + 1]]
    return fixed


def repair_chats(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", costs: Costs | None = None) -> DataFrame:
    """One row a given or inserted turn: conv_id, position (from 0), turn (null
    if inserted), given_role, role, action, cost, rendered.

    Turns are taken in order of turn, role and text, nulls first. action is
    keep, relabel, merge, relabel_merge or insert. The rendered pieces of a
    conversation, joined in order of position, are the repaired conversation:
    a piece that starts a turn has the opening tag, a merged one the joint
    before it, and the closing tag is in the piece that ends a turn.

    Unknown and null roles are named at a lower price; null texts are empty; a
    null conv_id is a conversation of its own; repeated turns are merged or
    relabelled like any others; an empty table gives no rows; extra columns
    are ignored.
    """
    costs = costs or Costs()
    table = steps(costs)
    spark = turns.sparkSession
    shared_dir(spark)
    rows = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"), turns[role].alias("role"), F.coalesce(turns[text], F.lit("")).alias("text"))
    # The last key parts repeated turns, which are alike.
    keyed = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "text"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(n, "conv_id", "turn", "role", "hash", "row").select(*order)
    placed = ranged.sortWithinPartitions("conv_id", "turn", "role", F.xxhash64("text"), "text").checkpoint()
    conv_type, turn_type = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        found = []
        for conv_id, own in _segments(batches):
            if len(found) == 2:
                found.pop()
            found.append((conv_id, [_code(r) for _, r, _ in own]))
        for conv_id, codes in found:
            price, added = [], []
            for entry in STATES:
                p, a = forward(codes, entry, table)
                price += p
                added += a
            yield pa.RecordBatch.from_pylist([{"part": part, "conv": repr(conv_id), "turns": len(codes), "price": price, "added": added}], schema=pa.schema([("part", pa.int32()), ("conv", pa.string()), ("turns", pa.int64()), ("price", pa.list_(pa.float64())), ("added", pa.list_(pa.int64()))]))

    # Two rows a partition at most.
    edges = placed.mapInArrow(ends, "part int, conv string, turns bigint, price array<double>, added array<bigint>").collect()
    fixed = spark.sparkContext.broadcast(_chain(edges, costs))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["conv_id", "position", "turn", "given_role", "role", "action", "cost", "rendered"]
        out: list[tuple] = []
        types: list = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = [types[0], pa.int64(), types[1], pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types[:] = [batch.schema.field(c).type for c in ("conv_id", "turn")]
                yield batch

        for conv_id, own in _segments(typed(batches)):
            entry, leave, at = fixed.value.get((part, repr(conv_id)), (0, None, 0))
            path, last = repaired([_code(r) for _, r, _ in own], entry, leave, table, costs)
            open_before = entry
            for (no, given, words), (state, (price, _, merged, put)) in zip(own, path):
                before = costs.close_tag if open_before else ""
                for p in put:
                    out.append((conv_id, at, None, None, ROLES[p], "insert", costs.insert, before + costs.open_tag.format(role=ROLES[p])))
                    before = costs.close_tag
                    at += 1
                named = _code(given) == state
                action = ("keep", "merge") if named else ("relabel", "relabel_merge")
                piece = costs.joint + words if merged else before + costs.open_tag.format(role=ROLES[state]) + words
                out.append((conv_id, at, no, given, ROLES[state], action[merged], price - costs.insert * len(put), piece))
                at += 1
                open_before = state
            if leave is None:
                for p in ENDS[last]:
                    out.append((conv_id, at, None, None, ROLES[p], "insert", costs.insert, costs.close_tag + costs.open_tag.format(role=ROLES[p])))
                    at += 1
                out[-1] = (*out[-1][:-1], out[-1][-1] + costs.close_tag)
            if len(out) >= 2000:
                yield flush()
        if out:
            yield flush()

    return placed.mapInArrow(render, f"conv_id {conv_type}, position bigint, turn {turn_type}, given_role string, role string, action string, cost double, rendered string")
