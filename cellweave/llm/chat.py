"""Chat formatting by minimum-cost role repair.

Which turns may follow which is an automaton: an optional system turn, then user and assistant in turn, the assistant
last. A conversation that breaks the rules is repaired at least cost by merging a turn into the one before it,
relabelling it, or inserting empty turns, and the repaired sequence is rendered.

The repair is dynamic programming over the automaton's states. Taking a turn is a small matrix of costs from state to
state, and matrices compose, so a conversation of any length is worked on in segments: each segment yields its matrix,
the matrices of a conversation fix the states between segments, and each segment then finds and renders its own repair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm import arrays as A

ROLES = ("system", "user", "assistant")
#: state 0 is the start, state k + 1 follows a turn of ROLES[k]
NEXT = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}
LAST = (3,)
MERGE, RELABEL, INSERT = 2, 3, 4
#: numbers of turns that a segment spans
SEGMENT = 4096
FAR = 1 << 40
STATES = range(len(ROLES) + 1)


def _state(role: str) -> int:
    return ROLES.index(role) + 1


def _chains() -> dict[tuple[int, int], tuple[str, ...]]:
    """The shortest legal turns that lead from a state to another; of equal length, the first found."""
    found = {(s, s): () for s in STATES}
    edge = list(found)
    while edge:
        edge = [(s, _state(r)) for s, t in edge for r in NEXT[t] if (s, _state(r)) not in found
                and not found.update({(s, _state(r)): (*found[s, t], r)})]
    return found


_CHAIN = _chains()


def _actions(role: str | None) -> dict[tuple[int, int], tuple[int, tuple[str, ...], bool, str]]:
    """(state, next state) -> the least (cost, roles inserted before, merged?, role taken) for a turn of ``role``."""
    best: dict[tuple[int, int], tuple[int, tuple[str, ...], bool, str]] = {}
    for s in STATES:
        for r in ROLES:
            change = 0 if r == role else RELABEL
            if _state(r) == s:
                option = (MERGE + change, (), True, r)
                best[s, s] = min(best.get((s, s), option), option)
            for t in STATES:
                if (s, t) in _CHAIN and r in NEXT[t]:
                    option = (INSERT * len(_CHAIN[s, t]) + change, _CHAIN[s, t], False, r)
                    best[s, _state(r)] = min(best.get((s, _state(r)), option), option)
    return best


_ACTIONS = {r: _actions(r) for r in (*ROLES, None)}
_COSTS = {r: np.array([[a.get((s, t), (FAR,))[0] for t in STATES] for s in STATES]) for r, a in _ACTIONS.items()}
#: cost of the empty turns that close a conversation, and the state they lead to
_CLOSE = [min((INSERT * len(_CHAIN[s, t]), t) for t in LAST if (s, t) in _CHAIN) for s in STATES]


def known(role: str | None) -> str | None:
    """The role that a label means; None for any other label."""
    name = (role or "").strip().lower()
    return name if name in ROLES else None


def matrix(roles: list[str | None]) -> np.ndarray:
    """Least costs from state to state over a run of turns."""
    total = np.where(np.eye(len(STATES), dtype=bool), 0, FAR)
    for r in roles:
        total = np.minimum((total[:, :, None] + _COSTS[r][None]).min(axis=1), FAR)
    return total


def repair(roles: list[str | None], enter: int, leave: int | None) -> tuple[int, int, list[tuple[tuple[str, ...], bool, str]]]:
    """(cost, last state, action of each turn) of the least repair from ``enter`` to ``leave``.

    Without ``leave`` the conversation ends here, and the cost of closing it counts. Ties fall to the lowest state, from
    the last turn back.
    """
    reach = [[0 if s == enter else FAR for s in STATES]]
    for r in roles:
        row, cost = reach[-1], _COSTS[r]
        reach.append([min(row[s] + int(cost[s, t]) for s in STATES) for t in STATES])
    last = leave if leave is not None else min(STATES, key=lambda s: (reach[-1][s] + _CLOSE[s][0], s))
    total, state, actions = reach[-1][last], last, []
    for k in range(len(roles) - 1, -1, -1):
        cost = _COSTS[roles[k]]
        s = next(s for s in STATES if reach[k][s] + cost[s, state] == reach[k + 1][state])
        actions.append(_ACTIONS[roles[k]][s, state][1:])
        state = s
    return total, last, actions[::-1]


def render(texts: list[str | None], actions: list[tuple[tuple[str, ...], bool, str]], enter: int, closing: tuple[str, ...] | None) -> tuple[str, int]:
    """The text of a segment and the turns that begin in it. A turn is closed where the next one begins.

    Angle-bar markers inside a text are spaced out, so that a text can't open a turn.
    """
    out, turns, open_ = [], 0, enter != 0

    def begin(role: str) -> None:
        nonlocal turns, open_
        out.append(("<|end|>\n" if open_ else "") + f"<|{role}|>\n")
        turns, open_ = turns + 1, True

    for text, (inserted, merged, role) in zip(texts, actions):
        for r in inserted:
            begin(r)
        if merged:
            out.append("\n")
        else:
            begin(role)
        out.append((text or "").replace("<|", "< |").replace("|>", "| >"))
    if closing is not None:
        for r in closing:
            begin(r)
        if open_:
            out.append("<|end|>\n")
    return "".join(out), turns


def _segments(it: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows of one segment, across batches, of a partition sorted by segment."""
    rows = (r for batch in it for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)))
    for key, part in groupby(rows, lambda r: r[:3]):
        yield key, list(part)


def _costs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("none", pa.bool_()), ("segment", pa.int64()), ("cost", pa.list_(pa.int64()))])
    yield from A.batches(((*key, matrix([known(r[3]) for r in part]).ravel().tolist())
                          for key, part in _segments(it, ["conv", "none", "segment", "role"])), schema)


def _between(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states in which each segment of a long conversation begins and ends."""
    schema = pa.schema([("conv", pa.string()), ("none", pa.bool_()), ("segment", pa.int64()), ("enter", pa.int32()), ("leave", pa.int32())])

    def states(conv: str, none: bool, parts: list[dict]) -> Iterator[tuple]:
        parts = sorted(parts, key=lambda p: p["segment"])
        costs = [np.array(p["cost"]).reshape(len(STATES), -1) for p in parts]
        reach = [np.where(np.arange(len(STATES)) == 0, 0, FAR)]
        for c in costs:
            reach.append(np.minimum((reach[-1][:, None] + c).min(axis=0), FAR))
        state = min(STATES, key=lambda s: (reach[-1][s] + _CLOSE[s][0], s))
        for k in range(len(parts) - 1, -1, -1):
            s = next(s for s in STATES if reach[k][s] + costs[k][s, state] == reach[k + 1][state])
            yield conv, none, parts[k]["segment"], s, state if k < len(parts) - 1 else -1
            state = s

    for batch in it:
        rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "none", "parts")))
        yield from A.batches((x for row in rows for x in states(*row)), schema)


def _render(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv", pa.string()), ("none", pa.bool_()), ("segment", pa.int64()), ("n_turns", pa.int64()), ("cost", pa.int64()), ("text", pa.string())])

    def rows() -> Iterator[tuple]:
        for key, part in _segments(it, ["conv", "none", "segment", "role", "text", "enter", "leave"]):
            enter, leave = part[0][5], part[0][6]
            last = leave is None or leave < 0
            cost, state, actions = repair([known(r[3]) for r in part], enter or 0, None if last else leave)
            closing = _CHAIN[state, _CLOSE[state][1]] if last else None
            text, turns = render([r[4] for r in part], actions, enter or 0, closing)
            yield *key, turns, cost + (_CLOSE[state][0] if last else 0), text

    yield from A.batches(rows(), schema)


def format_chats(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> conv_id, segment, n_turns, cost, text: repaired and rendered conversations.

    Turns stand by number, null first, then role, then text; repeated rows are turns of their own. A conversation has one
    row for every ``segment`` numbers in which it has turns, in general one; the texts of its rows in order of
    ``segment``, one after another, are the conversation, ``n_turns`` the turns that begin in a row and ``cost`` what its
    repair costs. Labels other than the three roles, in any case, cost a relabelling; null texts are empty turns; rows
    with a null conv_id are one conversation. An empty table gives no rows.
    """
    spark = A.ready(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    at = F.col("turn").cast("long")
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("none"),
                        F.coalesce(F.floor(at / segment), F.lit(-(1 << 62))).cast("long").alias("segment"), at.alias("turn"),
                        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    key = ["conv", "none", "segment"]
    dealt = rows.repartition(A.buckets(spark), *key)
    order = [*key, F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text")]
    costs = dealt.sortWithinPartitions(*order).mapInArrow(_costs, "conv string, none boolean, segment long, cost array<long>")
    long_ = costs.groupBy("conv", "none").agg(F.collect_list(F.struct("segment", "cost")).alias("parts")).filter(F.size("parts") > 1)
    states = long_.mapInArrow(_between, "conv string, none boolean, segment long, enter int, leave int")
    done = dealt.join(states, key, "left").sortWithinPartitions(*order).mapInArrow(
        _render, "conv string, none boolean, segment long, n_turns long, cost long, text string")
    number = F.when(F.col("segment") > -(1 << 62), F.col("segment"))
    return done.select(F.when(~F.col("none"), F.col("conv")).cast(kind).alias("conv_id"), number.alias("segment"), "n_turns", "cost", "text")
