"""Chat formatting by minimum-cost role repair.

A dialogue is legal if system comes first or not at all and user and assistant take turns after it, user first. Each turn may be
kept, relabelled, merged into the turn before it, or preceded by empty turns; the cheapest way through the automaton is found by
dynamic programming and rendered.

A step of the automaton is a matrix of costs over states, and matrices multiply (min, +) associatively. So a conversation is cut
into chunks of at most CHUNK turns: each becomes one matrix, a pass over the matrices - a row a chunk - settles the states
between chunks, and each chunk then repairs its own turns. No task holds more than a chunk, however long a conversation is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.scratch import written

CHUNK = 256
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = (None, "system", "user", "assistant")
#: States from which a turn of each role may come.
BEFORE = {SYSTEM: (NOTHING,), USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
#: Other names of the roles (fixed values).
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "chatbot": "assistant", "developer": "system"}
START, END = "<|im_start|>{role}\n", "<|im_end|>\n"
GLUE = "\n\n"
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3
    unknown: int = 1  # to give a role to a turn that has none or an unknown one


def role_of(name: str | None) -> int:
    name = (name or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES[1:] else NOTHING


#: (cost, new role, action, empty turns to insert before)
Move = tuple[int, int, str, tuple[int, ...]]


def moves(role: int, costs: Costs) -> list[list[list[Move]]]:
    """[state][next state]: the ways by which a turn of the given role (NOTHING: unknown) leads there, the preferred first."""
    out: list[list[list[Move]]] = [[[] for _ in ROLES] for _ in ROLES]
    for new in (SYSTEM, USER, ASSISTANT):
        label, name = (0, "keep") if new == role else (costs.unknown if role == NOTHING else costs.relabel, "relabel")
        for state in range(len(ROLES)):
            if state in BEFORE[new]:
                out[state][new].append((label, new, name, ()))
            if state == new:
                out[state][new].append((label + costs.merge, new, "merge", ()))
            for between in (USER, ASSISTANT):
                if state in BEFORE[between] and between in BEFORE[new]:
                    out[state][new].append((label + costs.insert, new, name, (between,)))
        for row in out:
            row[new].sort(key=lambda m: m[0])
    return out


class Repair:
    def __init__(self, costs: Costs):
        self.best = {r: [[ways[0] if ways else None for ways in row] for row in moves(r, costs)] for r in range(len(ROLES))}

    def step(self, vector: list[int], role: int) -> list[int]:
        best = self.best[role]
        return [min((vector[s] + best[s][t][0] for s in range(4) if best[s][t] and vector[s] < FAR), default=FAR) for t in range(4)]

    def matrix(self, roles: list[int]) -> list[int]:
        out = []
        for s in range(4):
            v = [0 if x == s else FAR for x in range(4)]
            for r in roles:
                v = self.step(v, r)
            out += v
        return out

    def path(self, roles: list[int], enter: int, leave: int) -> list[Move]:
        """The cheapest moves from one state to another; of equally cheap ones those whose last states are lowest."""
        vectors = [[0 if x == enter else FAR for x in range(4)]]
        for r in roles:
            vectors.append(self.step(vectors[-1], r))
        out, state = [], leave
        for r, before, after in zip(roles[::-1], vectors[-2::-1], vectors[:0:-1], strict=True):
            s = next(s for s in range(4) if (m := self.best[r][s][state]) and before[s] + m[0] == after[state])
            out.append(self.best[r][s][state])
            state = s
        return out[::-1]


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, list]]:
    """Rows of equal keys, which stand together, whatever batches they came in."""
    rows = (r for b in batches for r in b.itertuples(index=False, name="Row"))
    for key, run in groupby(rows, key=lambda r: tuple(str(getattr(r, k)) for k in keys)):
        yield key, run


def _batches(rows: Iterator[tuple], columns: list[str], types: dict, size: int = 5000) -> Iterator[pd.DataFrame]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pd.DataFrame(held, columns=columns).astype(types)
            held = []
    yield pd.DataFrame(held, columns=columns).astype(types)


def _chunk_matrices(repair: Repair) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for _, run in _runs(batches, ["conv", "chunk", "part"]):
                run = list(run)
                yield run[0].conv, run[0].chunk, run[0].part, repair.matrix([role_of(r.role) for r in run])

        return _batches(rows(), ["conv", "chunk", "part", "m"], {"chunk": "int64", "part": "int64"})

    return run


def _forward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each chunk: the cost of each state before it."""

    def rows():
        for _, run in _runs(batches, ["conv"]):
            v = [0, FAR, FAR, FAR]
            for r in run:
                yield r.conv, r.chunk, r.part, list(r.m), v
                v = [min(min(v[s] + r.m[4 * s + t] for s in range(4)), FAR) for t in range(4)]

    return _batches(rows(), ["conv", "chunk", "part", "m", "v"], {"chunk": "int64", "part": "int64"})


def _backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a conversation's last chunk to its first: the states before and after each."""

    def rows():
        for _, run in _runs(batches, ["conv"]):
            state = None
            for r in run:
                ends = [min(r.v[s] + r.m[4 * s + t] for s in range(4)) for t in range(4)]
                last = state is None
                if last:
                    state = ends.index(min(ends))
                enter = next(s for s in range(4) if r.v[s] + r.m[4 * s + state] == ends[state])
                yield r.conv, r.chunk, r.part, enter, state, last
                state = enter

    return _batches(rows(), ["conv", "chunk", "part", "enter", "leave", "last"], {"chunk": "int64", "part": "int64", "enter": "int32", "leave": "int32"})


def _render(repair: Repair) -> Callable:
    whole = lambda x: int(x) if x is not None and x != "null" else None  # noqa: E731  numbers come as strings, as nulls would make them floats

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for _, run in _runs(batches, ["conv", "chunk", "part"]):
                run = list(run)
                state = run[0].enter
                path = repair.path([role_of(r.role) for r in run], run[0].enter, run[0].leave)
                for k, (r, (cost, new, action, inserted)) in enumerate(zip(run, path, strict=True)):
                    text = r.text or ""
                    if action == "merge":
                        shown = GLUE + text
                    else:
                        shown = (END if state != NOTHING else "") + "".join(START.format(role=ROLES[x]) + END for x in inserted) + START.format(role=ROLES[new]) + text
                    if r.last and k == len(run) - 1:
                        shown += END
                    state = new
                    yield whole(r.conv), whole(r.turn), r.role, ROLES[new], action, len(inserted), cost, shown

        return _batches(rows(), ["conv_id", "turn", "role", "new_role", "action", "n_inserted", "cost", "rendered"], {"conv_id": "Int64", "turn": "Int64", "n_inserted": "int32", "cost": "int32"})

    return run


def format_chats(turns: DataFrame, costs: Costs | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, action (keep, relabel or merge; with n_inserted empty turns before it), cost,
    rendered. A conversation's rendered texts, in the order of turn, make its text.

    Turns are ordered by number, then role, then text, nulls last; repeated rows are turns of their own. A null conv_id is a
    conversation like others. A null text is empty; a null, empty or unknown role is given the cheapest. An empty table gives no
    rows; other columns are ignored."""
    repair = Repair(costs or Costs())
    turns = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
    # Turn numbers cut first, so that no window has to order a long conversation; rows that share a number are cut by rank.
    placed = turns.withColumns({"conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), "chunk": F.coalesce(F.floor(F.col("turn") / chunk), F.lit((1 << 62)))})
    rank = F.row_number().over(Window.partitionBy("conv", "chunk").orderBy(*order))
    placed = placed.withColumn("rank", rank).withColumn("part", F.floor((F.col("rank") - 1) / chunk))
    keys = ["conv", "chunk", "part"]

    matrices = placed.select(*keys, "rank", "role").repartition(*keys).sortWithinPartitions(*keys, "rank").mapInPandas(_chunk_matrices(repair), "conv string, chunk long, part long, m array<long>")
    costs_in = matrices.repartition("conv").sortWithinPartitions(*keys).mapInPandas(_forward, "conv string, chunk long, part long, m array<long>, v array<long>")
    backward = ["conv", F.col("chunk").desc(), F.col("part").desc()]
    states = costs_in.repartition("conv").sortWithinPartitions(*backward).mapInPandas(_backward, "conv string, chunk long, part long, enter int, leave int, last boolean")
    states = written(states, "chunk-states")
    joined = placed.withColumn("turn", F.col("turn").cast("string")).drop("conv_id").join(states, keys).repartition(*keys).sortWithinPartitions(*keys, "rank")
    return joined.mapInPandas(_render(repair), "conv_id long, turn long, role string, new_role string, action string, n_inserted int, cost int, rendered string")
