"""Chat formatting by minimum-cost role repair.

A legal sequence is an optional system turn, then user and assistant turns in alternation, ending with the
assistant.  Every input turn is merged with the turn before, relabelled, or preceded by empty
turns, at the least total cost: a shortest path over the automaton's states, one step per turn.
A conversation may hold any share of the rows, so turns are dealt in order over range partitions and cut into
blocks; each block is summed up as a state-to-state cost matrix in the (min, +) algebra, the few matrices of a
conversation fix the states between its blocks, and blocks are then solved on their own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pinchgraph.llm.common import batches_of, rows_of
from pinchgraph.storage import materialize

ROLES = ("start", "system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Other names of the roles, taken without cost.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
MERGE, RELABEL, INSERT = 1, 4, 2
#: Empty turns that must be put between a state and a turn of a role; a pair that is missing has no way.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,), (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
#: Empty turns that end a conversation left in a state.
TAIL = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
#: Turns of a block at most.
BLOCK = 4_096
SEPARATOR = "\n\n"


def _edges() -> dict[int, list[tuple[int, int, int, bool, tuple[int, ...]]]]:
    """Per role of an input turn (0: unknown): (from, to, cost, merged, inserted), the cheapest of each pair of states."""
    out = {}
    for role in range(4):
        best: dict[tuple[int, int], tuple] = {}
        for to in (SYSTEM, USER, ASSISTANT):
            named = 0 if role == to else RELABEL
            ways = [(to, to, named + MERGE, True, ())]
            ways += [(s, to, named + INSERT * len(b), False, b) for (s, t), b in BETWEEN.items() if t == to]
            for way in ways:
                if way[:2] not in best or way[2] < best[way[:2]][2]:
                    best[way[:2]] = way
        out[role] = sorted(best.values())
    return out


EDGES = _edges()
STEPS = np.full((4, 4, 4), np.inf)
for _role, _ways in EDGES.items():
    for _s, _t, _cost, _, _ in _ways:
        STEPS[_role, _s, _t] = _cost


def transfer(roles: Sequence[int]) -> np.ndarray:
    """Least cost from each state to each state over the turns: a tree of (min, +) products."""
    m = STEPS[np.asarray(roles, np.int64)]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        a, b = m[0 : len(m) - len(odd) : 2], m[1 : len(m) - len(odd) : 2]
        m = np.concatenate([(a[:, :, :, None] + b[:, None, :, :]).min(2), odd])
    return m[0]


def between_blocks(matrices: Sequence[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) state of each block on a cheapest path of the whole conversation; the last exit is -1, left open."""
    cost, back = np.array([0.0, np.inf, np.inf, np.inf]), []
    for m in matrices:
        ways = cost[:, None] + m
        back.append(ways.argmin(0))
        cost = ways.min(0)
    state = int(np.argmin(cost + [INSERT * len(TAIL[s]) for s in range(4)]))
    states = [-1]
    for at in reversed(back):
        state = int(at[state])
        states.append(state)
    states.reverse()
    return list(zip(states, states[1:]))


def repair(roles: Sequence[int], entry: int = START, exit_: int = -1) -> list[tuple[int, bool, tuple[int, ...], tuple[int, ...], int]]:
    """(role, merged, inserted before, appended after, cost) per turn on a cheapest path from `entry` to `exit_` (-1: to a legal end).

    Of equal paths the one through smaller states is taken.
    """
    cost: dict[int, int] = {entry: 0}
    back = []
    for role in roles:
        new: dict[int, tuple[int, tuple]] = {}
        for way in EDGES[role]:
            if way[0] in cost and (way[1] not in new or cost[way[0]] + way[2] < new[way[1]][0]):
                new[way[1]] = (cost[way[0]] + way[2], way)
        back.append({s: way for s, (_, way) in new.items()})
        cost = {s: c for s, (c, _) in new.items()}
    state = exit_ if exit_ >= 0 else min(cost, key=lambda s: (cost[s] + INSERT * len(TAIL[s]), s))
    after = TAIL[state] if exit_ < 0 else ()
    out = []
    for choices in reversed(back):
        way = choices[state]
        out.append((way[1], way[3], way[4], after, way[2] + INSERT * len(after)))
        state, after = way[0], ()
    return out[::-1]


def role_code(role: Column) -> Column:
    """1 to 3 for a role or one of its other names, in any case and with blanks around it, else 0."""
    name = F.lower(F.trim(role))
    known = {**{r: i for i, r in enumerate(ROLES) if i}, **{a: ROLES.index(r) for a, r in ALIASES.items()}}
    pairs = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.element_at(pairs, name), F.lit(0))


def _opened(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


END = "<|end|>\n"


def _names(codes: tuple[int, ...]) -> str:
    return " ".join(ROLES[c] for c in codes)


def repaired(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted, appended, cost, piece of every row of `turns(conv_id, turn, role, text)`.

    action is keep, relabel, merge or relabel+merge; inserted and appended name the empty turns put before and after.
    The pieces of a conversation, joined in the order of `seq`, are its rendered text; see `rendered`.
    Turns are ordered by number, null first, equal numbers by role and text.  Rows with a null conv_id are
    one conversation.  A null or unknown role takes the cheapest label; a null text is empty; template marks in
    a text are defused.  No rows give no rows; other columns are ignored.
    """
    base = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    order = ["_conv", "turn", "role", F.xxhash64("text")]
    columns = [f.name for f in base.schema]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            yield batch.append_column("seq", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    sorted_ = base.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = materialize(sorted_.mapInArrow(number, f"{base._jdf.schema().toDDL()}, seq long"), "turns").df
    blocks = numbered.groupBy("_conv", F.floor(F.col("seq") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("seq", role_code(F.col("role")).alias("code")))).alias("turns"))
    blocks = materialize(blocks.select("_conv", "block", F.col("turns.seq").alias("seqs"), F.col("turns.code").alias("codes")), "blocks").df
    long_ones = blocks.groupBy("_conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_conv")
    states = materialize(_block_states(blocks.join(long_ones, "_conv", "left_semi")), "states").df
    placed = blocks.join(states, ["_conv", "block"], "left").select("seqs", "codes", F.coalesce("entry", F.lit(START)).alias("entry"), F.coalesce("exit", F.lit(-1)).alias("exit"))
    solved = placed.mapInArrow(_solve, "seq long, new_role string, merged boolean, inserted string, appended string, cost long, first boolean, last boolean")
    both = numbered.join(solved, "seq")
    other = role_code(F.col("role")) != F.element_at(F.create_map(*[F.lit(x) for i, r in enumerate(ROLES) for x in (r, i)]), F.col("new_role"))
    action = F.when(F.col("merged"), F.when(other, "relabel+merge").otherwise("merge")).otherwise(F.when(other, "relabel").otherwise("keep"))
    empty = lambda c: F.array_join(F.transform(F.filter(F.split(c, " "), lambda r: r != ""), lambda r: F.concat(_opened(r), F.lit(END))), "")
    text = F.replace("text", F.lit("<|"), F.lit("< |"))
    head = F.when(F.col("merged"), F.lit(SEPARATOR)).otherwise(F.concat(F.when(F.col("first"), "").otherwise(END), empty("inserted"), _opened(F.col("new_role"))))
    tail = F.when(F.col("last"), F.concat(F.lit(END), empty("appended"))).otherwise("")
    return both.select("conv_id", "turn", "role", "new_role", action.alias("action"), "inserted", "appended", "cost", F.concat(head, text, tail).alias("piece"), "seq")


def _block_states(blocks: DataFrame) -> DataFrame:
    """(_conv, block, entry, exit) of conversations in several blocks; a conversation's matrices are 1 for `BLOCK` turns."""
    matrix = pa.schema([("_conv", pa.string()), ("block", pa.int64()), ("matrix", pa.list_(pa.float64()))])
    states = pa.schema([("_conv", pa.string()), ("block", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32())])

    def sum_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((c, b, transfer(codes).ravel().tolist()) for c, b, codes in rows_of(batches, "_conv", "block", "codes")), matrix)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, parts in rows_of(batches, "_conv", "parts"):
                ends = between_blocks([np.array(p["matrix"]).reshape(4, 4) for p in parts])
                yield from ((conv, p["block"], *e) for p, e in zip(parts, ends))

        return batches_of(rows(), states)

    summed = blocks.select("_conv", "block", "codes").mapInArrow(sum_up, "_conv string, block long, matrix array<double>")
    per = summed.groupBy("_conv").agg(F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("parts"))
    return per.mapInArrow(walk, "_conv string, block long, entry int, exit int")


def _solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("seq", pa.int64()), ("new_role", pa.string()), ("merged", pa.bool_()), ("inserted", pa.string()), ("appended", pa.string()), ("cost", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())])

    def rows() -> Iterator[tuple]:
        for seqs, codes, entry, exit_ in rows_of(batches, "seqs", "codes", "entry", "exit"):
            path = repair(codes, entry, exit_)
            for i, (seq, (role, merged, before, after, cost)) in enumerate(zip(seqs, path)):
                yield seq, ROLES[role], merged, _names(before), _names(after), cost, entry == START and i == 0, exit_ < 0 and i == len(path) - 1

    return batches_of(rows(), schema)


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, cost, text: each conversation as one text.  A text holds its whole conversation, so it is as long as that."""
    pieces = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    out = repaired(turns).groupBy("conv_id").agg(F.sum("cost").alias("cost"), pieces.alias("_p"))
    return out.select("conv_id", "cost", F.array_join(F.transform("_p", lambda p: p["piece"]), "").alias("text"))
