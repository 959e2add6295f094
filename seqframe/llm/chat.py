"""Chat transcripts: roles recovered by a hidden Markov model over lines, then canonical turns.

A transcript is the ordered rows of a conversation, cut into lines. Hidden states are the roles; a line's observation is its
speaker marker (``User:``, ``### Assistant``, ``<|im_start|>system`` and the like), its length, whether it asks, lists or quotes
code, and for a row's first line the length of the row. A role may change where a row begins or a marker stands. Start, transition
and emission counts are taken by Spark from all labelled conversations that are not held out (crc32(conv_id) mod 5 is not 0) and
smoothed. Whether a line is marked is taken to say nothing of its role; which role a marker names is learned from marked lines,
beginning from ``PRIOR`` observations of each marker for its own role and hardly any for others. The tables that reach the driver
have roles x observations rows. Roles of rows to be parsed are never looked at.

Rows of a conversation that has at most ``BLOCK_LINES`` lines and ``BLOCK_CHARS`` characters go to one task. Longer conversations
are dealt by ranges of (turn, text, running number) into blocks of about that size. Each block gives the best score from every role
before it to every role at its end (a 4 x 4 matrix in max-plus algebra); a pass over these matrices finds the role at each block's
edge, and every block is then decoded alone between its edges, which gives the Viterbi path of the whole. In training, a block's
first row follows the last row of the block before. A task decodes many conversations at once, one line of each in a step.

Defined cases: null texts are one empty line; null turns come first; rows with an equal turn are ordered by text, equal ones in any
order; repeated rows stay; a null conv_id is one conversation; unknown or null roles teach nothing; with nothing to learn from,
markers decide and roles alternate from the user. A very long text is one row and is held by one task, its lines some ten bytes
each besides. An empty table gives no rows. Only conv_id, turn, role and text are read, whatever else there is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, sized

#: The roles, and the names that mark or label them.
ROLES = ("system", "user", "assistant", "tool")
NAMES = {
    "system": "system", "instruction": "system", "instructions": "system", "user": "user", "human": "user", "customer": "user", "q": "user", "question": "user",
    "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant", "agent": "assistant", "a": "assistant", "answer": "assistant",
    "tool": "tool", "function": "tool", "observation": "tool",
}
MARKER = rf"(?i)^\s*(?:#{{1,4}}\s*|\*{{1,2}}|\[|<\|(?:im_start\|>)?)?({'|'.join(sorted(NAMES, key=len, reverse=True))})(?:\|>|\]|\*{{1,2}}:?|:|\s*$)\s*"
END = r"\s*<\|(?:im_end|end|eot_id)\|>\s*$"
MARKED, ENDED = re.compile(MARKER), re.compile(END)
BLOCK_LINES, BLOCK_CHARS = 1 << 16, 1 << 24
#: Lines that a task decodes at once, or one conversation's.
CHUNK_LINES = 50_000
SMOOTHING, PRIOR, STRANGE = 0.5, 20.0, 2e-5
#: How many values a line's marker (0: none), shape, length and row (0: not its first line) have; a line's code is one number for all.
SIZES = {"marker": 5, "shape": 5, "length": 10, "row": 18}


def role_of(name: Column) -> Column:
    """The role that a name stands for; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.lower(F.trim(name)))


def line_codes(text: Column) -> Column:
    """The code of every line of a text."""
    number = F.create_map(*[F.lit(x) for name, role in NAMES.items() for x in (name, ROLES.index(role) + 1)])

    def code(line: Column, i: Column) -> Column:
        marker = F.coalesce(F.try_element_at(number, F.lower(F.regexp_extract(line, MARKER, 1))), F.lit(0))
        shape = F.when(line.rlike(r"\?\s*$"), 0).when(line.rlike(r"^\s*(?:[-*+]|\d+[.)])\s"), 1).when(line.rlike(r"^(?:\t| {4}|```)"), 2).when(F.length(F.trim(line)) == 0, 3).otherwise(4)
        length = F.least(F.lit(9), F.floor(F.log2(F.length(line) + 1)))
        row = F.when(i == 0, F.least(F.lit(16), F.floor(F.log2(F.length(text) + 1) * 1.5)) + 1).otherwise(0)
        return (marker + 5 * (shape + 5 * (length + 10 * row))).cast("int")

    return F.transform(F.split(text, "\n"), code)


def values(codes: np.ndarray) -> dict[str, np.ndarray]:
    """The features of lines from their codes."""
    out = {}
    for name, n in SIZES.items():
        codes, out[name] = np.divmod(codes, n)
    return out


def rows_of(chats: DataFrame) -> DataFrame:
    """c, conv, turn, at, text, role, codes: c names the conversation and at orders turns; neither is null."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    text = F.coalesce("text", F.lit(""))
    return chats.select(F.coalesce(conv.cast("string"), F.lit("")).alias("c"), conv.alias("conv"), turn.alias("turn"), F.coalesce(turn, F.lit(-(1 << 63))).alias("at"), text.alias("text"), role_of(F.col("role")).alias("role"), line_codes(text).alias("codes"))


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of conversations for one task each, and a table of the others', if any, with block and pos: blocks follow the order of
    rows, and pos does in each."""
    size = rows.groupBy("c").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines"), F.sum(F.length("text")).alias("chars"))
    large = cut(size.where((F.col("lines") > BLOCK_LINES) | (F.col("chars") > BLOCK_CHARS)), "chat-large")
    lines, chars = large.agg(F.sum("lines"), F.sum("chars")).first()
    if lines is None:
        return rows, None
    large = sized(large.select("c"), 64)
    order = ["c", "at", "text", "mid"]
    blocks = 1 + int(max(lines / BLOCK_LINES, chars / BLOCK_CHARS))
    ranged = rows.join(large, "c", "left_semi").withColumn("mid", F.monotonically_increasing_id()).repartitionByRange(blocks, *order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"block": F.spark_partition_id(), "pos": F.monotonically_increasing_id()}).drop("mid", "at")
    return rows.join(large, "c", "left_anti"), cut(ranged, "chat-blocks")


def _moves(rows: DataFrame) -> DataFrame:
    """start, before, role, n: how often a role with a label begins a conversation or follows the row before."""
    short, blocks = dealt(rows)
    order = W.partitionBy("c").orderBy("at", "text")
    steps = short.select(F.lag("role").over(order).alias("before"), (F.row_number().over(order) == 1).alias("start"), "role")
    if blocks is not None:
        own, by_block = W.partitionBy("c", "block").orderBy("pos"), W.partitionBy("c").orderBy("block")
        ends = blocks.groupBy("c", "block").agg(F.max_by(F.struct("role"), "pos").alias("last"))
        ends = ends.select("c", "block", F.lag("last").over(by_block).alias("previous"))
        within = blocks.withColumns({"before": F.lag("role").over(own), "first": F.row_number().over(own) == 1}).join(ends, ["c", "block"])
        before = F.when(F.col("first"), F.col("previous.role")).otherwise(F.col("before"))
        steps = steps.unionByName(within.select(before.alias("before"), (F.col("first") & F.col("previous").isNull()).alias("start"), "role"))
    return steps.where("role is not null").groupBy("start", "before", "role").agg(F.count("*").alias("n"))


def fit(chats: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities of starts, transitions and lines' codes, from the labelled rows of ``chats``."""
    rows, n = rows_of(chats), len(ROLES)
    start, move = np.full(n, SMOOTHING), np.full((n, n), SMOOTHING)
    # an even start: the user speaks first and roles alternate
    for before, role in ((None, 1), (1, 2), (2, 1), (0, 1)):
        (start if before is None else move[before])[role] += 1
    for r in _moves(rows).collect():
        if r["before"]:
            move[ROLES.index(r["before"]), ROLES.index(r["role"])] += r["n"]
        elif r["start"]:
            start[ROLES.index(r["role"])] += r["n"]
    seen = np.zeros((int(np.prod(list(SIZES.values()))), n))
    for r in rows.where("role is not null").select("role", F.explode("codes").alias("code")).groupBy("role", "code").count().collect():
        seen[r["code"], ROLES.index(r["role"])] = r["count"]
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True)), "emit": emissions(seen)}


def emissions(seen: np.ndarray) -> np.ndarray:
    """Log likelihood of every code under each role, from how often lines of each role had it."""
    n, of = len(ROLES), values(np.arange(len(seen)))
    out = np.zeros(seen.shape)
    for name, size in SIZES.items():
        counts = np.zeros((size, n))
        np.add.at(counts, of[name], seen)
        if name == "marker":
            counts[1:] += np.where(np.eye(n, dtype=bool), PRIOR, STRANGE)
            counts[0] = 1
            counts[1:] /= counts[1:].sum(axis=0)
        else:
            counts = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)
        out += np.log(counts)[of[name]]
    return out


def viterbi(model: dict[str, np.ndarray], codes: np.ndarray, starts: np.ndarray, before: np.ndarray, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best scores at the ends of sequences of lines, and best paths, all sequences at once.

    ``starts`` has where each begins in ``codes``, with the end; ``before`` the role that it follows (-1: none), ``last`` the role
    that it ends in (-1: any); with no ``last`` there are no paths.
    """
    n, size = len(ROLES), np.diff(starts)
    order = np.argsort(-size, kind="stable")
    begin, long = starts[:-1][order], size[order]
    of = values(codes)
    free = (of["row"] > 0) | (of["marker"] > 0)
    stay = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
    none = before[order] < 0
    best = np.where(none[:, None], model["start"], stay[before[order]])
    back = np.zeros((len(codes) if last is not None else 0, n), np.int8)
    steps = int(long.max(initial=0))
    some = np.searchsorted(-long, -np.arange(steps), "left")
    for k in range(steps):
        m = some[k]
        at = begin[:m] + k
        step = best[:m, :, None] + np.where(free[at][:, None, None], model["move"], stay)
        if k == 0 and none.any():
            step[none] = np.where(np.eye(n, dtype=bool), best[none][:, None, :], -np.inf)
        if last is not None:
            back[at] = step.argmax(axis=1)
        best[:m] = step.max(axis=1) + model["emit"][codes[at]]
    scores = np.empty_like(best)
    scores[order] = best
    path = np.zeros(len(codes) if last is not None else 0, np.int8)
    if last is not None:
        state = np.where(last[order] < 0, best.argmax(axis=1), last[order])
        for k in range(steps - 1, -1, -1):
            m = some[k]
            at = begin[:m] + k
            path[at] = state[:m]
            state[:m] = back[at, state[:m]]
    return scores, path


def segments(batches: Iterator[pa.RecordBatch], by: tuple[str, ...], cols: tuple[str, ...] = ()) -> Iterator[tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by ``by``, many whole segments of equal ``by`` at a time: columns, where segments start among rows, where rows start
    among lines (both with the end), and the lines' codes."""
    held: dict[str, list] = {c: [] for c in (*by, *cols)}
    codes, size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut_at(k: int) -> tuple[dict[str, list], np.ndarray, np.ndarray, np.ndarray]:
        key = list(zip(*(held[c][:k] for c in by), strict=True))
        edge = [i for i in range(1, k) if key[i] != key[i - 1]]
        rows = np.concatenate([[0], np.cumsum(size[:k])])
        return {c: v[:k] for c, v in held.items()}, np.array([0, *edge, k]), rows, codes[: rows[-1]]

    for b in batches:
        for c, v in held.items():
            v += b.column(c).to_pylist()
        codes = np.concatenate([codes, b.column("codes").flatten().to_numpy()])
        size = np.concatenate([size, pc.list_value_length(b.column("codes")).to_numpy()])
        if len(codes) >= CHUNK_LINES:
            k = len(size) - 1
            last = tuple(held[c][k] for c in by)
            while k and tuple(held[c][k - 1] for c in by) == last:
                k -= 1
            if k:
                yield cut_at(k)
                codes, size, held = codes[int(size[:k].sum()) :], size[k:], {c: v[k:] for c, v in held.items()}
    if len(size):
        yield cut_at(len(size))


OUT_SCHEMA = "conv_id long, turn long, role_pred string, n_lines long, rendered string"


def _paths(model: dict[str, np.ndarray], by: tuple[str, ...], ends: tuple[str, ...]):
    """Sorted rows -> their canonical turns; ``ends`` names columns of the roles before and at the end of a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, line, codes in segments(batches, by, ("conv", "turn", "text", *ends)):
            begin = first[:-1]
            before, last = (np.array([-1 if (r := rows[c][k]) is None else r for k in begin]) for c in ends) if ends else (np.full(len(begin), -1), np.full(len(begin), -1))
            _, path = viterbi(model, codes, line[first], before, last)
            marked = values(codes)["marker"] > 0
            role = path[line[:-1]]
            rendered = [render(t, path[a:b], marked[a:b]) for t, a, b in zip(rows["text"], line[:-1].tolist(), line[1:].tolist(), strict=True)]
            cols = [pa.array(rows["conv"], pa.int64()), pa.array(rows["turn"], pa.int64()), pa.array([ROLES[k] for k in role], pa.string()), pa.array(np.diff(line), pa.int64()), pa.array(rendered, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "turn", "role_pred", "n_lines", "rendered"])

    return run


def _matrices(model: dict[str, np.ndarray]):
    """Blocks' rows in order -> m, best scores from each role before to each at the end, and s, those of a start with the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, first, line, codes in segments(batches, ("c", "block")):
            starts, n = line[first], len(first) - 1
            scores = [viterbi(model, codes, starts, np.full(n, k))[0] for k in range(-1, len(ROLES))]
            m = np.stack(scores[1:], axis=1).reshape(n, -1)
            cols = [pa.array([rows[c][k] for k in first[:-1]], t) for c, t in (("c", pa.string()), ("block", pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(m), pa.list_(pa.float64())), pa.array(list(scores[0]), pa.list_(pa.float64()))], names=["c", "block", "m", "s"])

    return run


def _edges(df: pd.DataFrame) -> pd.DataFrame:
    """Of one conversation's blocks, the roles before each and at its end."""
    df = df.sort_values("block").reset_index(drop=True)
    n = len(ROLES)
    score, back = np.array(df["s"][0]), []
    for m in df["m"][1:]:
        step = score[:, None] + np.array(m).reshape(n, n)
        back.append(step.argmax(axis=0))
        score = step.max(axis=0)
    last = [int(score.argmax())]
    for b in reversed(back):
        last.append(int(b[last[-1]]))
    last.reverse()
    return df[["c", "block"]].assign(before=[-1, *last[:-1]], last=last)


def parse(chats: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """conv_id, turn, role_pred, n_lines, rendered: a row of canonical turns for each row of ``chats``."""
    short, blocks = dealt(rows_of(chats).drop("role"))
    in_order = short.repartition("c").sortWithinPartitions("c", "at", "text").select("c", "conv", "turn", "text", "codes")
    out = in_order.mapInArrow(_paths(model, ("c",), ()), OUT_SCHEMA)
    if blocks is None:
        return out
    whole = lambda df: df.repartition("c", "block").sortWithinPartitions("c", "block", "pos")
    of = whole(blocks.select("c", "block", "pos", "codes")).mapInArrow(_matrices(model), "c string, block int, m array<double>, s array<double>")
    ends = cut(of.groupBy("c").applyInPandas(_edges, "c string, block int, before int, last int"), "chat-edges")
    with_ends = whole(blocks.join(sized(ends, 64), ["c", "block"]))
    return out.unionByName(with_ends.mapInArrow(_paths(model, ("c", "block"), ("before", "last")), OUT_SCHEMA))


def render(text: str, roles: np.ndarray, marked: np.ndarray) -> str:
    """Canonical turns: ``<|role|>``, the lines without markers, ``<|end|>``; lines of one role and no new marker are one turn."""
    if not marked.any() and "<|" not in text and (roles == roles[0]).all():
        return f"<|{ROLES[roles[0]]}|>\n{text.strip()}\n<|end|>\n"
    turns: list[tuple[int, list[str]]] = []
    for line, role, mark in zip(text.split("\n"), roles.tolist(), marked.tolist(), strict=True):
        if mark or not turns or turns[-1][0] != role:
            turns.append((role, []))
        turns[-1][1].append(ENDED.sub("", MARKED.sub("", line, count=1) if mark else line))
    return "".join(f"<|{ROLES[role]}|>\n{'\n'.join(body).strip()}\n<|end|>\n" for role, body in turns)


def report(chats: DataFrame) -> DataFrame:
    """conv_id, turn, held_out, role_pred, n_lines, rendered for every row."""
    held = F.coalesce(F.crc32(F.col("conv_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(chats.where(~held))
    return parse(chats, model).withColumn("held_out", held).select("conv_id", "turn", "held_out", "role_pred", "n_lines", "rendered")
