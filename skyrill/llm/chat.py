"""Chat formatting: roles of raw transcripts by a hidden Markov model, then canonical turns.

A transcript is lines in order. The hidden state of a line is its speaker's
role and whether it begins a turn; what is seen is a speaker marker, a length
class and a question mark at the end. Emissions, who speaks after whom and who
speaks first are counted by grouped aggregates over labelled lines (at most
``6 * 4 * 4 * 2``, 9 and 3 rows); the query learns from two thirds of the
conversations, by a hash of their id, and labels all.

Viterbi's recursion is a product of matrices over (max, +). Lines are dealt to
tasks by ranges of (conversation, place), so that a long conversation is many
tasks' work, and each task cuts its lines by their running number into blocks of
``BLOCK_LINES`` at most: blocks reduce to 7 x 6 matrices independently, a pass
over the few block matrices of a conversation fixes the state at each border,
and blocks then find their own best paths. No task holds more lines than a
batch and a block, however long a conversation or a turn is and whatever its
numbers of turns are.

Defined results: a null or empty text is one blank line; a text of any number of
lines is many blocks; rows without a
conversation id form one conversation; rows with equal (conv_id, turn), or
without a turn, keep all their lines, ordered by place and text; roles other
than the three are not learned from; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

ROLES = ("system", "user", "assistant")
BLOCK_LINES = 512
#: Names of speakers in raw transcripts.
SPEAKERS = {
    "system": ("system", "sys", "system prompt"),
    "user": ("user", "human", "question", "q", "prompt", "instruction", "customer"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "response", "agent"),
}
#: Marker styles of the transcripts that ``transcripts`` makes, in the order of ROLES.
STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("SYSTEM: ", "Human: ", "AI: "),
    ("System: ", "Q: ", "A: "),
    ("### System: ", "### Instruction: ", "### Response: "),
    ("[system] ", "[user] ", "[assistant] "),
    ("<|system|> ", "<|user|> ", "<|assistant|> "),
)
UNMARKED_ONE_IN = 7
LENGTH_STEPS = (40, 120, 400)

_ROLE_OF = {name: k for k, role in enumerate(ROLES) for name in SPEAKERS[role]}
_NAMES = "|".join(sorted(_ROLE_OF, key=len, reverse=True))
_MARKER = regex.compile(rf"\s*(?:(?P<open>\#{{1,4}}\s*|\*\*)?(?P<name>{_NAMES})(?:\*\*)?\s*:|\[(?P<name>{_NAMES})\]:?|<\|(?P<name>{_NAMES})\|>:?)\s?", regex.IGNORECASE)
N_STATES = 2 * len(ROLES)
START = N_STATES


def marker(line: str) -> tuple[int, int]:
    """(1 + role number, length) of a speaker marker at the start of a line, else (0, 0)."""
    m = _MARKER.match(line)
    return (1 + _ROLE_OF[m["name"].lower()], m.end()) if m else (0, 0)


def features(lines: list[str]) -> tuple[np.ndarray, list[str]]:
    """The observation number of each line, and the lines without their markers."""
    seen, bare = np.zeros(len(lines), np.int64), []
    for i, line in enumerate(lines):
        role, cut = marker(line)
        text = line[cut:]
        size = sum(len(text) > s for s in LENGTH_STEPS)
        seen[i] = (role * 4 + size) * 2 + text.rstrip().endswith("?")
        bare.append(text)
    return seen, bare


N_SEEN = 4 * 4 * 2


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, place, line, role) of raw transcripts made from labelled turns.

    A conversation has one marker style, and one turn in ``UNMARKED_ONE_IN`` has no marker.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    styles = F.array(*[F.array(*map(F.lit, s)) for s in STYLES])
    style = styles[F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")]
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int")
    marked = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(UNMARKED_ONE_IN)) != 0) & (role > 0)
    text = F.concat(F.when(marked, F.element_at(style, role)).otherwise(""), F.col("text"))
    return rows.select("conv_id", "turn", "role", F.posexplode(F.split(text, "\n", -1)).alias("place", "line"))


class Hmm:
    """Log probabilities: ``step`` from each state (and START) to each state, ``emit`` of each observation."""

    def __init__(self, counts: dict[tuple[int, int], int], follows: dict[tuple[int, int], int], starts: dict[int, int]):
        emit = np.full((N_STATES, N_SEEN), 0.1)
        for (state, seen), n in counts.items():
            emit[state, seen] += n
        after = np.full((len(ROLES), len(ROLES)), 0.5)
        for pair, n in follows.items():
            after[pair] += n
        after /= after.sum(1, keepdims=True)
        begin = emit[0::2].sum(1) / (emit[0::2].sum(1) + emit[1::2].sum(1))
        step = np.full((N_STATES + 1, N_STATES), 1e-9)
        for r in range(len(ROLES)):
            for own in (2 * r, 2 * r + 1):
                step[own, 2 * r + 1] = 1 - begin[r]
                step[own, 0::2] = begin[r] * after[r]
        step[START, 0::2] = [0.5 + starts.get(k, 0) for k in range(len(ROLES))]
        step[START, 0::2] /= step[START, 0::2].sum()
        self.step = np.log(step)
        self.emit = np.log(emit / emit.sum(1, keepdims=True))


def fit(lines: DataFrame) -> Hmm:
    """Count states, observations, successions of roles and first roles over all labelled lines."""

    def observed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            state = 2 * b["role"].map({r: k for k, r in enumerate(ROLES)}) + (b["place"] > 0)
            yield pd.DataFrame({"state": state, "seen": features(b["line"].tolist())[0]})

    known = lines.where(F.col("role").isin(*ROLES))
    counts = known.select("role", "place", "line").mapInPandas(observed, "state int, seen int").groupBy("state", "seen").count().collect()
    # One role for each turn, so that the join of a turn with the next one cannot multiply rows.
    number = (F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1).cast("int")
    turns = known.where("turn is not null").groupBy("conv_id", "turn").agg(F.min(number).alias("r"))
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("r").alias("s"))
    follows = turns.join(later, ["conv_id", "turn"]).groupBy("r", "s").count().collect()
    starts = turns.groupBy("conv_id").agg(F.min(F.struct("turn", "r")).alias("x")).groupBy("x.r").count().collect()
    return Hmm({(r["state"], r["seen"]): r["count"] for r in counts}, {(r["r"], r["s"]): r["count"] for r in follows}, {r["r"]: r["count"] for r in starts})


def learned_from(lines: DataFrame) -> DataFrame:
    """Lines of the conversations that the query learns from: two thirds, by a hash of the id."""
    return lines.where(F.crc32(F.col("conv_id").cast("string")) % 3 != 1)


def best_paths(emit: list[np.ndarray], step: np.ndarray, entry: list[int], leave: list[int]) -> list[np.ndarray]:
    """Viterbi paths of many blocks at once, from a state before each block to a state at its end (-1: any)."""
    order = sorted(range(len(emit)), key=lambda k: -len(emit[k]))
    longest = len(emit[order[0]]) if order else 0
    sizes = np.array([len(emit[k]) for k in order])
    score = np.stack([step[entry[k]] + emit[k][0] for k in order]) if order else np.zeros((0, N_STATES))
    back = np.zeros((longest, len(order), N_STATES), np.int8)
    for t in range(1, longest):
        n = int((sizes > t).sum())
        options = score[:n, :, None] + step[None, :N_STATES]
        back[t, :n] = options.argmax(1)
        score[:n] = options.max(1) + np.stack([emit[k][t] for k in order[:n]])
    out: list[np.ndarray] = [np.zeros(0, int)] * len(emit)
    for i, k in enumerate(order):
        path = np.zeros(sizes[i], int)
        path[-1] = leave[k] if leave[k] >= 0 else score[i].argmax()
        for t in range(sizes[i] - 1, 0, -1):
            path[t - 1] = back[t, i, path[t]]
        out[k] = path
    return out


def block_matrix(emit: np.ndarray, step: np.ndarray) -> np.ndarray:
    """(7, 6) best scores from each state before a block to each state at its end."""
    m = step + emit[0]
    for e in emit[1:]:
        m = (m[:, :, None] + step[None, :N_STATES]).max(1) + e
    return m


def whole_keys(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of rows sorted by ``keys``, cut so that no key is in two of them."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        last = b[keys].iloc[-1]
        same = np.ones(len(b), bool)
        for k in keys:
            same &= (b[k] == last[k]).to_numpy() | (b[k].isna().to_numpy() & pd.isna(last[k]))
        held = b[same]
        if not same.all():
            yield b[~same].reset_index(drop=True)
    if held is not None and len(held):
        yield held.reset_index(drop=True)


def _cuts(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """First row of each key in sorted rows, and the number of rows."""
    new = np.zeros(len(b), bool)
    new[0] = True
    for k in keys:
        v, missing = b[k].to_numpy(), b[k].isna().to_numpy()
        new[1:] |= (v[1:] != v[:-1]) & ~(missing[1:] & missing[:-1])
    return np.append(np.flatnonzero(new), len(b))


def parse(lines: DataFrame, hmm: Hmm | Callable[[], Hmm], block_lines: int = BLOCK_LINES) -> DataFrame:
    """(conv_id, turn, role, n_lines, rendered) of the turns found in transcript lines (conv_id, turn, place, line).

    ``turn`` and ``place`` only order the lines of a conversation.
    """
    model = hmm() if callable(hmm) else hmm
    held = lines.sparkSession.sparkContext.broadcast(model)
    order = ["conv_id", "turn", "place", "line"]

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Lines in order, with a block number that grows along a conversation, a place in the block, and what is seen."""
        block, last, size = TaskContext.get().partitionId() << 40, None, 0
        for b in batches:
            if not len(b):
                continue
            seen, bare = features(b["line"].tolist())
            cut = _cuts(b, ["conv_id"])
            number, pos = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for x, y in zip(cut, cut[1:]):
                conv = b["conv_id"].iloc[x]
                if size and not (conv == last or pd.isna(conv) and pd.isna(last)):
                    block, size = block + 1, 0
                at = size + np.arange(y - x)
                number[x:y], pos[x:y] = block + at // block_lines, at % block_lines
                block, size, last = int(number[y - 1]), int(pos[y - 1]) + 1, conv
            yield pd.DataFrame({"conv_id": b["conv_id"], "block": number, "pos": pos, "seen": seen, "line": bare})

    rows = lines.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stage(rows.mapInPandas(observe, "conv_id long, block long, pos long, seen long, line string"), "transcript")
    keys = ["block"]

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = held.value
        for b in whole_keys(batches, keys):
            seen, cut = b["seen"].to_numpy(), _cuts(b, keys)
            yield pd.DataFrame({"conv_id": b["conv_id"].to_numpy()[cut[:-1]], "block": b["block"].to_numpy()[cut[:-1]], "m": [block_matrix(h.emit.T[seen[x:y]], h.step).reshape(-1).tolist() for x, y in zip(cut, cut[1:])]})

    def borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in whole_keys(batches, ["conv_id"]):
            cut = _cuts(b, ["conv_id"])
            entry, leave = np.zeros(len(b), int), np.zeros(len(b), int)
            for x, y in zip(cut, cut[1:]):
                score, trail = None, []
                for m in b["m"].iloc[x:y]:
                    m = np.asarray(m).reshape(N_STATES + 1, N_STATES)
                    options = m[START][None] if score is None else score[:, None] + m[:N_STATES]
                    trail.append(options.argmax(0))
                    score = options.max(0)
                state = int(score.argmax())
                for k in range(y - x - 1, -1, -1):
                    leave[x + k] = state
                    state = int(trail[k][state]) if k else START
                    entry[x + k] = state
            yield pd.DataFrame({"conv_id": b["conv_id"], "block": b["block"], "entry": entry, "leave": leave})

    again = dealt.select("conv_id", "block", "pos", "seen").repartition("block").sortWithinPartitions("block", "pos")
    summary = again.mapInPandas(matrices, "conv_id long, block long, m array<double>")
    ends = stage(summary.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(borders, "conv_id long, block long, entry int, leave int"), "borders")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h = held.value
        for b in whole_keys(batches, keys):
            seen, cut = b["seen"].to_numpy(), _cuts(b, keys)
            paths = best_paths([h.emit.T[seen[x:y]] for x, y in zip(cut, cut[1:])], h.step, b["entry"].to_numpy()[cut[:-1]].tolist(), b["leave"].to_numpy()[cut[:-1]].tolist())
            state = np.concatenate(paths)
            begins = np.cumsum(state % 2 == 0)
            own = begins - np.repeat(np.append(0, begins)[cut[:-1]], np.diff(cut))
            yield pd.DataFrame({"conv_id": b["conv_id"], "block": b["block"], "pos": b["pos"], "line": b["line"], "role": [ROLES[s // 2] for s in state], "own": own})

    joined = dealt.join(ends.drop("conv_id"), "block").repartition("block").sortWithinPartitions("block", "pos")
    labelled = stage(joined.select("conv_id", "block", "pos", "seen", "line", "entry", "leave").mapInPandas(label, "conv_id long, block long, pos long, line string, role string, own long"), "labelled")
    # Turns of earlier blocks, by a running sum over block counts.
    counts = labelled.groupBy("conv_id", "block").agg(F.max("own").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("block", "base")
    numbered = labelled.join(offsets, "block").select("conv_id", (F.col("base") + F.col("own") - 1).alias("number"), F.struct("block", "pos", "line", "role").alias("x"))
    turns = numbered.groupBy("conv_id", "number").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return turns.select("conv_id", F.col("number").alias("turn"), F.col("x")[0]["role"].alias("role"), F.size("x").cast("long").alias("n_lines"), render(F.col("x")[0]["role"], F.array_join(F.col("x.line"), "\n")).alias("rendered"))


def render(role: Column, content: Column) -> Column:
    """One turn in canonical form."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), F.trim(content), F.lit("<|im_end|>\n"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = stage(transcripts(table(spark, sf_dir, "conversations")), "lines")
    return parse(lines.drop("role"), fit(learned_from(lines)))
