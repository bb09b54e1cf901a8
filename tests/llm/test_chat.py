from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import functions as F

from skyrill.llm import chat

SF = "/root/testdata/sf0.001"


def test_markers():
    assert [chat.marker(x)[0] for x in ("User: hi", "AI:", "### Response: x", "[system] y", "<|user|>", "A fine day", "Question of taste", "")] == [2, 3, 3, 1, 2, 0, 0, 0]


def test_blocks_do_not_change_the_path():
    rng = np.random.default_rng(1)
    step, emit = np.log(rng.random((7, 6))), np.log(rng.random((7, 6)))
    best = max(itertools.product(range(6), repeat=4), key=lambda p: step[6, p[0]] + emit[0, p[0]] + sum(step[a, b] + emit[k + 1, b] for k, (a, b) in enumerate(zip(p, p[1:]))))
    (path,) = chat.best_paths([emit[:4]], step, [6], [-1])
    assert tuple(path) == best
    m = chat.block_matrix(emit[:4], step)
    assert np.isclose(m[6].max(), step[6, best[0]] + emit[0, best[0]] + sum(step[a, b] + emit[k + 1, b] for k, (a, b) in enumerate(zip(best, best[1:]))))


def test_recovers_roles_and_ignores_block_size(spark):
    c = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    lines = chat.transcripts(c).cache()
    hmm = chat.fit(chat.learned_from(lines))
    a, b = (chat.parse(lines.drop("role"), hmm, n).cache() for n in (512, 3))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    # Conversations that the model has not seen; markers alone are right for three quarters.
    truth = c.where(F.crc32(F.col("conv_id").cast("string")) % 3 == 1).select("conv_id", "turn", F.col("role").alias("r"))
    right = truth.join(a, ["conv_id", "turn"]).where("r = role").count()
    assert right >= 0.85 * truth.count() > 0, right / truth.count()
    assert a.where("not startswith(rendered, '<|im_start|>') or not endswith(rendered, '<|im_end|>\n')").count() == 0


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (None, 0, "user", "User text"), (2, 0, "other", "x\n\ny"), (2, 0, "user", "User again?")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lines = chat.transcripts(c)
    out = chat.parse(lines.drop("role"), chat.fit(lines))
    assert out.agg(F.sum("n_lines")).first()[0] == lines.count()
    empty = lines.limit(0)
    assert chat.parse(empty.drop("role"), chat.fit(empty)).count() == 0


def test_equals_one_path_over_each_conversation(spark):
    """Blocks and ranges of tasks against one Viterbi path over all lines of a conversation."""
    rng = np.random.default_rng(3)
    texts = ["User: hello there?", "AI: a long answer " * 5, "plain line", "System: be kind", "", "Q: why?", "tail " * 30]
    rows = [(k % 3 if k % 3 else None, int(t) if rng.random() < 0.9 else None, 0, texts[rng.integers(len(texts))] + str(k % 2)) for k, t in enumerate(rng.integers(0, 40, 400))]
    lines = spark.createDataFrame(rows, "conv_id long, turn long, place int, line string")
    hmm = chat.fit(chat.transcripts(spark.read.parquet(f"{SF}/conversations.parquet")))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:3]) + (r[3],)
    want = {}
    for conv in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        seen, bare = chat.features([r[3] for r in own])
        (path,) = chat.best_paths([hmm.emit.T[seen]], hmm.step, [chat.START], [-1])
        begins = np.cumsum(path % 2 == 0) - 1
        for n in range(begins.max() + 1):
            at = np.flatnonzero(begins == n)
            want[conv, n] = (chat.ROLES[path[at[0]] // 2], len(at), "<|im_start|>" + chat.ROLES[path[at[0]] // 2] + "\n" + "\n".join(bare[i] for i in at).strip(" ") + "<|im_end|>\n")
    got = {(r.conv_id, r.turn): (r.role, r.n_lines, r.rendered) for r in chat.parse(lines, hmm, 16).collect()}
    assert got == want
