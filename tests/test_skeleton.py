"""Skeleton parsing against a plain-Python walk of the rules.

The Spark side is forced into many chunks per dialog (tiny ``chunk_rows``,
several range partitions, a dialog holding a third of all blocks) so the
cross-chunk carry of depth, step and jumps is exercised.
"""

import datetime as dt
import random
import re

import pytest

from dialogscope.operators import skeleton

TOKENS = ["plan", "info", "info 3", "info12x7", "infox", "action", "action 2", "bossaction", "bossaction 9",
          "problem", "summary", "zzz", "  action ", "\tinfo 7\t", "", "   ", "problem ", "Plan", "actionable",
          "information 5", "　summary ", "plan\r", "other text", "\x1cinfo 44\x1f"]
DEEPER = ("action", "bossaction")
RESETS = ("plan", "info", "problem", "summary")


def kind(b):
    if b == "plan":
        return "plan"
    for prefix in ("info", "action"):
        if b.startswith(prefix):
            return prefix
    if b == "problem":
        return "problem"
    if b.startswith("bossaction"):
        return "bossaction"
    return "summary" if b == "summary" else "other"


def walk(blocks):
    """Expected (pos, block, type, depth, cum_depth, step, is_jump) rows."""
    out, depth, cum, step = [], 0, 0, 0
    types = [kind(b) for b in blocks]
    for i, (b, t) in enumerate(zip(blocks, types)):
        if t in RESETS:
            depth = 0
        if t in DEEPER:
            depth += 1
            cum += 1
        if t == "info":
            digits = re.search(r"[0-9]+", b)
            step = int(digits.group()) if digits else step
        jump = i + 1 < len(blocks) and b.startswith("action") and not blocks[i + 1].startswith("action")
        out.append((i, b, t, depth, cum, step, jump))
    return out


def split_blocks(text):
    if text is None:
        return []
    return [s.strip() for s in text.split("\n") if s.strip()]


def random_skeletons(seed, n_dialogs, hot_blocks=0):
    rnd = random.Random(seed)
    rows = []
    for d in range(n_dialogs):
        n = hot_blocks if (d == 0 and hot_blocks) else rnd.randint(0, 30)
        rows.append((f"d{d:04d}", "\n".join(rnd.choice(TOKENS) for _ in range(n))))
    rows += [("null", None), ("empty", ""), ("blank", " \n\t\n"), ("only-other", "x\ny\nz"),
             ("ends-action", "plan\naction"), ("ends-boss", "info 2\nbossaction"),
             ("action-boss", "action\nbossaction\nsummary")]
    return rows


def expected_rows(rows):
    exp = {}
    for did, text in rows:
        for r in walk(split_blocks(text)):
            exp[(did, r[0])] = r[1:]
    return exp


@pytest.mark.parametrize("piece", [1, 5, None, 1 << 14])
def test_text_skeletons_match_walk(spark, piece):
    rows = random_skeletons(7, 60, hot_blocks=400)
    df = spark.createDataFrame(rows, "dialog_id string, skeleton string")
    got = skeleton.parse_skeletons(df, piece_rows=piece).collect()
    exp = expected_rows(rows)
    assert len(got) == len(exp)
    counts = {}
    for did, text in rows:
        counts[did] = len(split_blocks(text))
    for r in got:
        e = exp[(r.dialog_id, r.pos)]
        assert (r.block, r.block_type, r.depth, r.cum_depth, r.step, r.is_jump) == e, (r, e)
        assert r.n_blocks == counts[r.dialog_id]
        assert (r.x, r.y) == (r.pos, -r.depth)


@pytest.mark.parametrize("parts", [1, 7, 29])
def test_event_stream_with_hot_dialog(spark, parts):
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1)
    rows, per = [], {}
    eid = 0
    for d in range(12):
        n = 600 if d == 0 else rnd.randint(1, 60)  # dialog 0 holds most rows
        for _ in range(n):
            eid += 1
            ts = base + dt.timedelta(seconds=rnd.randint(0, 10_000))
            b = rnd.choice([t for t in TOKENS if t.strip()]).strip()
            rows.append((f"u{d}", ts, eid, b))
            per.setdefault(f"u{d}", []).append((ts, eid, b))
    df = spark.createDataFrame(rows, "dialog_id string, ts timestamp_ntz, event_id long, block string")
    got = skeleton.parse_block_stream(df, ("ts", "event_id"), range_partitions=parts).collect()
    assert len(got) == len(rows)
    exp = {}
    for did, evs in per.items():
        for r in walk([b for _, _, b in sorted(evs)]):
            exp[(did, r[0])] = r[1:]
    for r in got:
        assert (r.block, r.block_type, r.depth, r.cum_depth, r.step, r.is_jump) == exp[(r.dialog_id, r.pos)]
    drop = {r.dialog_id: r for r in skeleton.dropoff(df, ("ts", "event_id"), with_block=True).collect()}
    types = {r.dialog_id: (r.last_type, r.dropped) for r in skeleton.dropoff(df, ("ts", "event_id")).collect()}
    assert types == {i: (r.last_type, r.dropped) for i, r in drop.items()}
    for did, evs in per.items():
        last = sorted(evs)[-1][2]
        assert drop[did].last_block == last
        assert drop[did].dropped == (kind(last) in DEEPER)


def test_repeated_and_null_ids_are_walked_cell_by_cell(spark):
    rows = [("a", "plan\naction\naction")] * 2 + [(None, "action\n" * 400 + "info 3\naction"), (None, "action\nplan")] * 2
    for piece in (1, 5, None, 1 << 14):
        got = skeleton.parse_skeletons(spark.createDataFrame(rows, "dialog_id string, skeleton string"), piece_rows=piece).collect()
        want = [(i, *r[:2], len(split_blocks(t)), *r[2:]) for i, t in rows for r in walk(split_blocks(t))]
        assert sorted(((r.dialog_id, r.pos, r.block, r.n_blocks, r.block_type, r.depth, r.cum_depth, r.step, r.is_jump) for r in got),
                      key=repr) == sorted(want, key=repr)


def test_event_stream_keeps_null_ids(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(None if k % 3 == 0 else "d", base + dt.timedelta(seconds=k), k, "action" if k % 4 else "plan") for k in range(120)]
    df = spark.createDataFrame(rows, "dialog_id string, ts timestamp_ntz, event_id long, block string")
    for parts in (1, 9):
        got = skeleton.parse_block_stream(df, ("ts", "event_id"), range_partitions=parts).collect()
        want = [(i, *r) for i in (None, "d") for r in walk([x[3] for x in rows if x[0] == i])]
        assert sorted(((r.dialog_id, r.pos, r.block, r.block_type, r.depth, r.cum_depth, r.step, r.is_jump) for r in got), key=repr) \
            == sorted(want, key=repr)


def test_text_parsing_is_narrow_and_dropoff_hashes(spark):
    df = spark.createDataFrame([("a", "plan")], "dialog_id string, skeleton string")
    assert "Exchange" not in skeleton.parse_skeletons(df)._jdf.queryExecution().executedPlan().toString()
    ev = spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1, "plan")], "dialog_id string, ts timestamp_ntz, event_id long, block string")
    assert "SortAggregate" not in skeleton.dropoff(ev, ("ts", "event_id"))._jdf.queryExecution().executedPlan().toString()


def test_excerpts_match_rule(spark):
    rnd = random.Random(3)
    rows = []
    for d in range(40):
        nb = rnd.randint(0, 12)
        nl = rnd.randint(0, 40)
        text = None if d % 9 == 0 else ("" if d % 11 == 0 else "\n".join(f"l{d}-{i}" for i in range(nl)))
        rows.append((f"d{d}", "\n".join(rnd.choice(["plan", "action", "info 1"]) for _ in range(nb)), text))
    df = spark.createDataFrame(rows, "dialog_id string, skeleton string, dialog_text string")
    got = {(r.dialog_id, r.pos): r.excerpt for r in skeleton.block_excerpts(df).collect()}
    exp = {}
    for did, skel, text in rows:
        blocks = split_blocks(skel)
        for i in range(len(blocks)):
            if not text:
                exp[(did, i)] = None
                continue
            lines = text.split("\n")
            k = max(1, len(lines) // len(blocks))
            exp[(did, i)] = "\n".join(lines[i * k:min(i * k + k + 5, len(lines))])
    assert got == exp


def test_quality_reasons(spark):
    rows = [("a", None), ("b", ""), ("c", " \n \t"), ("d", "plan"), ("e", "\n\nx\n")]
    df = spark.createDataFrame(rows, "dialog_id string, skeleton string")
    got = {r.reason: r.n_dialogs for r in skeleton.skeleton_quality(df).collect()}
    assert got == {"null": 1, "empty": 1, "blank": 1, "ok": 2}


def test_labels_and_rollup(spark):
    df = spark.createDataFrame([("a", "plan\naction\nzz"), ("b", "info 4\naction\nbossaction")],
                               "dialog_id string, skeleton string")
    state = skeleton.parse_skeletons(df)
    labels = {(r.dialog_id, r.pos): r for r in skeleton.with_labels(state).collect()}
    assert labels[("a", 0)].point_label == "1. 📋 План"
    assert labels[("a", 2)].point_label == "3. zz"
    assert labels[("a", 1)].menu_label == "2. action (action)"
    assert labels[("b", 2)].ordinal == "3 из 3"
    roll = {r.last_type: r for r in skeleton.dropoff_rollup(state).collect()}
    assert roll["other"].n_dialogs == 1 and not roll["other"].dropped
    assert roll["bossaction"].dropped and roll["bossaction"].max_depth == 2
    assert roll["other"].n_jumps == 1  # "action" followed by "zz"
    assert roll["bossaction"].n_jumps == 1  # "action" followed by "bossaction"
