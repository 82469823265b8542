import hashlib
import random

import pytest
from palimpsest.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, segment string, valid int"


def want(rows):
    out, groups = {}, {}
    for r in rows:
        groups.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode()))
    for conv, turns in groups.items():
        turns = [(r.decode(), t.decode()) for _, _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    draw = random.Random(4)
    parts = ["### assistant:\n", "\n</turn>\n", "\\", "\\\\", "#", "<", ":", "é😀", "ok", "\n", "### ", "</turn>"]
    text = lambda: "".join(draw.choice(parts) for _ in range(draw.randint(0, 9)))
    rows = [(c, t, draw.choice(["system", "user", "assistant", "tool: ###", ""]), text()) for c in range(30) for t in range(draw.randint(1, 9))]
    rows += [(100, None, None, None), (100, 1, "user", None), (None, 0, "user", "x"), (101, 5, "user", "same"), (101, 5, "user", "same"), (102, 0, "assistant", "long " * 50_000), (103, 1, "assistant", "late"), (103, 0, "user", "early")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    segments = C.format_turns(frame)
    out = {r.conv_id: r for r in C.read_back(segments).collect()}
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for k, r in out.items()} == want(rows)
    assert out[103].valid and not out[102].valid and not out[101].valid and not out[100].valid
    assert {r.conv_id: r.n for r in segments.selectExpr("conv_id", "char_length(segment) AS c").groupBy("conv_id").sum("c").toDF("conv_id", "n").collect()} == {k: r.formatted_chars for k, r in out.items()}


def test_turn_order():
    t = C.Template()
    walk = lambda *roles: all(b in t.moves.get(a, ()) for a, b in zip(("start", *roles), roles, strict=False))
    assert walk("user", "assistant", "user") and walk("system", "user", "assistant")
    assert not walk("assistant") and not walk("user", "user") and not walk("system", "system") and not walk("user", "system")


def test_other_templates_and_nothing(spark):
    t = C.Template(opening="<|", opened="|>", closing="<|end|>", escape="~", controls="~<|", learned=frozenset({"user"}))
    rows = [(1, 0, "user", "a<|end|>~b|>"), (1, 1, "assistant", "c")]
    (r,) = C.read_back(C.format_turns(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA), t), t).collect()
    assert (r.n_turns, r.turns_sha256) == want(rows)[1][:2] and r.loss_chars == len(rows[0][3])
    assert C.read_back(C.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_stored_segments_are_sorted_or_refused(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"text {c} {t}") for c in range(30) for t in range(6)] + [(None, 0, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = sorted(map(tuple, C.read_back(C.format_turns(table)).collect()), key=repr)
    C.format_turns(table).repartition(5, "segment").write.parquet(str(tmp_path / "segments"))
    stored = spark.read.parquet(str(tmp_path / "segments"))
    assert sorted(map(tuple, C.read_back(stored, ordered=False).collect()), key=repr) == want
    with pytest.raises(Exception, match="ordered=False"):
        C.read_back(stored).collect()
