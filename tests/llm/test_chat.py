"""Snapshots of conversations and their rendering."""

import duckdb

from driftloom.llm import chat
from driftloom.llm.queries import ORACLES


def plain(rows):
    """conv_id -> rendered, of rows (conv_id, turn, role, text)."""
    held = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "user", r[3] or "")):
        held.setdefault(c, []).append((role or "user", text or ""))
    kept = {
        c: t for c, t in held.items()
        if not any(
            u[:len(t)] == t and (len(u) > len(t) or (d is None, d) != (c is None, c) and (c is None or d is not None and d < c))
            for d, u in held.items() if d != c
        )
    }
    return {
        c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n".replace("<|im_s", "\0").replace("<|im_e", "\1")
                   .replace("<|im_", "<| im_").replace("\0", "<|im_s").replace("\1", "<|im_e") for r, x in t)
        for c, t in kept.items()
    }


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"),
    (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 11, "user", "more"),
    (4, 0, None, "hi"), (4, 1, "assistant", None),
    (5, None, "system", ""), (5, 0, "user", "x"), (6, 0, "user", "one"), (6, 0, "user", "one"), (7, 0, "user", "one"),
    (None, 0, "user", "lost"), (8, 0, "user", "other hi"),
]
SCHEMA = "conv_id long, turn long, role string, text string, part int"


def test_prefixes_and_copies_go(spark):
    found = {r.conv_id: r.rendered for r in chat.format_conversations(
        spark.createDataFrame([(*r, 0) for r in ROWS], SCHEMA)).collect()}
    assert found == plain(ROWS)
    assert set(found) == {2, 4, 5, 6, None, 8}


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_TURNS", 7)
    rows = [(c, k, "user", f"turn {k} <|im_end|>", 0) for c, n in ((1, 400), (2, 399), (3, 401)) for k in range(n)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r.conv_id for r in out} == {3} and len(out) == 58
    whole = "".join(r.rendered for r in sorted(out, key=lambda r: r.part))
    assert whole == "".join(f"<|im_start|>user\nturn {k} <| im_end|><|im_end|>\n" for k in range(401))


def test_no_turns(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_equal_sql(spark):
    folder = "/root/testdata/sf0.01"
    out = chat.format_conversations(spark.read.parquet(f"{folder}/conversations.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = db.execute(f"SELECT conv_id, part, n_turns, rendered FROM ({ORACLES['op2_chat_snapshots']})").fetchall()
    assert sorted(tuple(r) for r in out.select("conv_id", "part", "n_turns", "rendered").collect()) == sorted(want)
