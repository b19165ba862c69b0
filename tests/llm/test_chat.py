import hashlib
import random

from balance_spark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["\\", "###", "### user: ", "</turn>", "\\### Assistant: </turn> ok", ":", "\n", "", "é語", "\\\\###"]


def plain(rows):
    conversations = {}
    for conv, turn, role, text in rows:
        conversations.setdefault(conv, []).append((turn, role or "", text or ""))
    out = set()
    for conv, turns in conversations.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        hashed = [hashlib.sha256(x.encode()).hexdigest() for x in (said, loss)]
        out.add((conv, len(turns), hashed[0], len(loss), hashed[1]))
    return out


def read(spark, rows, block_chars):
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS leaf", "1 AS turns")
    formatted = chat.format_turns(table)
    blocks = chat.prefix_blocks(formatted, block_chars=block_chars)
    leaves = chat.read_leaves(blocks)
    return blocks, chat.members_of(formatted).join(leaves, "leaf").drop("leaf")


def test_round_trip(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "assistant", "we:ird\\", None])
            text = rng.choice([None, "".join(rng.choice(ODD) for _ in range(rng.randrange(5)))])
            rows.append((conv, turn, role, text))
    rows += [(50, 1, "assistant", "b"), (50, 1, "assistant", "b"), (50, None, "user", "a"), (None, 0, "user", "n")]
    rows = [(c, -1 if t is None else t, r, x) for c, t, r, x in rows]
    _, got = read(spark, rows, 200)
    assert {tuple(r)[:5] for r in got.collect()} == plain(rows)
    assert read(spark, [r for r in rows if False] or [], 200)[1].count() == 0


def test_shared_turns_stand_once(spark):
    rows = []
    for conv in range(20):
        rows += [(conv, 0, "system", "the same"), (conv, 1, "user", f"q{conv % 3}")]
        rows += [(conv, 2, "assistant", f"a{conv}")]
    rows += [(99, *r[1:]) for r in rows if r[0] == 4]  # a copy
    blocks, got = read(spark, rows, 1 << 16)
    held = blocks.collect()
    assert sum(b["text"].count("the same") for b in held) == len(held)
    assert {tuple(r)[:5] for r in got.collect()} == plain(rows)
    for block in held:
        positions = chat.position_ids(block["segments"])
        assert len(positions) == len(block["text"])
        for s in block["segments"]:
            path, at = [], s
            while True:
                path.append((at["start"], at["end"]))
                if at["parent"] < 0:
                    break
                at = block["segments"][at["parent"]]
            seen = {k for a in s["attends"] for k in range(a["start"], a["end"])}
            assert seen == {k for a, b in path for k in range(a, b)}
            assert positions[s["start"]] == sum(b - a for a, b in path[1:])
        starts = [s["start"] for s in block["segments"]]
        assert starts == sorted(starts)
