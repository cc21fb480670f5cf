from __future__ import annotations

from collections import defaultdict

from clusterloom.llm import perspective_chat as p
from clusterloom.llm.queries import QUERIES


def expected(rows, piece=64):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "unknown", (text or "").replace("<|", "<\\|")))
    out = []
    for conv, turns in groups.items():
        turns.sort()
        people = sorted({t[2] for t in turns} - {"system"})
        for who in people:
            for k in range(0, len(turns), piece):
                body, mask = "", []
                for _, _, role, text in turns[k:k + piece]:
                    head = "<|assistant|>\n" if role == who else "<|system|>\n" if role == "system" else f"<|user|>{role}\n"
                    if role == who:
                        mask.append((len(body) + len(head), len(body) + len(head) + len(text) + 7))
                    body += head + text + "<|end|>\n"
                out.append((repr(conv), who, k // piece, len(turns[k:k + piece]), len(people), body, mask))
    return sorted(out)


def got(df):
    return sorted((repr(r.conv_id), r.assistant, r.piece, r.n_turns, r.n_participants, r.text, [tuple(m) for m in r.mask]) for r in df.collect())


def test_rotation(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|end|> ☃"), (1, 2, "bob", "ho"), (1, 3, "cy", None), (1, 3, "ann", "x"), (1, 3, "ann", "x"),
            (2, None, None, "lost"), (2, 1, "ann", ""), (None, 1, "bob", "alone"), (3, 1, "system", "only system"), (4, 1, "ann", "long " * 50000)]
    rows += [(5, i, ("ann", "bob")[i % 2], f"turn {i}") for i in range(30)]
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, assistant string, piece int")
    assert got(p.rotate(docs)) == expected(rows)
    assert got(p.rotate(docs, piece_turns=4)) == expected(rows, 4)
    assert p.rotate(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = sorted((repr(r.conv_id), r.assistant, r.piece, r.n_turns, r.n_participants, r.text, r.mask)
                 for r in QUERIES["op2_perspective_chat"](spark, sf_dir).collect())
    assert out == [(*e[:6], ",".join(f"{a}-{b}" for a, b in e[6])) for e in expected(rows)]
