"""Long conversations, trees that very many share, and the registered query with its own conversation."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from cohortloom.llm import chat_tree
from cohortloom.llm.common import read
from cohortloom.llm.queries import BYTE_BPE, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_digests(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        spoken = "".join(t for _, r, t in turns if r == "assistant")
        size = sum(len(f"<|{chat_tree.escape_text(r)}|>\n{chat_tree.escape_text(t)}<|end|>\n") for _, r, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(spoken), sha(spoken), size)
    return out


def test_query_and_its_own_conversation(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in read(spark, SF, "conversations").collect()]
    want = brute_digests([*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in QUERIES["op1_chat_tree"](spark, SF).collect()}
    assert got == want and got[-7][0] == 2


def check_trees(nodes):
    by_id = {bytes(r["node"]): r for r in nodes}
    trees = defaultdict(list)
    for r in by_id.values():
        trees[bytes(r["tree"])].append(r)
    for own in trees.values():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(np.cumsum([0] + [len(r["tokens"]) for r in own])[:-1])
        merged = {}
        for r in own:  # parents come before their children
            p = by_id.get(bytes(r["parent"])) if r["parent"] is not None else None
            above = [] if p is None else [*merged[bytes(p["node"])], (p["start"], p["start"] + len(p["tokens"]))]
            if len(above) > 1 and above[-2][1] == above[-1][0]:
                above[-2:] = [(above[-2][0], above[-1][1])]
            merged[bytes(r["node"])] = above
            assert [(x["start"], x["stop"]) for x in r["attends"]] == above
            assert r["position"] == sum(b - a for a, b in above)
    return trees


def test_a_conversation_of_many_turns(spark):
    rows = [(1, i, "user", f"turn {i}") for i in range(5000)] + [(2, i, "user", f"turn {i}" if i < 4990 else "other") for i in range(5000)] + [(3, i, "user", f"turn {i}") for i in range(100)]
    nodes = chat_tree.build_trees(spark.createDataFrame(rows, SCHEMA), tokenizer_path(BYTE_BPE))[0].collect()
    trees = check_trees(nodes)
    assert [len(own) for own in trees.values()] == [5010] and max(len(r["attends"]) for r in nodes) == 2


@pytest.mark.parametrize(("run", "stretch"), [(2, 2), (3, 5)])
def test_one_tree_over_all_conversations(spark, monkeypatch, run, stretch):
    monkeypatch.setattr(chat_tree, "RUN", run)
    monkeypatch.setattr(chat_tree, "STRETCH", stretch)
    rng = np.random.default_rng(3)
    rows = [(c, 0, "system", "You help.") for c in range(300)] + [(c, t, ("user", "assistant")[t % 2], f"say {rng.integers(3)}") for c in range(300) for t in range(1, 6)]
    trees = check_trees(chat_tree.build_trees(spark.createDataFrame(rows, SCHEMA), tokenizer_path(BYTE_BPE))[0].collect())
    assert len(trees) == 1
