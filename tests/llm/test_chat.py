from hypothesis import given, settings
from hypothesis import strategies as st

from spindrift.llm import chat

turn = st.tuples(st.sampled_from(["user", "assistant", "a:b", "<x>", "\\"]), st.text(alphabet="ab\\<#/ tTurn>:\n", max_size=30))


@settings(max_examples=200, deadline=None)
@given(st.lists(turn, max_size=6))
def test_template_is_reversible(turns):
    text, loss = chat.format_turns(turns, "assistant")
    assert chat.read_turns(text) == turns
    said = "".join(chat._ESCAPED.sub(r"\1", text[a:b]) for a, b in loss)
    assert said == "".join(t for r, t in turns if r == "assistant")


def test_tree_paths_scores_and_faults(spark):
    rows = [
        ("1", None, "user", "q", 0.0), ("2", "1", "assistant", "bad", 0.1), ("3", "1", "assistant", "good", 0.9), ("4", "3", "user", "more", 0.5), ("5", "4", "assistant", "end", 0.4),
        ("6", "x", "user", None, None), ("7", "8", "user", "cycle", 1.0), ("8", "7", "user", "cycle", 1.0), ("9", "7", "user", "hangs", 1.0),
    ]
    messages = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double")
    paths = {}
    for r in chat.reply_paths(messages).collect():
        paths.setdefault(r.leaf, {})[r.up] = r.id
    assert {k: [v[i] for i in sorted(v, reverse=True)] for k, v in paths.items() if k != "9"} == {"2": ["1", "2"], "5": ["1", "3", "4", "5"], "6": ["6"]}
    best = {r.root: r for r in chat.format_conversations(messages.where("id not in ('7', '8', '9')")).collect()}
    assert [t for _, t in chat.read_turns(best["1"].formatted)] == ["q", "good", "more", "end"]
    assert chat.read_turns(best["6"].formatted) == [("user", "")]
    every = chat.format_conversations(messages.where("id not in ('7', '8', '9')"), best=None).collect()
    assert sorted((r.root, r.leaf, r.branch_rank) for r in every) == [("1", "2", 2), ("1", "5", 1), ("6", "6", 1)]
    assert chat.format_conversations(messages.limit(0)).count() == 0


def test_long_chain_takes_few_joins(spark):
    messages = spark.range(200).selectExpr("cast(id as string) id", "cast(nullif(id, 0) - 1 as string) parent")
    rows = chat.reply_paths(messages).collect()
    assert len(rows) == 200 and {r.leaf for r in rows} == {"199"} and {(int(r.id), r.up) for r in rows} == {(199 - u, u) for u in range(200)}


def test_threads_keep_repeated_and_null_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 1, "user", "z"), (None, 2, "assistant", "y")]
    made = chat.threaded(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    texts = {r.root: chat.read_turns(r.formatted) for r in chat.format_conversations(made).collect()}
    assert texts == {"1#1": [("", ""), ("user", "a"), ("user", "a")], "null#1": [("user", "z"), ("assistant", "y")]}


def test_scores_carried_through_the_doubling_rank_like_unfolded_paths(spark):
    import random

    rng = random.Random(3)
    rows = [("0", None, "user", "t0", 0.0)]
    for i in range(1, 120):
        rows.append((str(i), str(rng.randrange(max(0, i - 9), i)) if i % 17 else "gone", "user", f"t{i}", None if i % 11 == 0 else rng.randrange(8) / 8))
    rows += [("c1", "c2", "user", "x", 1.0), ("c2", "c1", "user", "x", 1.0), ("c3", "c1", "user", "x", 1.0)]
    messages = spark.createDataFrame(rows, "id string, parent string, role string, text string, score double").selectExpr("*", "1 AS leaf", "2 AS root", "3 AS up", "4 AS total")
    above, said = {r[0]: r[1] for r in rows}, {r[0]: r for r in rows}
    trees = {}
    for leaf in above.keys() - set(above.values()) - {"c3"}:
        path = [leaf]
        while above[path[-1]] in above:
            path.append(above[path[-1]])
        trees.setdefault(path[-1], []).append((-sum(said[i][4] or 0 for i in path) / len(path), leaf, path))
    for best in (1, 2, None):
        got = sorted((r.root, r.branch_rank, r.leaf, [t for _, t in chat.read_turns(r.formatted)]) for r in chat.format_conversations(messages, best).collect())
        want = sorted((root, k, leaf, [said[i][3] for i in reversed(path)]) for root, own in trees.items() for k, (_, leaf, path) in enumerate(sorted(own)[:best], 1))
        assert got == want
