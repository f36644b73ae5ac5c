"""A conversation with most of all turns, its examples against formatting turn by turn, and what the plan carries."""

from pyspark.sql import functions as F

from bookglass.llm import chat


def plain(turns):
    """(example, formatted, text under the mask) of one conversation's turns, in order."""
    done, out = "", []
    for i, (role, text) in enumerate(turns, 1):
        for raw, mark in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
            role, text = role.replace(raw, mark), text.replace(raw, mark)
        head = "### " + role.replace("\n", "\\n") + "\n"
        before, done = len(done) + len(head), done + head + text + "</turn>\n"
        if role == "assistant" or i == len(turns):
            out.append((i, done, done[before : before + len(text)] if role == "assistant" else ""))
    return out


def test_a_hot_conversation_among_small_ones(spark):
    words = ["a#b", "</turn>\n### user", "\\", "漢🎉 e\u0301", "", "x" * 300]
    hot = [(("user", "assistant", "tool\n#")[i % 3], words[i % 6] + str(i)) for i in range(500)]
    small = {c: [("user", "q"), ("assistant", "a"), ("user", words[c % 6])][: 1 + c % 3] for c in range(2, 60)}
    rows = [(1, i, *x) for i, x in enumerate(hot)] + [(c, i, *x) for c, own in small.items() for i, x in enumerate(own)]
    t = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("example", F.lit("clash")).repartition(7)
    got = {}
    for r in chat.format_conversations(t).collect():
        got.setdefault(r.conv_id, []).append((r.example, r.formatted, r.formatted[r.loss_start : r.loss_start + r.loss_length], r.last))
    for c, own in {1: hot, **small}.items():
        assert [x[:3] for x in sorted(got[c])] == plain(own)
        assert [x[3] for x in sorted(got[c])] == [False] * (len(got[c]) - 1) + [True]


def test_examples_carry_no_turns(spark):
    t = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn int, role string, text string")
    plan = chat.format_conversations(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
