"""Every conversation and all its turns come out."""

from pyspark.sql import functions as F

from bracken.llm import common, preference, q01


def shown(turns):
    return "".join(f"<|{t.role}|>\n{t.text}<|end|>\n" for t in turns)


def test_every_turn_is_rendered_in_its_conversation(spark, sf):
    by = {}
    for t in sorted(common.table(spark, sf, "conversations").fillna({"role": "unknown", "text": ""}).collect(), key=lambda t: (t.turn, t.role, t.text)):
        by.setdefault(t.conv_id, []).append(t)
    rows = {r.conv_id: r for r in q01.op1_preference_format(spark, sf).collect()}
    assert set(rows) == set(by) and any(r.conv_id % 2 for r in rows.values())
    depths = set()
    for c, r in rows.items():
        own, other = by[c], by.get(c ^ 1, [])
        replies = [i for i, t in enumerate(own) if t.role == "assistant"]
        assert r.prompt + r.chosen == shown(own)
        if not replies:
            assert (r.status, r.prompt, r.chosen, r.rejected) == ("no_reply", shown(own), "", "")
        elif not any(t.role == "assistant" for t in other):
            assert r.status == "unpaired" and r.n_prefix in replies and r.chosen and r.rejected == ""
        else:
            ends = [shown(own[:i]) + shown(other[j:]) for i in replies for j, t in enumerate(other) if t.role == "assistant"]
            assert r.status in ("pair", "identical") and r.prompt + r.rejected in ends
            depths.add(len(replies) - sum(i < r.n_prefix for i in replies))
    assert len(depths) > 1


def test_conversations_without_a_partner_or_a_reply(spark):
    rows = [(2, 0, "user", "alone"), (4, 0, "user", "q"), (4, 1, "assistant", "x"), (4, 2, "user", "bye"), (None, 0, "user", "n"), (7, 0, "assistant", "z"), (6, 0, None, None), (8, 0, "assistant", "e"), (9, 0, "assistant", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("status", F.lit("s"))
    got = {r.conv_id: r for r in preference.every(df).collect()}
    assert {c: r.status for c, r in got.items()} == {2: "no_reply", 4: "unpaired", None: "no_id", 7: "unpaired", 6: "no_reply", 8: "identical", 9: "identical"}
    assert (got[4].prompt, got[4].chosen, got[4].rejected) == ("<|user|>\nq<|end|>\n", "<|assistant|>\nx<|end|>\n<|user|>\nbye<|end|>\n", "")
    assert len(got[4].chosen_spans) == 1 and got[2].prompt == "<|user|>\nalone<|end|>\n" and preference.every(df.limit(0)).count() == 0
