import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions.jsonparse import salvage


def py_salvage(reply):
    """Plain-Python statement of the rule: whole reply, else greedy {...} span."""
    try:
        return "direct", json.loads(reply)
    except json.JSONDecodeError:
        m = re.search(r"\{.*\}", reply, re.DOTALL)
        if m:
            try:
                return "span", json.loads(m.group())
            except json.JSONDecodeError:
                return None, None
        return None, None


scalars = st.one_of(st.integers(-1000, 1000), st.booleans(), st.none(),
                    st.text(alphabet="abc xyz", max_size=5))
objects = st.dictionaries(st.sampled_from(["k", "invoice_number", "total"]), scalars, max_size=3)
noise = st.sampled_from(["", " ", "Sure! ", "x ", "\n", "Done.", " }", "{", "here: "])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(noise, objects, noise, st.booleans()), min_size=1, max_size=12))
def test_salvage_matches_python(spark, parts):
    replies = []
    for pre, obj, post, twice in parts:
        body = json.dumps(obj)
        replies.append(pre + body + ("\n" + body if twice else "") + post)
    df = spark.createDataFrame([(r,) for r in replies], "reply string").withColumn("s", salvage("reply"))
    got = df.select(F.col("s.source").alias("src"), F.to_json(F.col("s.value")).alias("v")).collect()
    for reply, row in zip(replies, got):
        src, val = py_salvage(reply)
        assert row.src == src, reply
        if src is not None:
            assert json.loads(row.v) == val, reply


def test_replies_that_close_the_reading_early_are_no_json(spark):
    from ledgerlens.functions.jsonparse import strict_json

    bad = ['1,"x":2', '{"a":1},"b":{"c":2}', '"note","total_amount":5', '1,"end":1}', "1]", "1,2", "", None]
    good = ['{"a":1}', " 1 ", "[1,2]", '"x"', "true"]
    df = spark.createDataFrame([(t,) for t in bad + good], "t string")
    got = [r[0] for r in df.select(strict_json("t").isNotNull()).collect()]
    assert got == [False] * len(bad) + [True] * len(good)
