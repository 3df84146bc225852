"""Response validation, first valid answer, prompt building."""


from labeldist.functions import responses as RS
from labeldist.operators import prompts as PR


def check(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "r STRING")
    return [tuple(x) for x in df.select(RS.validate_response("r").alias("v")).select("v.valid", "v.reason").collect()]


def good(first="0.0"):
    v = [first] + ["0.0"] * 26 + ["1.0" if first == "0.0" else "0.0"]
    return "[" + ", ".join(v) + "]"


def test_reasons(spark):
    ints = "[" + ", ".join(["1"] + ["0.0"] * 27) + "]"
    neg = "[" + ", ".join(["-0.1", "1.1"] + ["0.0"] * 26) + "]"
    got = check(spark, [good(), ints, neg, "[0.5, 0.5]", "Answer: " + good(), good().replace(", ", " "),
                        good().replace("1.0", "0.9"), "  " + good() + "\n", good()[:-1] + ",]", None])
    assert got == [(True, None), (False, "not_float"), (True, None), (False, "length"), (False, "not_list"),
                   (False, "not_list"), (False, "sum"), (True, None), (True, None), (False, "not_list")]


def test_first_valid_after_five_bad(spark):
    rows = [(1, a, "[0.5, 0.5]") for a in range(1, 6)] + [(1, 6, good())] + [(2, 3, good()), (2, 4, good())]
    df = spark.createDataFrame(rows, "itemid INT, attempt INT, response STRING")
    got = {r.itemid: r for r in PR.first_valid(df, ["itemid"]).collect()}
    assert got[1].attempt is None and got[1].probs is None
    assert got[2].attempt == 3


def test_build_messages(spark):
    items = spark.createDataFrame([(1, "en", "Q?"), (2, "xx", "Q2?")], "itemid INT, lang STRING, question STRING")
    prompts = spark.createDataFrame([("en", "P", "ACK")], "lang STRING, prompt STRING, ack STRING")
    ex = spark.createDataFrame([("en", i, f"q{i}", f"a{i}") for i in (3, 1, 2)],
                               "lang STRING, idx INT, question STRING, answer STRING")
    m = {r.itemid: [(x.role, x.content) for x in r.messages]
         for r in PR.build_messages(items, prompts, ex, 2).collect()}
    assert m[1] == [("user", "P"), ("assistant", "ACK"), ("user", "q1"), ("assistant", "a1"),
                    ("user", "q2"), ("assistant", "a2"), ("user", "Q?")]
    assert m[2] == [("user", None), ("assistant", None), ("user", "Q2?")]
