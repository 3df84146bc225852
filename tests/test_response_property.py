"""Property test: the Spark response validator agrees with a direct Python
statement of the rule (a list literal of exactly 28 floats summing to 1
within 1e-4) on generated responses."""

import ast

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from labeldist.functions import responses as RS


def py_valid(s):
    try:
        v = ast.literal_eval(s)
    except Exception:  # noqa: BLE001
        return False
    return (isinstance(v, list) and len(v) == 28 and all(isinstance(x, float) for x in v)
            and abs(sum(v) - 1) < 1e-4)


def render(values, sep, trailing, lead, tail):
    body = sep.join(repr(x) for x in values)
    return f"{lead}[{body}{',' if trailing else ''}]{tail}"


number = st.one_of(st.floats(min_value=-2, max_value=2, allow_nan=False, allow_infinity=False),
                   st.integers(min_value=-1, max_value=2), st.just(0.0), st.just(1e-05))


@st.composite
def response(draw):
    n = draw(st.sampled_from([2, 27, 28, 28, 28, 29]))
    if draw(st.booleans()):
        vals = [0.0] * n
        vals[draw(st.integers(0, n - 1))] = 1.0
        if draw(st.booleans()):
            vals[draw(st.integers(0, n - 1))] = draw(number)
    else:
        vals = draw(st.lists(number, min_size=n, max_size=n))
    return render(vals, draw(st.sampled_from([", ", ",", " ,\n", " "])), draw(st.booleans()),
                  draw(st.sampled_from(["", " ", "\n", "Answer: "])), draw(st.sampled_from(["", " ", "\n"])))


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(response(), min_size=20, max_size=40))
def test_validator_agrees_with_python_rule(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "r STRING")
    got = [r[0] for r in df.select(RS.validate_response("r").alias("v")).select("v.valid").collect()]
    assert got == [py_valid(t) for t in texts]


from labeldist import taxonomy as tx  # noqa: E402
from labeldist.functions import distributions as D  # noqa: E402

keys = st.sampled_from(tx.L3_SOURCE_KEYS + [tx.EXCLUDED_LABEL])
values = st.floats(min_value=0, max_value=1, allow_nan=False, allow_infinity=False)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(keys, values, min_size=0, max_size=29), min_size=10, max_size=30))
def test_distribution_literal_parses_like_python(spark, dists):
    texts = [repr(d) for d in dists]                  # single-quoted Python dict literals
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(D.parse_distribution("t")).collect()]
    assert [dict(g) for g in got] == [ast.literal_eval(t) for t in texts]
    al = df.select(D.l1_normalize(D.align_distribution(D.exclude_label(D.parse_distribution("t")),
                                                       tx.L3_SOURCE_KEYS)).alias("a")).collect()
    for d, row in zip(dists, al):
        vals = [d.get(k) for k in tx.L3_SOURCE_KEYS]
        tot = sum(abs(v) for v in vals if v is not None)
        exp = [None if v is None else (v if tot == 0 else v / tot) for v in vals]
        assert all((a is None and b is None) or abs(a - b) < 1e-12 for a, b in zip(row.a, exp))
