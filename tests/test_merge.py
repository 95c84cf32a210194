from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest

from studylantern.operators import checks, merge
from studylantern.operators.merge import MergeRule, upsert

RULE = MergeRule(("k",), ("u",), ("i",))
DDL = "k int, u string, i string, other string"


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_partial_columns(spark):
    base = spark.createDataFrame([(1, "u1", "i1", "o1"), (2, "u2", "i2", "o2")], DDL)
    batch = spark.createDataFrame([(1, None, "x", 10), (3, "first", "f", 1), (3, "last", "l", 2)], "k int, u string, i string, ordinal int")
    expected = [(1, None, "i1", "o1"), (2, "u2", "i2", "o2"), (3, "last", "f", None)]
    for small in (False, True):
        assert rows(upsert(base, batch, RULE, "ordinal", small)) == sorted(expected, key=repr)


records = st.lists(
    st.tuples(st.integers(0, 6), st.sampled_from([None, "a", "b", "c"]), st.sampled_from([None, "x", "y"])), max_size=12
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(records, records)
def test_equals_sequential_upserts_and_is_idempotent(spark, stored, sent):
    state = {}
    for k, u, i in stored:
        state[k] = (u, i)
    base = spark.createDataFrame([(k, u, i) for k, (u, i) in state.items()], "k int, u string, i string")
    for k, u, i in sent:
        state[k] = (u, state[k][1]) if k in state else (u, i)
    batch = spark.createDataFrame([(k, u, i, n) for n, (k, u, i) in enumerate(sent)], "k int, u string, i string, ordinal int")
    expected = sorted([(k, u, i) for k, (u, i) in state.items()], key=repr)
    once = upsert(base, batch, RULE, "ordinal")
    assert rows(once) == expected
    assert rows(upsert(base, batch, RULE, "ordinal", small_batch=True)) == expected
    assert rows(upsert(once, batch, RULE, "ordinal")) == expected


def test_null_keys_never_conflict(spark):
    rule = MergeRule(("k", "n"), ("u",), (), nullable_keys=("n",))
    base = spark.createDataFrame([(1, None, "old"), (1, 1, "old")], "k int, n int, u string")
    batch = spark.createDataFrame([(1, None, "new", 1), (1, None, "new", 2), (1, 1, "new", 3)], "k int, n int, u string, ordinal int")
    expected = [(1, 1, "new"), (1, None, "new"), (1, None, "new"), (1, None, "old")]
    for small in (False, True):
        assert rows(upsert(base, batch, rule, "ordinal", small)) == sorted(expected, key=repr)


def test_submission_keeps_grade_and_takes_null_score(spark, table):
    key = dict(assignment_id=1, user_id=1)
    base = table("submissions", dict(key, submission_id=1, grade="A", score=5, late=0, attempt=2))
    batch = table("submissions", dict(key, submission_id=9, grade="F", score=None, late=1))
    row = upsert(base, batch, merge.rule_for("submissions")).first()
    assert (row.submission_id, row.grade, row.score, row.late, row.attempt) == (1, "A", None, 1, 2)


@pytest.mark.parametrize("name", [*merge.MERGE_RULES, "student_demographics"])
def test_rules_name_existing_columns(spark, name):
    from studylantern.schemas import table_schema

    rule, columns = merge.rule_for(name), set(table_schema(name).fieldNames())
    named = [*rule.keys, *rule.update, *rule.insert_only]
    assert set(named) <= columns and len(named) == len(set(named))


def test_insert_missing_and_dedupe(spark):
    base = spark.createDataFrame([(1, "a")], "id int, name string")
    batch = spark.createDataFrame([(5, "a", 1), (6, "b", 2), (7, "b", 3)], "id int, name string, ordinal int")
    assert rows(merge.insert_missing(base, batch, ["name"], "ordinal")) == [(1, "a"), (6, "b")]
    many = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id int, name string")
    assert rows(merge.dedupe_keep_first(many, ["name"], "id")) == [(1, "a"), (2, None)]


def test_checks(spark):
    child = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (None, "c"), (4, None)], "k int, d string")
    parent = spark.createDataFrame([(1,)], "p int")
    assert rows(checks.check_unique(child, ["k"])) == [(1, 2)]
    assert rows(checks.check_fk(child, "k", parent, "p")) == [(4, 1)]
    assert rows(checks.check_domain(child, "d", ("a", "b"))) == [(None, "c")]
    assert rows(checks.check_not_null(child, ["k", "d"])) == [("d", 1), ("k", 2)]
