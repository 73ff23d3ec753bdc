"""The reference's validator / profile cases, plus the chat-schema audit."""

from tunedata.operators import profile as P
from tunedata.operators import validate as V

REC = "instruction string, input string, output string"


def _issues(spark, rows, schema=REC):
    df = spark.createDataFrame(rows, schema)
    return [(r.severity, r.affected_field) for r in V.validation_issues(df).orderBy("issue_no").collect()]


def test_clean_records_have_no_issue(spark):
    rows = [("Say hi", "to Bob", "Hi Bob"), ("Add", "1 and 2", "3")]
    assert _issues(spark, rows) == []
    assert V.validation_report(spark.createDataFrame(rows, REC)).first().is_valid


def test_missing_header_is_error(spark):
    df = spark.createDataFrame([("Do it", "now")], "instruction string, input string")
    rep = V.validation_report(df).first()
    assert not rep.is_valid
    iss = [(r.severity, r.affected_field) for r in V.validation_issues(df).orderBy("issue_no").collect()]
    assert ("error", "output") in iss


def test_duplicates_warn_but_stay_valid(spark):
    rows = [("a", "b", "c"), ("a", "b", "c")]
    assert ("warning", "records") in _issues(spark, rows)
    assert V.validation_report(spark.createDataFrame(rows, REC)).first().is_valid


def test_empty_dataset_is_error(spark):
    df = spark.createDataFrame([], REC)
    rep = V.validation_report(df).collect()
    # an empty table has no dataset row; with a catalog the dataset is reported empty
    cat = spark.createDataFrame([("ds",)], "dataset_id string")
    rep = V.validation_report(df.selectExpr("'ds' AS dataset_id", "*"), "dataset_id", catalog=cat).first()
    assert not rep.is_valid and rep.n_errors == 1


def test_severity_error_when_all_missing(spark):
    rows = [("", None, "x"), ("  ", "", "y")]
    iss = _issues(spark, rows)
    assert ("error", "instruction") in iss and ("info", "input") in iss


def test_profile_values(spark):
    rows = [("Say hi", "", "Hello there"), ("Say hi", "", "Hello there"), ("Q", "ctx", "")]
    p = P.profile(spark.createDataFrame(rows, REC)).first()
    assert p.rows_count == 3 and p.duplicate_count == 1 and p.columns == "input,instruction,output"
    assert p.avg_prompt_length == round((6 + 6 + 5) / 3, 2)
    assert p.avg_response_length == round((11 + 11 + 0) / 3, 2)
    # tokens: "Say hi" -> 2 words -> 2; "Hello there" -> 2; "Q ctx" -> 2; "" -> 0
    assert p.estimated_tokens == 2 + 2 + 2 + 2 + 2 + 0


def test_fingerprint_number_and_text_collide(spark):
    a = spark.createDataFrame([("1", "x")], "a string, b string")
    b = spark.createDataFrame([(1, "x")], "a int, b string")
    fa = a.select(V.row_fingerprint(a).alias("f")).first().f
    fb = b.select(V.row_fingerprint(b).alias("f")).first().f
    assert fa == fb


def test_chat_text_audit(spark):
    ok = '{"role": "user", "content": "y"}'
    cases = [
        ('{"other": 1}', "missing_messages", None), ("[1]", "missing_messages", None), ('"text"', "missing_messages", None),
        ('{"messages": "hello"}', "messages_not_list", None), ('{"messages": null}', "messages_not_list", None),
        ('{"messages": {"role": "user", "content": "y"}}', "messages_not_list", None),
        ('{"messages": []}', "too_few_turns", None), ('{"messages": [%s]}' % ok, "too_few_turns", None),
        ("{not json", "invalid_json", None),
        ('{"messages": [{"role": "tool", "content": "x"}, %s]}' % ok, "invalid_role", 0),
        ('{"messages": [%s, {"role": null, "content": "x"}]}' % ok, "invalid_role", 1),
        ('{"messages": [{"role": 1, "content": "x"}, %s]}' % ok, "invalid_role", 0),
        ('{"messages": [{"role": "user"}, %s]}' % ok, "missing_role_or_content", 0),
        ('{"messages": [{"content": "c"}, %s]}' % ok, "missing_role_or_content", 0),
        ('{"messages": [{"role": "user", "content": "  "}, %s]}' % ok, "blank_content", 0),
        ('{"messages": [%s, {"role": "user", "content": 42}]}' % ok, "content_not_string", 1),
        ('{"messages": [%s, {"role": "user", "content": {"t": 1}}]}' % ok, "content_not_string", 1),
        ('{"messages": [%s, {"role": "user", "content": null}]}' % ok, "content_not_string", 1),
        ('{"messages": [%s, {"role": "user", "content": ["a"]}]}' % ok, "content_not_string", 1),
        ('{"messages": [%s, 7]}' % ok, "turn_not_object", 1), ('{"messages": [%s, null]}' % ok, "turn_not_object", 1),
        ('{"messages": [%s, "user"]}' % ok, "turn_not_object", 1),
    ]
    fine = ['{"messages": [%s, %s]}' % (ok, ok), "   ", ""]
    df = spark.createDataFrame(list(enumerate([c[0] for c in cases] + fine)), "k int, value string")
    got = sorted(((r.k, r.rule, r.turn_index) for r in V.chat_text_violations(df, "k").collect()), key=repr)
    assert got == sorted(((k, rule, i) for k, (_, rule, i) in enumerate(cases)), key=repr)


def test_empty_profile_is_all_zero(spark):
    p = P.profile(spark.createDataFrame([], REC)).collect()
    assert len(p) == 1 and (p[0].rows_count, p[0].duplicate_count, p[0].estimated_tokens) == (0, 0, 0)
    assert (p[0].avg_prompt_length, p[0].avg_response_length) == (0.0, 0.0)


def test_chat_fail_fast(spark):
    import pytest
    bad = spark.createDataFrame([(1, '{"messages": [{"role": "user", "content": "hi"}]}')], "k int, value string")
    with pytest.raises(ValueError, match="too_few_turns"):
        V.assert_chat_schema(V.chat_text_violations(bad, "k"), "k")
    good = spark.createDataFrame([(1, '{"messages": [{"role": "user", "content": "a"}, '
                                      '{"role": "assistant", "content": "b"}]}')], "k int, value string")
    V.assert_chat_schema(V.chat_text_violations(good, "k"), "k")


def test_turn_audit_keeps_rows_without_number_or_key(spark):
    rows = [(1, 0, "user", "a"), (1, None, "tool", "b"), (None, 0, "bot", "c"), (2, 5, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, V.chat_turn_violations_long(df, "conv_id").collect()), key=repr)
    assert got == sorted([(1, "invalid_role", 0), (None, "invalid_role", 0), (None, "too_few_turns", None), (2, "missing_role_or_content", 0), (2, "too_few_turns", None)], key=repr)
