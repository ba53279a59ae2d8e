from panelspark.operators.replies import SCHEMAS, validate


def test_fields_errors_and_defaults(spark):
    rows = [
        (1, 'sure: {"summary_text": "s", "risks": [{"title": "a", "category": "Tech", "severity": "SEVERE"}], "rl": {"signal": "7.5", "confidence": 3}} done', "x"),
        (2, '{"risks": [{"severity": "low"}, 5], "rl": {"signal": "up"}}', "x"),
        (3, None, "x"), (4, "  ", "x"), (5, "[1, 2]", "x"), (6, "{broken", "x"),
    ]
    df = spark.createDataFrame(rows, "id int, reply string, summary_text string")
    got = {r.id: r for r in validate(df, "reply", SCHEMAS["call"]).collect()}
    one = got[1]
    assert one.errors == [] and one.summary_text == "s" and one.rl_signal == 7.5 and one.rl_confidence == 1.0 and one.rl_risk_score == 0.0
    assert [tuple(x) for x in one.risks] == [("a", "technology", "high", "")] and one.opportunities == []
    assert got[2].errors == ["summary_text: missing", "risks.0.title: missing", "risks.1.title: missing", "rl.signal: not a number"]
    assert [x.severity for x in got[2].risks] == ["low", "medium"] and got[2].summary_text is None
    for i in (3, 4, 5, 6):
        assert got[i].errors == ["no JSON object"] and got[i].risks == [] and got[i].rl_confidence == 0.5
    assert validate(df.limit(0), "reply", SCHEMAS["filing"]).count() == 0
