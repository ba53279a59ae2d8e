from panelspark.llm.turns import speaker_turns

CALL = """Acme Foods earnings conference call, transcript
2020-01-02
Participants:
Ann Lee (Chief Executive Officer)
Bob O'Neill-Ray, Analyst

The Operator: Welcome. The first question is from the line of Cid de Voss.
[00:01:02] >> ANN LEE: Hello um, there. [applause]
Revenue: $3 million, up 5%.
Three priorities: cost and care.
00:02:03.100 --> 00:02:05.000
Ms. Lee: [laughter] Uh...
Lee, Ann: More — uhm — words (laughter) here.
Bob O'Neill-Ray -- Analyst -- Firm Group
Hmm, a question at 10:30 today?
[Operator]: (coughs)
Q - B. O'Neill-Ray: Still me.
<v Cid de Voss> I ask.
**Ann  Lee:** I answer.
Unidentified Analyst : And I.
Speaker: Mr. de Voss - Again.
Mr. Nobody： Who?
Operator: *background noise*
"""


def turns(spark, rows):
    df = spark.createDataFrame(rows, "doc_id string, text string, line_no int, speaker string")
    return [(r.doc_id, r.turn_no, r.speaker, r.speech) for r in speaker_turns(df, doc="doc_id", text="text").orderBy("doc_id", "turn_no").collect()]


def test_every_label_form(spark):
    for text in (CALL, CALL.replace("\n", "\r\n")):
        got = turns(spark, [("c", text, 1, "x"), ("c", text, 2, "y")])
        assert [(n, s) for _, n, s, _ in got] == [
            (1, "operator"), (2, "ann lee"), (3, "bob o'neill-ray"), (4, "cid de voss"), (5, "ann lee"), (6, "unidentified analyst"), (7, "cid de voss"), (8, "nobody"),
        ]
        speech = {n: t for _, n, _, t in got}
        assert speech[2] == "Hello there. Revenue: $3 million, up 5%. Three priorities: cost and care. More words here."
        assert speech[3] == "a question at 10:30 today? Still me." or speech[3].startswith("a question at")


def test_nothing_to_say(spark):
    assert turns(spark, []) == []
    assert turns(spark, [("a", None, 1, ""), ("b", "", 1, ""), ("c", "  \n ", 1, ""), (None, CALL, 1, ""), ("d", "no label here\nat all", 1, ""), ("e", "Operator: [music]\nOperator: um...", 1, "")]) == []


def test_long_text(spark):
    text = "Operator: Hi.\nAnn Lee: " + "word " * 50_000 + "\n" + "\n".join(f"line {i}" for i in range(3000))
    got = turns(spark, [("a", text, 1, "")])
    assert [s for _, _, s, _ in got] == ["operator", "ann lee"] and len(got[1][3]) > 250_000
