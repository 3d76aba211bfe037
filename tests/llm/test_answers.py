import pytest

from marlstone.llm import answers

Q = "How does Acme Power Inc explain the change in hedged tariffs in its fiscal 2019 10-K filing?"
SOUND = "Acme Power Inc links hedged tariffs to lower demand. Management noted that the plant would close."
CASES = [
    (None, "empty"), ("", "empty"), ("  \n", "empty"), ("TBD", "empty"), ("(no answer)", "empty"), ("[null]", "empty"), ('[""]', "empty"), ("{}", "empty"), ("—", "empty"), ("...", "empty"), ("N/A", "empty"),
    ("I'm sorry, but I cannot help with this question.", "refusal"), ("Thank you for the question. I have to pass on this question.", "refusal"), ('["Unfortunately, I must decline to answer."]', "refusal"), ("As an assistant, no answer can be given by this system.", "refusal"), ("Lo siento, no puedo responder a esta pregunta.", "refusal"),
    (Q, "copies_question"), ("Question: " + Q + "\nAnswer:", "copies_question"), (Q.upper(), "copies_question"), ("You asked: " + Q.replace("explain", "expalin"), "copies_question"), (Q.replace("Acme Power Inc", "the company"), "copies_question"), (Q + " " + Q, "copies_question"),
    ("Der Konzern erklärt den Rückgang durch die gestiegenen Zinsen im Geschäftsjahr.", "other_language"), ("Компания объясняет рост тарифов снижением спроса.", "other_language"), ("Acme Power Inc: La sociedad redujo las ventas por la falta de materias primas.", "other_language"),
    ("Management noted that the plant would", "truncated"), ("Tariffs fell by 3.1% to…", "truncated"), ("Tariffs fell by 3.1% to $", "truncated"), ('["First item.", "Second it', "truncated"), ("The plant closed (see the notes on", "truncated"), ("Tariffs fell because the", "truncated"),
    (SOUND, None), ("No.", None), ("Yes", None), ("$401.5 million.", None), ("About 55.6%", None), ("35.6 percent", None), ("“" + SOUND + "”", None), ('["One reason.", "Another reason."]', None),
    ("Acme Power Inc was unable to answer the auditor's query on tariffs in time, since the plant closed.", None), ("Acme states that it cannot predict tariffs, and it warns that demand may fall.", None), ("The unit trades as “Société Acme”.", None),
]


@pytest.mark.parametrize(("answer", "defect"), CASES)
def test_judge(answer, defect):
    got, last, _ = answers.judge(Q, answer)
    assert got == defect and (defect is not None or not last)


def test_foreign_question_with_its_own_language():
    q = "Comment la société explique-t-elle l'évolution des ventes dans son rapport 2017 ?"
    assert answers.judge(q, "Le groupe attribue la hausse à une demande plus forte dans la région.")[0] is None
    assert answers.judge(q, "The group attributes the increase to higher demand in the region.")[0] == "other_language"
    assert answers.judge(None, "The group attributes the increase to demand.")[0] is None


# Written apart from the grammar's word lists: refusals of the answerer, and sentences that report an inability.
REFUSALS = [
    "Declined to answer.", "I'm sorry, but I can't help with that.", "Unable to assist with this request.", "Not able to respond.", "Sorry. I won't be able to respond.", "I would rather not answer.", "It is not possible for me to answer.", "No answer can be given.",
    "Thank you for your question, but I must decline to respond.", "As an AI language model, I do not have access to filings.", "We cannot provide an answer to that.", "Unfortunately, this question is beyond my scope.", "Answering this would be outside my remit.", "I am not permitted to discuss that topic.",
    "Apologies, I don't have enough information.", "That is not something I can help with.", "This request falls outside what I may do.", "I respectfully decline.", "The assistant cannot answer this.", "Je ne peux pas répondre à cette question.", "Ich kann diese Frage leider nicht beantworten.", "Hello, I'm unable to comply with this request.",
]
REPORTS = [
    "I cannot predict demand, the CEO said.", "We cannot answer for the conduct of third parties.", "The company was unable to answer the auditor's query in time.", "We are unable to estimate the loss.", "Our auditors declined to comment on the matter because of litigation.", "We can not assure you that we will succeed.",
    "Management cannot predict the outcome.", "The lender refused to extend the facility.", "We may be unable to refinance our debt.", "The supplier declined to renew the contract in 2019.", "No assurance can be given that demand will recover.", "We do not have insurance for this risk.", "It is not possible to estimate the range of loss.",
    "The board would not approve the plan.", "Customers could not pay on time.", "The issuer lacks the funds to redeem the notes.", "We decline responsibility for links to other sites.", "The request for a waiver was refused by the bank.", "This question was put to the shareholders in May.", "Unable to pay its debts, the subsidiary filed for bankruptcy.",
]


def test_refusals_and_reports_held_out():
    found, false = [t for t in REFUSALS if answers.refuses(t)], [t for t in REPORTS if answers.refuses(t)]
    assert len(found) >= 0.9 * len(REFUSALS), set(REFUSALS) - set(found)
    assert len(found) >= 0.9 * (len(found) + len(false)), false
    assert not {"I cannot predict demand, the CEO said.", "We cannot answer for the conduct of third parties."} & set(false) and "Declined to answer." in found
    assert answers.judge(Q, "no reply")[0] == "empty"


@pytest.mark.parametrize("text", ["", "Plain words.", "château et l'eau", "schlecht, Zeitung, Möglichkeit", "calle llena de naciones", "filho e nhoque", "l'eau d'or qu'il", "ñandú ¿qué?"])
def test_spellings_of_plain_texts_are_those_of_the_patterns(text):
    for lang in answers.CUES:
        plain = text.encode("ascii", "ignore").decode()
        assert answers.cues(lang, plain) == len(answers._CUE[lang].findall(plain)) and answers.cues(lang, text) == len(answers._CUE[lang].findall(text)) or not text.isascii()


def test_pushdown_parser():
    assert answers.still_open("```\nx (\n``` done") == [] and answers.still_open("(a ```b") == [")", "```"] and answers.still_open('["a \\" b", "c"]') == [] and answers.still_open('["a", "b') == ["]", '"']
    assert answers.still_open("a (b [c] “d”") == [")"] and answers.still_open("```x") == ["```"] and answers.still_open("<b>x</b> (y)") == [] and answers.still_open("1) a") == []
    assert answers.still_open("<b>x") == ["</b>"] and answers.still_open('say "x') == ['"']


def test_tiling():
    assert answers.tiled("a b c x".split(), "a b c".split()) == 0.75 and answers.tiled([], ["a"]) == 0.0 and answers.tiled("a b a b".split(), "a b".split()) == 1.0


def test_defects_of_a_table(spark):
    whole = [(f"s{i}", Q, f"Management noted that the {w} plant reversed costs at the end of the period.") for i, w in enumerate(["old", "new", "big", "red"] * 10)]
    odd = [("t1", Q, "Management noted that the old plant reversed costs at the end of the peri"), ("t2", Q, "Management noted that the old plant reversed costs at the end of the period"), ("e", Q, " "), ("e", Q, " "), (None, Q, ""), ("n", None, None), ("long", Q, "Management noted that the plant closed. " * 3000)]
    df = spark.createDataFrame(whole + odd, "question_id string, question_text string, answer_text string").withColumn("defect", __import__("pyspark").sql.functions.lit("x"))
    assert {tuple(r) for r in answers.defects(df).collect()} == {("t1", "truncated"), ("e", "empty"), ("n", "empty")}
    assert answers.defects(df.limit(0)).count() == 0
