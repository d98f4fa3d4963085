import math

from pyspark.sql import functions as F

from turnwise.functions import parsing

SCORES = {
    '{"score": 8}': 8,
    ' \n{"score": 9}\n': 9,
    '{"score": "8"}': 8,
    '{"score": "8/10"}': 8,
    '{"score": true}': 1,
    '{"score": "true"}': 0,
    '{"score": null}': 0,
    '{"score": -3}': 0,
    '{"score": 15}': 10,
    '{"score": NaN}': 10,
    '{"score": "nan"}': 10,
    '{"score": Infinity}': 10,
    '{"score": "-inf"}': 0,
    '{"score": 1e1}': 10,
    '{"score": "1_0"}': 10,
    '{"score": "1__0"}': 0,
    '{"score": 8} ok': 8,
    '{"score": -3} ok': 3,
    '{"score": -2} {"score": 5}': 5,
    '```json\n{"score": 7.5}\n```': 7.5,
    '{"score": 95': 10,
    "7": 7,
    "[9]": 9,
    '{"score": [8]}': 8,
    "Score: 8/10": 8,
    "I give 85, then 7": 0,
    "-5": 5,
    "v2": 0,
    "é5": 0,
    "7.5.2": 7.5,
    '{"score": 3, "score": 6}': 6,
    "{'score': 4}": 4,
    '{"Score": 4}': 4,
    '{"score": "8d"}': 0,
    '{"score": 8,}': 8,
    '{"score": 007}': 7,
    '{"a":{"score": 2}}': 2,
    "10.5": 0,
    "": 0,
    "none": 0,
    '{"score": ""}': 0,
}

PAIR = '{"question":"q","answer":"a"}'
QA = {  # None: does not parse; otherwise the number of pairs, or "null"
    f'{{"qa_pairs":[{PAIR}]}}': 1,
    f'```json\n{{"qa_pairs":[{PAIR}]}}\n```': 1,
    f'Here: {{"qa_pairs":[{PAIR},{PAIR}]}} bye': 2,
    '{"other":1}': 0,
    '{"qa_pairs":null}': "null",
    '{"qa_pairs":[]}': 0,
    '{"qa_pairs":[{"question":"q"}]}': 1,
    f'{{"qa_pairs":[],"qa_pairs":[{PAIR}]}}': 1,
    "[1]": None,
    "```[1]```": None,
    '{"qa_pairs":[{"q': None,
    '{"a":1} {"qa_pairs":[]}': None,
    f'{{"a":1}}], [{{"qa_pairs":[{PAIR}]}}': None,
    '{"qa_pairs":[{"question":"a\nb","answer":"c"}]}': None,
    "": None,
    "nothing": None,
}


def test_scores(column):
    got = column(SCORES, lambda x: parsing.clamp_score(parsing.extract_score(x)))
    assert dict(zip(SCORES, got)) == {k: float(v) for k, v in SCORES.items()}


def test_unclamped_scores(column):
    got = column(['{"score": -3}', '{"score": 15}', '{"score": NaN}'], parsing.extract_score)
    assert got[:2] == [-3.0, 15.0] and math.isnan(got[2])


def test_qa_replies(column):
    found = column(QA, parsing.qa_json)
    pairs = column(QA, lambda x: parsing.qa_pairs(parsing.qa_json(x)))
    got = {}
    for text, json, read in zip(QA, found, pairs):
        got[text] = None if json is None else "null" if read is None else len(read)
    assert got == QA


def test_strip_prompt(column):
    got = column(["100% {x}"], lambda x: parsing.strip_prompt(F.concat(x, F.lit("\n  an answer\xa0\n")), x))
    assert got == ["an answer"]
