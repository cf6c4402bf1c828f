"""Labels by form, and candidates given under a secret's name."""

from pyspark.sql import functions as F

from docket.llm import secrets


def labelled(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    rows = secrets.candidates(df).withColumn("label", secrets.named_or_well_formed()).collect()
    return [sorted((r.run, r.label) for r in rows if r.doc_id == i) for i in range(len(texts))]


def test_named_and_known_forms_are_secrets(spark):
    key = "aB3dE6gH9jK2mN5pQ8sT"
    texts = {f'{{"password": "{key}"}}': key, f'"api_key" : "{key}"': key, f"Authorization: Bearer {key}": key,
             f'token => "{key}"': key, f"so ghp_{key}": f"ghp_{key}", f"so sk_live_{key}": f"sk_live_{key}",
             f"so xoxb-{key}": f"xoxb-{key}", "password = hunter2": "hunter2", 'pwd="p@ss!w0rd#x"': "p@ss!w0rd#x",
             "api_key=abcdefghijklmnop": "abcdefghijklmnop", "secret: 'x'": "x",
             'passwd="aaaaaaaa11111111!bbbbbbbb22222222"': "aaaaaaaa11111111!bbbbbbbb22222222"}
    got = labelled(spark, texts)
    assert got == [[(v, 1)] for v in texts.values()]
    head, body, sign = "eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxMjM0NTY3ODkwIn0", "dozjgNryP4J3jVmNHl0w5N"
    assert labelled(spark, [f"jwt {head}.{body}.{sign}"]) == [sorted([(head, 1), (body, 1), (sign, 1)])]


def test_other_forms_and_undecided(spark):
    texts = {"n 4785-3805-9239-1139": 0, "on 2024-01-31T101500Z": 0, "see /usr/share/doc/file-7": 0, "the open-source-code-7": 0,
             "so aB3dE6gH9jK2mN5pQ8sT": None, "key = ${VALUE_1234567890}": None}
    assert [[x for _, x in r] for r in labelled(spark, texts)] == [[x] for x in texts.values()]
    prose = ["author: Smith", "the monkey: x1", "a keyword = word", "see token ="]
    assert labelled(spark, prose) == [[], [], [], []]


def test_short_values_are_scored(spark):
    rows = [(i, f"password = {'x' * (i % 3 + 1)}{i % 7} and {10**15 + i * 7919}", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.scan(df, secrets.named_or_well_formed()).collect()
    assert len(found) == 120 and all(r.probability is not None and r.transitions is not None for r in found)
    rows = [(1, "password = x", "s")]
    found = secrets.scan(spark.createDataFrame(rows, df.schema), secrets.named_or_well_formed()).collect()
    assert [(r.run, r.length) for r in found] == [("x", 1.0)]
