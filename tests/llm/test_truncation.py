import random

from ionloom.llm.truncation import truncated, truncation_by_source

SCHEMA = "doc_id bigint, source string, text string, reason string, n bigint"
SENTENCES = ["The broad fragment at m/z {n}.1234 was assigned to the loss of water from the sample.", "We saw no sign of the compound in mouse liver, although {n} drops were injected twice.", "Is the minor signal near m/z {n}.12 a sodium adduct, or merely carry over from the last run?", "The entry was closed on the same day."]


def corpus(n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(SENTENCES).format(n=rng.randrange(100, 900)) for _ in range(4))
        rows.append((i, "whole", body + rng.choice(["", "\nPrecursor: m/z 345.67"]), "x", 1))
    return rows


def test_cases(spark):
    body = SENTENCES[1].format(n=5) + " " + SENTENCES[0].format(n=77) + " "
    cuts = ["The broad fragment at m/z 345.12", "The broad fragment at m/z 3", "The broad fragment was assi", "We saw no sign of the", "We saw no sign of the com …", "although 17 drops were in [...]", "Is the minor signal near m/", "Is the minor sig�"]
    cuts = [body + c for c in cuts] + [body.strip() + "\nPrecurs", body.strip() + "\nPrecursor: m/z 3"]
    whole = [body.strip(), body + "The entry was closed on the same day", body + "The entry was closed on the same day…", body.strip() + "\nPrecursor: m/z 412.34", "", None, "  \n", "The entry was closed on the same day..."]
    rows = corpus() + [(1000 + i, "s", t, "x", 1) for i, t in enumerate(cuts)] + [(2000 + i, "s", t, "x", 1) for i, t in enumerate(whole)] + [(1000, "s", cuts[0], "x", 1)]
    got = [r.doc_id for r in truncated(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {1000 + i for i in range(len(cuts))}


def test_limit_and_report(spark):
    rows = corpus(200)
    long = " ".join(SENTENCES[3] for _ in range(20)) + " "
    rows += [(5000 + i, "fixed", (long + f"name{i}q" * 60)[:900], "x", 1) for i in range(8)] + [(6000 + i, "fixed", SENTENCES[0].format(n=i + 100), "x", 1) for i in range(24)]
    report = {r.source: (r.texts, r.truncated) for r in truncation_by_source(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert report == {"whole": (200, 0), "fixed": (32, 8)}


def test_empty(spark):
    assert truncated(spark.createDataFrame([], SCHEMA)).collect() == []
