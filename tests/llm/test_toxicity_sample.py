import os

from millrace.llm import toxicity


def test_rows_that_cannot_be_taken_are_replaced(spark):
    """A class whose first labels have no document is filled up from its other labels; long texts are taken whole."""
    ids = list(range(60))
    order = [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("i", "xxhash64(cast(i as string)) h").orderBy("h").collect()]
    toxic, clean = order[:40], order[40:]
    long = "river stone " * 6000
    rows = [(i, f"{long} stupidest idiot {i}" if k < 5 else f"stupidest idiot {i}") for k, i in enumerate(toxic[20:])] + [(i, f"river stone {i}") for i in clean]  # toxic[:20] have no document
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in set(toxic))) for i in ids], "doc_id long, toxic int")
    bad, good, late = toxicity.fit(docs, labels, per_class=10).scores(["stupidest idiot", "river stone", "river stone " * 9000 + "idiot " * 9000])
    assert bad > 0.5 > good and late > 0.5


def test_the_driver_never_holds_the_texts_of_the_sample(spark, monkeypatch):
    """The fit runs in a task, on the same rows in the same order as `train`; empty texts count."""
    rows = [(i, f"stupidest idiot {i}" if i % 3 == 0 else f"river stone {i}" if i % 3 == 1 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    bagged = [(str(i), int(i % 3 == 0), *(x.astype("i4").tobytes() for x in next(toxicity._bags([t])))) for i, t in rows]
    order = [int(b[0]) for b in sorted(bagged)]
    want = toxicity.train([rows[i][1] for i in order], toxicity.np.array([int(i % 3 == 0) for i in order]), 1 / 3)

    driver, real = os.getpid(), toxicity.train_bags

    def watched(found, *rest):
        assert os.getpid() != driver, "fitted on the driver"
        return real(found, *rest)

    monkeypatch.setattr(toxicity, "train_bags", watched)
    got = toxicity.fit(docs, labels)
    assert (got.effect == want.effect).all() and (got.weight == want.weight).all() and got.intercept == want.intercept
