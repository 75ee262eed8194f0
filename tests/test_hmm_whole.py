"""Models are trained on every shape of a parameter, for as many iterations as the operator's default."""

from itertools import islice, product

import numpy as np

from gatewarden.operators import hmm, structure
from gatewarden.plans import queries


def test_rare_shapes_train(frame):
    values = ["".join(x) for x in islice(product("a1-", repeat=9), 10_050)]
    requests = frame([(k, "GET", f"http://h/p?q={v}", None, 0) for k, v in enumerate(values)], "id long, method string, url string, body string, label int")
    model = structure.train(requests, iterations=1).collect()[0]
    shapes = sorted(v.replace("a", "A").replace("1", "N").replace("-", "S") for v in values)
    start, trans, emit = hmm.baum_welch(shapes, [1] * len(shapes), iterations=1)
    assert model.n_values == len(values)
    assert np.allclose(model.start, start, atol=1e-12) and np.allclose(model.trans, trans, atol=1e-12) and np.allclose(model.emit, emit, atol=1e-12)


def test_query_trains_to_the_default(spark, monkeypatch):
    given = {}
    monkeypatch.setattr(queries.structure, "train", lambda rows, **options: given.update(options))
    monkeypatch.setattr(queries.structure, "detect", lambda rows, models: rows.withColumns({"identifier": rows.method, "verdict": rows.method}))
    monkeypatch.setattr(queries, "page_requests", lambda spark, sf_dir: spark.createDataFrame([(1, "GET", "http://h/p", "")], "id long, method string, url string, body string"))
    queries.hmm_anomaly_verdict(spark, "").collect()
    assert given.get("iterations", hmm.ITERATIONS) == hmm.ITERATIONS
