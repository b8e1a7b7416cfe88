import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loamsift.llm import common as C


def test_slices_lose_nothing():
    r = random.Random(1)
    for _ in range(50):
        texts = [r.choice([None, "", "a" * r.randrange(40), "é" * r.randrange(40)]) for _ in range(r.randrange(30))]
        for most in (1, 30, 10**6):
            got = list(C.slices(pa.array(texts, pa.string()), most))
            assert [t for _, run in got for t in run] == [t or "" for t in texts]
            assert [at for at, _ in got] == list(np.cumsum([0, *[len(run) for _, run in got]]))[: len(got)]
            assert all(len(run) == 1 or sum(len(t.encode()) for t in run) <= most for _, run in got)
    part = pa.array(["aa", "b", None, "cc"])[1:]
    assert list(C.slices(part, 1)) == [(0, ["b", ""]), (2, ["cc"])]


def test_the_shared_folder_is_not_guessed_on_a_cluster():
    conf = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "k8s://x", "spark://h:1", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            C.shared_dir(session(master))
    conf["spark.checkpoint.dir"] = "hdfs:///shared"
    assert C.shared_dir(session("yarn")) == "hdfs:///shared"


def test_codes_of_ids_keep_their_order():
    for ids in (pa.array([5, 3, 5, -1]), pa.array(["b", "a", "b", "é"]), pa.chunked_array([["x"], ["a", "x"]])):
        codes, back = C.id_codes(ids)
        values = ids.to_pylist()
        assert back(codes).to_pylist() == values
        assert all((codes[i] < codes[j]) == (values[i] < values[j]) for i in range(len(values)) for j in range(len(values)))
