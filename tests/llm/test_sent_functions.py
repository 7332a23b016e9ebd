"""Functions that travel to tasks stay small, whatever the driver has computed before."""

import pickle

import numpy as np
from pyspark import cloudpickle

from trustlens.llm import flat, jaccard_join


def test_powers_made_on_the_driver_do_not_travel():
    data = np.frombuffer(b"some words of a text", np.uint8)
    before = flat.word_hashes(data, np.array([0, 5]), np.array([4, 10]))
    assert len(flat._bytes.up) > 1 << 20
    sent = cloudpickle.dumps(jaccard_join.token_sets)
    assert len(sent) < 1 << 20 and len(pickle.dumps(flat._bytes)) < 1000
    again = pickle.loads(pickle.dumps(flat._bytes))
    again.grow(10)
    assert (again.up[:10] == flat._bytes.up[:10]).all() and (again.down[:10] == flat._bytes.down[:10]).all()
    assert (flat.word_hashes(data, np.array([0, 5]), np.array([4, 10])) == before).all()
