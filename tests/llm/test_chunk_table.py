"""The bound of a worker's table of chunks: the same ids whatever it is, fewer chunks learnt with more."""

import numpy as np

from cohortlab.llm import encoding


def test_larger_table_learns_less_and_gives_the_same_ids():
    rng = np.random.default_rng(7)
    texts = [" ".join(f"w{int(k)}" for k in rng.zipf(1.2, 300) % 5000) for _ in range(60)]
    learnt, ids = [], []
    for limit in (64 * 1024, 8 * 1024 * 1024):
        enc = encoding.encoder(table_bytes=limit)
        assert enc.table.limit == limit and enc is encoding.encoder(table_bytes=limit)
        counted, learn = [], enc.learn
        enc.table.learn = lambda chunks, learn=learn, counted=counted: (counted.append(len(chunks)), learn(chunks))[1]
        ids.append([i for t in texts for i in enc.encode([t])])
        learnt.append(sum(counted))
    assert ids[0] == ids[1] == [enc.ids(t).tobytes() for t in texts]
    assert 2 * learnt[1] < learnt[0]
