import tracemalloc

import numpy as np

from strandline.llm.linear import fit


def test_fit_takes_one_copy_of_the_features():
    """The driver fits beside its own JVM: one scaled copy (two while the spread is taken), no more."""
    x = np.random.default_rng(1).random((400, 5000), np.float32)
    y = (x[:, 0] > 0.5).astype(float)
    tracemalloc.start()
    w, b = fit(x, y, "hinge", l2=1e-2, rounds=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * x.nbytes
    assert np.isfinite(w).all() and np.isfinite(b)
