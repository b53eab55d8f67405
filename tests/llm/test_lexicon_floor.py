import numpy as np

from sedimenta.llm import toxicity as T


def test_floor_is_alike_at_every_size():
    """A word in four toxic texts is learned, however many toxic texts there are."""
    for n in (100, 1000):
        toxic = [f"t{i}a t{i}b t{i}c t{i}d {'zorb' if i < 4 else ''}" for i in range(n)]
        clean = [f"c{i}a c{i}b c{i}c c{i}d" for i in range(2 * n)]
        assert "zorb" in T.learn_lexicon(toxic + clean, np.array([1] * n + [0] * 2 * n)).learned
