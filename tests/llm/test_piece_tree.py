"""Words read along the tree of pieces are cut as the general pass cuts them."""

import random
from array import array

from thermaline.llm import pieces


def test_words_by_tree():
    model, rng = pieces.Model(pieces.model_path()), random.Random(7)
    assert set(model.tree) == {p[0] for p in model.known}
    for _ in range(3000):
        w = "".join(rng.choice("▁▁abethionsé日🙂ß#*09") for _ in range(rng.randint(1, 14)))
        best, back = model.forward(w, [0], len(w))
        assert model.word(w) == (array("I", model.ids(w, pieces.trace(back, len(w)))).tobytes(), best[len(w)])
