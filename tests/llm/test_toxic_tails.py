"""Symbols behind a word are read once per pair of symbols before them, and as a whole beam reads them."""

import numpy as np

from thermaline.llm import toxicity


def test_tails_are_read_once():
    codes = toxicity.symbols("  the worst burst hers cursed shells lost toasts  ")
    triples, n = np.unique((codes[:-2] * toxicity._SIZE + codes[1:-1]) * toxicity._SIZE + codes[2:], return_counts=True)
    model = toxicity.CharModel.of(dict(zip(triples.tolist(), n.tolist(), strict=True)))
    one = toxicity.decode("burst$$$", model)
    assert one.startswith("burst") and len(model.tails) == 1
    assert toxicity.decode("worst$$$", model) == "worst" + one[5:] and len(model.tails) == 1
    assert toxicity.decode("sh3ll$", model)[:2] == "sh" and len(model.tails) == 1  # a letter behind: no tail
    reader = toxicity.Restorer(model)
    assert reader.read("lost,") == ["lost"] and reader.read("a.b") == ["a", "b"] and reader.read("...") == []
