"""The codec's tables: symbols of code points, ranks of scores, and words of every length against the library."""

import numpy as np

from quarry.llm import pieces


def test_symbols_are_taken_from_tables():
    own = pieces.codec(pieces.default_model())
    for c in "aZé 😀​中" + pieces.MARK:
        assert own.of_code[ord(c)] == own.symbol.get(c, -1 - ord(c))
    some = np.arange(len(own.score))
    assert own.rank[-1] > own.rank[:-1].max() and (np.diff(own.rank[:-1][np.argsort(-own.score[some], kind="stable")]) >= 0).all()
    texts = ["", " ", "a", "aaaaaaaa aaa", "😀😀 \x00\ta", "  two  blanks ", "x" * 47 + " " + "y" * 48 + " " + "z" * 200, "\n\n é\n", "Straße naïve 中文 12345"]
    for text, (n, ids, decoded, agrees) in zip(texts, own.code(texts), strict=True):
        want = own.library.encode(text)
        assert (n, ids, decoded.decode(), agrees) == (len(want), ",".join(map(str, want)).encode(), own.library.decode(want), True)
