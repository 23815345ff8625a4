import numpy as np

from stillwater.llm.textwords import Stretches, Words, ranges


def test_word_hash_depends_on_the_word_alone():
    a = Words([b"The quick  fox", None, b"", b"fox\n"])
    b = Words([b"some other words first, then the", b"x" * 1000, b"FOX quick"])
    ha, hb = a.hashes(), b.hashes()
    assert a.doc.tolist() == [0, 0, 0, 3] and a.first.tolist() == [0, 3, 3, 3, 4]
    assert ha[2] == ha[3] == hb[-2] and ha[1] == hb[-1] and ha[0] == hb[5]
    assert len(set(ha[:3].tolist())) == 3


def test_stretch_hash_does_not_depend_on_place_or_buffer():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, 500).astype(np.uint8)
    y = np.concatenate([rng.integers(0, 256, 77).astype(np.uint8), x[100:300]])
    assert Stretches(x).of(np.array([100]), np.array([300])) == Stretches(y).of(np.array([77]), np.array([277]))


def test_ranges():
    assert ranges(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
